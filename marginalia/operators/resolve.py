"""Choices among candidates: places, assets and the entities that names stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T


def chosen_places(found: DataFrame, gazetteer: DataFrame, least: float = 0.3) -> DataFrame:
    """Of each item's places (id, n, name, confidence) that are sure enough and in the gazetteer (name) the surest, and how many others."""
    known = found.where(F.col("confidence") >= least).join(gazetteer.select("name").distinct(), "name", "left_semi")
    best = known.groupBy("id").agg(F.min(F.struct(-F.col("confidence"), "n", "name", "confidence")).alias("b"), (F.count(F.lit(1)) - 1).alias("others"))
    return best.select("id", F.col("b.name").alias("primary_place"), F.col("b.confidence").alias("confidence"), "others")


def mentioned_assets(found: DataFrame, tracked: list[str]) -> DataFrame:
    """Assets (ticker, name, sentiment) whose name stands in the text, with sentiment within -1 and 1 and whether they are tracked."""
    real = found.where(F.contains(F.lower("text"), F.lower("name")))
    return real.withColumns({"sentiment": M.clamped(F.col("sentiment"), -1.0, 1.0), "tracked": F.col("ticker").isin(*tracked)})


#: Words of a context that say that nothing was said.
NOT_MENTIONED = r"(?i)\b(not mentioned|not discussed|not present|not referenced|no mention|n/?a|none|absent|implied|indirect)\b"
#: Assets that aren't tracked, of a reply.
MOST_DISCOVERED = 10


def grounded(asset: Column) -> Column:
    """Whether a reply's asset (ticker, context, mentions) was met in the text: a mention that is one, else a context of words."""
    context = F.trim(F.coalesce(asset["context"], F.lit("")))
    real = F.exists(F.coalesce(asset["mentions"], F.array().cast("array<string>")), lambda m: F.coalesce((F.trim(m) != "") & ~F.trim(m).rlike(NOT_MENTIONED), F.lit(False)))
    return (F.coalesce(asset["ticker"], F.lit("")) != "") & ~context.rlike(NOT_MENTIONED) & (real | (F.length(context) > 3))


def reply_assets(tracked: Column, discovered: Column, names: dict[str, str], most: int = MOST_DISCOVERED) -> Column:
    """The assets of a reply, tracked ones first, in its order: an array of ticker, name, sentiment, mentions, asset_type, is_tracked.

    ``names`` are the tracked tickers. Those of ``tracked`` (arrays of ticker, name, sentiment, context, mentions) that are
    none of them go, as do those of ``discovered`` that are; so do assets that the text doesn't mention. Of discovered ones
    the first ``most`` stay. A missing sentiment is 0; it stays within -1 and 1. Null arrays are empty.
    """
    name_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = lambda a: F.coalesce(a["ticker"].isin(*names), F.lit(False))
    of = lambda flag: lambda a: F.struct(
        a["ticker"].alias("ticker"), (F.coalesce(F.nullif(a["name"], F.lit("")), F.try_element_at(name_of, a["ticker"])) if flag else a["name"]).alias("name"),
        M.clamped(F.coalesce(a["sentiment"], F.lit(0.0)), -1.0, 1.0).alias("sentiment"), F.coalesce(a["mentions"], F.array(a["ticker"])).alias("mentions"),
        (F.lit(None).cast("string") if flag else T.asset_type(a["ticker"])).alias("asset_type"), F.lit(flag).alias("is_tracked"),
    )
    there = F.transform(F.filter(tracked, lambda a: known(a) & grounded(a)), of(True))
    new = F.slice(F.transform(F.filter(discovered, lambda a: ~known(a) & grounded(a)), of(False)), 1, most)
    return F.when(tracked.isNull(), new).when(discovered.isNull(), there).otherwise(F.concat(there, new))


def placed_items(found: DataFrame, gazetteer: DataFrame, least: float = 0.3) -> DataFrame:
    """id, location, latitude, longitude, others, promoted: where an item is, of its places (id, n, name, confidence).

    The surest place of ``least`` or more, the earliest of equals, if the gazetteer (name, latitude, longitude; a row a
    name) has coordinates for it; else the first other one that has both, which is ``promoted``. ``others`` are the rest
    that have both, in order. An item without any has nulls. Names without letters and null confidences are none. The
    gazetteer is joined by name, before places come together by item.
    """
    sure = found.where((F.trim("name") != "") & (F.col("confidence") >= least)).select("id", "n", "name", "confidence")
    known = sure.join(gazetteer.select("name", "latitude", "longitude"), "name", "left")
    places = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("less"), "n", "name", "latitude", "longitude"))).alias("places"))
    there = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    first, both = F.get("places", F.lit(0)), lambda p: there(p["latitude"]) & there(p["longitude"])
    own = there(first["latitude"]) | there(first["longitude"])
    rest = places.select("id", first.alias("first"), own.alias("own"), F.filter(F.slice("places", 2, F.size("places")), both).alias("rest"))
    chosen = F.when(F.col("own"), F.col("first")).otherwise(F.get("rest", F.lit(0)))
    left = F.when(F.col("own"), F.col("rest")).otherwise(F.slice("rest", 2, F.size("rest")))
    return rest.select("id", chosen.alias("c"), F.transform(left, lambda p: p["name"]).alias("others"), (~F.col("own") & (F.size("rest") > 0)).alias("promoted")).select(
        "id", F.col("c.name").alias("location"), F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude"), "others", "promoted"
    )


def candidate_score(name: Column, label: Column, kind: Column, right_kind: Column, links: Column, by_label: Column) -> Column:
    """``candidate_points`` within 0 and 1."""
    return M.clamped(candidate_points(name, label, kind, right_kind, links, by_label), 0.0, 1.0)


def candidate_points(name: Column, label: Column, kind: Column, right_kind: Column, links: Column, by_label: Column) -> Column:
    """Points of a candidate by label, kind, links and the way it was found."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(label))
    return (
        F.when(a == b, 0.3).when(F.contains(b, a) | F.contains(a, b), 0.15).otherwise(0.0)
        + F.when(right_kind, 0.25).otherwise(-0.1) + F.when((kind == "Person") & ~right_kind, -0.2).otherwise(0.0)
        + F.when(links > 50, 0.1).when(links > 20, 0.05).otherwise(0.0) + F.when(by_label, 0.05).otherwise(0.0)
    )


def resolved(candidates: DataFrame, accept: float = 0.75, least: float = 0.4) -> DataFrame:
    """Of each entity's candidates the best, and what follows: people and little known entities are never accepted unseen."""
    score = candidate_score(*[F.col(c) for c in ("name", "label", "kind", "right_kind", "links", "by_label")])
    scored = candidates.withColumn("score", score)
    best = scored.groupBy("entity").agg(F.min(F.struct(-F.round("score", 9), -F.col("links"), "candidate", "score", "links", "kind")).alias("b"))
    sure = (F.col("b.kind") != "Person") & (F.col("b.links") >= 5) & (F.col("b.score") >= accept)
    verdict = F.when(sure, "accepted").when(F.col("b.score") >= least, "needs review").otherwise("below threshold")
    return best.select("entity", F.col("b.candidate").alias("candidate"), F.col("b.score").alias("score"), verdict.alias("verdict"))
