"""Records that arrive as JSON: places, entities of a knowledge base, linked data of pages, and columns filled from metadata.

JSON is parsed once into a variant; nested lists and objects are exploded by Spark, a row a member, and missing or
malformed members are nulls or no rows, never errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import linked_data


def member(v: Column, path: str, kind: str = "string") -> Column:
    """A member of a variant, null where it isn't there or is of no such kind."""
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY or what else a variant is; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def exploded(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep``, pos, key and value of each member of the array or object in a variant ``column``; no rows for other values."""
    fit = df.where(kind_of(F.col(column)).isin("ARRAY", "OBJECT"))
    return df.sparkSession.sql(f"SELECT {', '.join(f't.{c}' for c in keep)}, e.pos, e.key, e.value FROM {{rows}} t, LATERAL variant_explode(t.{column}) e", rows=fit)


def truthy_number(v: Column, path: str) -> Column:
    return F.nullif(member(v, path, "double"), F.lit(0.0))


def placed(items: DataFrame) -> DataFrame:
    """``items`` (location, latitude, longitude, and others) with locations that are JSON objects put right, and ``fixed``.

    Such a location becomes the name within it (null without one); a latitude or longitude is taken from it where the item
    has none, or 0. fixed: null for other locations, false for what begins like an object and is none, which stays.
    """
    v = T.parsed_json(F.col("location"))
    out = items.withColumn("_v", F.when(F.col("location").startswith("{"), v))
    good = F.col("_v").isNotNull()
    fill = lambda c: F.when(good & F.nullif(F.col(c), F.lit(0.0)).isNull(), F.coalesce(truthy_number(F.col("_v"), f"$.{c}"), F.col(c))).otherwise(F.col(c))
    return out.withColumns({
        "latitude": fill("latitude"), "longitude": fill("longitude"), "fixed": F.when(F.col("location").startswith("{"), good),
        "location": F.when(good, F.nullif(member(F.col("_v"), "$.location"), F.lit(""))).otherwise(F.col("location")),
    }).drop("_v")


def entities(replies: DataFrame, language: str = "en") -> DataFrame:
    """id, qid, label, description, aliases, instance_of, sitelinks of each entity that a knowledge base replied with.

    ``replies``: id, reply: JSON with ``entities``, an object of entities by id. Those marked missing are left out; claims
    without a value are. A reply that isn't JSON, or has no entities, gives no rows.
    """
    parsed = replies.select("id", F.try_variant_get(T.parsed_json(F.col("reply")), "$.entities", "variant").alias("all"))
    e = exploded(parsed, "all", "id").where(F.try_variant_get("value", "$.missing", "variant").isNull() & (kind_of(F.col("value")) == "OBJECT"))
    e = e.select("id", F.col("key").alias("qid"), "value")
    listed = lambda path: F.from_json(F.to_json(F.try_variant_get("value", path, "variant")), "array<variant>")
    texts = lambda path, inner: F.array_compact(F.transform(F.coalesce(listed(path), F.array().cast("array<variant>")), lambda x: member(x, inner)))
    links = F.from_json(F.to_json(F.try_variant_get("value", "$.sitelinks", "variant")), "map<string,variant>")
    return e.select(
        "id", "qid", F.coalesce(member(F.col("value"), f"$.labels.{language}.value"), F.lit("")).alias("label"),
        F.coalesce(member(F.col("value"), f"$.descriptions.{language}.value"), F.lit("")).alias("description"),
        texts(f"$.aliases.{language}", "$.value").alias("aliases"), F.filter(texts("$.claims.P31", "$.mainsnak.datavalue.value.id"), lambda q: q != "").alias("instance_of"),
        F.coalesce(F.size(links), F.lit(0)).cast("long").alias("sitelinks"),
    )


def linked_nodes(pages: DataFrame) -> DataFrame:
    """page_id, at, kind, name, locality, latitude, longitude of the nodes of pages' linked data that tell of a place.

    A script holds a node, a list of nodes, or a node whose @graph is a list of them. ``at``: script, place in the list (0
    for a single node) and place in the graph, joined by dots. An address may be a text or an object; numbers may be texts.
    """
    scripts = pages.select("page_id", F.posexplode(linked_data(F.col("html"))).alias("script", "json"))
    whole = scripts.select("page_id", F.col("script").cast("string").alias("at"), F.try_parse_json("json").alias("v"))

    def members(df: DataFrame, column: str) -> DataFrame:
        """The members of arrays, and what is no array itself as member 0."""
        many = exploded(df.where(kind_of(F.col(column)) == "ARRAY"), column, "page_id", "at")
        one = df.where(kind_of(F.col(column)) == "OBJECT").select("page_id", F.concat("at", F.lit(".0")).alias("at"), F.col(column).alias("v"))
        return many.select("page_id", F.concat("at", F.lit("."), F.col("pos")).alias("at"), F.col("value").alias("v")).unionByName(one)

    tops = members(whole, "v").where(kind_of(F.col("v")) == "OBJECT")
    graph = F.try_variant_get("v", "$['@graph']", "variant")
    nodes = members(tops.withColumn("g", F.when(kind_of(graph) == "ARRAY", graph).otherwise(F.col("v"))).drop("v"), "g")
    v = F.col("v")
    told = lambda key: F.coalesce(kind_of(F.try_variant_get(v, f"$.{key}", "variant")) != "VOID", F.lit(False))
    address = F.coalesce(member(v, "$.address.addressLocality"), member(v, "$.location.address.addressLocality"), F.when(kind_of(F.try_variant_get(v, "$.address", "variant")) == "STRING", member(v, "$.address")))
    return nodes.where((kind_of(v) == "OBJECT") & (told("address") | told("location") | told("geo"))).select(
        "page_id", "at", member(v, "$['@type']").alias("kind"), member(v, "$.name").alias("name"), address.alias("locality"),
        member(v, "$.geo.latitude", "double").alias("latitude"), member(v, "$.geo.longitude", "double").alias("longitude"),
    )


def backfilled(df: DataFrame, metadata: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with columns filled where they are null: ``fields`` names for each column the path in ``metadata`` and its type.

    Metadata that isn't JSON, and values that are of no such type, fill nothing.
    """
    v = T.parsed_json(F.col(metadata))
    return df.withColumns({c: F.coalesce(F.col(c), member(v, path, kind)) if c in df.columns else member(v, path, kind) for c, (path, kind) in fields.items()})
