"""Audits of items: completeness, integrity, scores and worklists. Each is one pass over the items."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import measures as M
from ..functions import text as T
from ..sources.items import AS_OF, ITEMS_SQL, TYPES, items
from .registry import registry

Q, SQL, query = registry()


_NOW = f"TIMESTAMP '{AS_OF}'"
FIELDS = ("url", "title", "content", "summary", "location", "latitude", "longitude", "embedding", "screenshot_url", "instance_id")


@query(
    "field_coverage_A22",
    f"WITH {ITEMS_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled, floor(1000.0::DOUBLE * count({f}) / count(*) + 0.5) / 10 AS percent FROM items" for f in FIELDS),
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = items(spark, sf_dir, "summary", "url", "embedding").agg(F.count(F.lit(1)).alias("total"), *[F.count(f).alias(f) for f in FIELDS])
    rows = one.unpivot(["total"], list(FIELDS), "field", "filled")
    return rows.select("field", "filled", M.half_up(100.0 * F.col("filled") / F.col("total"), 1).alias("percent"))


_ALLOWED = ", ".join(f"('{s}', '{t}')" for s, ts in TYPES.items() for t in ts)


@query("source_type_A6", f"WITH {ITEMS_SQL} SELECT source, type, count(*) AS n, (source, type) IN ({_ALLOWED}) AS valid FROM items GROUP BY source, type")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = reduce(or_, [(F.col("source") == s) & F.col("type").isin(*ts) for s, ts in TYPES.items()])
    return items(spark, sf_dir).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", valid)


@query("dup_title_A8", f"WITH {ITEMS_SQL} SELECT title, count(*) AS n, min(id) AS first_id FROM items WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = items(spark, sf_dir).where(F.col("title").isNotNull()).groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return same.where(F.col("n") > 1)


@query("vector_dims_G17", f"WITH {ITEMS_SQL} SELECT source, count(*) FILTER (WHERE embedding IS NULL) AS none, count(*) FILTER (WHERE len(embedding) = 64) AS good, count(*) FILTER (WHERE len(embedding) <> 64) AS bad FROM items GROUP BY source")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("embedding")
    return items(spark, sf_dir, "embedding").groupBy("source").agg(
        F.count_if(F.col("embedding").isNull()).alias("none"), F.count_if(F.col("embedding").isNotNull() & (n == 64)).alias("good"), F.count_if(F.col("embedding").isNotNull() & (n != 64)).alias("bad")
    )


@query("geo_xor_G17", f"WITH {ITEMS_SQL} SELECT id FROM items WHERE (latitude IS NULL) <> (longitude IS NULL) OR abs(latitude) > 90 OR abs(longitude) > 180")
def half_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("latitude").isNull() != F.col("longitude").isNull()) | F.coalesce((F.abs("latitude") > 90) | (F.abs("longitude") > 180), F.lit(False))
    return items(spark, sf_dir).where(bad).select("id")


@query(
    "dates_G17",
    f"""WITH {ITEMS_SQL}, d AS (SELECT id, concat_ws('|', CASE WHEN created_at > updated_at THEN 'created after updated' END, CASE WHEN published_at > {_NOW} THEN 'published in the future' END,
        CASE WHEN created_at > {_NOW} THEN 'created in the future' END) AS issues FROM items) SELECT id, issues FROM d WHERE issues <> ''""",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp_ntz")
    issues = F.concat_ws(
        "|", F.when(F.col("created_at") > F.col("updated_at"), "created after updated"), F.when(F.col("published_at") > now, "published in the future"),
        F.when(F.col("created_at") > now, "created in the future"),
    )
    return items(spark, sf_dir).select("id", issues.alias("issues")).where(F.col("issues") != "")


@query(
    "claims_G17",
    f"""WITH {ITEMS_SQL} SELECT id, CASE WHEN instance_id IS NULL THEN 'time without owner' WHEN started_at IS NULL THEN 'owner without time' ELSE 'stuck' END AS state FROM items
    WHERE (instance_id IS NULL) <> (started_at IS NULL) OR started_at < {_NOW} - INTERVAL 15 MINUTE""",
)
def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, time = F.col("instance_id"), F.col("started_at")
    stuck = F.coalesce(time < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 15 minutes"), F.lit(False))
    state = F.when(owner.isNull(), "time without owner").when(time.isNull(), "owner without time").otherwise("stuck")
    return items(spark, sf_dir).where((owner.isNull() != time.isNull()) | stuck).select("id", state.alias("state"))


@query("busy_owners_A7", f"WITH {ITEMS_SQL} SELECT instance_id, count(*) AS n FROM items WHERE instance_id IS NOT NULL GROUP BY 1 HAVING count(*) > 10")
def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 10)


_RATES = {"content": "length(content) > 10", "summary": "length(summary) > 10", "tags": "len(tags) > 0", "place": "location IS NOT NULL", "shot": "screenshot_url IS NOT NULL", "embedding": "embedding IS NOT NULL"}


@query(
    "post_run_rates_G18",
    f"WITH {ITEMS_SQL} SELECT source, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _RATES.items())
    + f""", count(*) FILTER (WHERE {_RATES["content"]}) >= floor(0.7::DOUBLE * count(*)) AND count(*) FILTER (WHERE {_RATES["summary"]}) >= floor(0.7::DOUBLE * count(*)) AND count(*) FILTER (WHERE {_RATES["embedding"]}) >= floor(0.7::DOUBLE * count(*)) AS passed
    FROM items WHERE updated_at >= {_NOW} - INTERVAL 7 DAY GROUP BY source""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = items(spark, sf_dir, "summary", "embedding").where(F.col("updated_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 7 days"))
    counted = recent.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c.replace("len(", "size("))).alias(k) for k, c in _RATES.items()])
    enough = F.floor(F.col("n") * 0.7)
    return counted.withColumn("passed", (F.col("content") >= enough) & (F.col("summary") >= enough) & (F.col("embedding") >= enough))


@query(
    "item_validator_G19",
    f"""WITH {ITEMS_SQL}, v AS (SELECT id, concat_ws('|', CASE WHEN url IS NULL THEN 'missing url' END, CASE WHEN title IS NULL THEN 'missing title' END, CASE WHEN content IS NULL THEN 'missing content' END,
        CASE WHEN (source, type) NOT IN ({_ALLOWED}) THEN 'invalid type' END, CASE WHEN NOT json_valid(metadata) THEN 'broken metadata' END,
        CASE WHEN created_at > updated_at THEN 'created after updated' END) AS errors FROM items) SELECT errors, count(*) AS n, min(id) AS first_id FROM v GROUP BY errors""",
)
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = reduce(or_, [(F.col("source") == s) & F.col("type").isin(*ts) for s, ts in TYPES.items()])
    errors = F.concat_ws(
        "|", *[F.when(F.col(c).isNull(), f"missing {c}") for c in ("url", "title", "content")], F.when(~valid, "invalid type"),
        F.when(~T.is_json(F.col("metadata")), "broken metadata"), F.when(F.col("created_at") > F.col("updated_at"), "created after updated"),
    )
    return items(spark, sf_dir, "url").groupBy(errors.alias("errors")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _mentions(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(F.lower(text), F.lit(p)) for p in parts])


def summary_score(summary: Column, content: Column) -> Column:
    """100 less what is wrong: avoided words, no structure, little in common with the first 100 words of the content."""
    first = F.slice(F.split(F.lower(content), r"\s+"), 1, 100)
    common = F.size(F.filter(F.split(F.lower(summary), r"\s+"), lambda w: (F.length(w) > 3) & F.array_contains(first, w)))
    avoided = reduce(add, [F.when(F.contains(F.lower(summary), F.lit(t)), 30).otherwise(0) for t in M.SUMMARY_AVOID])
    shaped = F.contains(summary, F.lit("•")) | F.contains(summary, F.lit("- ")) | F.contains(summary, F.lit("\n\n"))
    points = 100 - avoided - F.when(shaped, 0).otherwise(20) - F.when(common < 5, 25).otherwise(0)
    return F.when(F.coalesce(F.length(summary), F.lit(0)) < M.SUMMARY_LEAST, 0).otherwise(points)


def tags_score(tags: Column) -> Column:
    generic = F.size(F.filter(tags, lambda t: F.lower(t).isin(*M.TAGS_AVOID)))
    specific = F.size(F.filter(tags, lambda t: (F.length(t) > 3) & ~F.lower(t).isin(*M.TAGS_AVOID)))
    return F.when(F.size(tags) < M.TAGS_LEAST, 0).otherwise(100 - 15 * generic - F.when(specific < 2, 20).otherwise(0))


def place_score(location: Column, latitude: Column, longitude: Column, content: Column) -> Column:
    none = F.coalesce(F.lower(location).isin(*M.PLACE_AVOID), F.lit(True))
    halves = F.when((F.coalesce(latitude, F.lit(0.0)) == 0) | (F.coalesce(longitude, F.lit(0.0)) == 0), 20).otherwise(0)
    return F.when(none, F.when(F.coalesce(_mentions(content, M.PLACE_WORDS), F.lit(False)), 0).otherwise(100)).otherwise(100 - halves - F.when(F.length(location) < 3, 30).otherwise(0))


def relationships_score(relationships: Column) -> Column:
    """Of a JSON array: 50 without an entry; else 100, less 30 for each malformed entry and 40 if none has two names of 3 letters."""
    part = lambda r, path: F.coalesce(F.get_json_object(r, f"$.{path}"), F.lit(""))
    entries = F.from_json(relationships, "array<string>")
    malformed = F.size(F.filter(entries, lambda r: reduce(or_, [part(r, p) == "" for p in M.RELATIONSHIP_PARTS])))
    named = F.exists(entries, lambda r: (F.length(part(r, "source.name")) > 2) & (F.length(part(r, "target.name")) > 2))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) <= 0, 50).otherwise(100 - 30 * malformed - F.when(named, 0).otherwise(40))


def finance_score(content: Column) -> Column:
    """Of an item without financial analysis: 30 with a trigger word in its content, else 100."""
    return F.when(_mentions(content, M.FINANCE_WORDS), 30).otherwise(100)


_AVOID = " - ".join(f"CASE WHEN contains(lower(summary), '{t}') THEN 30 ELSE 0 END" for t in M.SUMMARY_AVOID)
_COMMON = r"len(list_filter(regexp_split_to_array(lower(summary), '\s+'), lambda w: length(w) > 3 AND list_contains(list_slice(regexp_split_to_array(lower(content), '\s+'), 1, 100), w)))"
_SUMMARY = f"""CASE WHEN coalesce(length(summary), 0) < 150 THEN 0 ELSE 100 - {_AVOID} - CASE WHEN contains(summary, '•') OR contains(summary, '- ') OR contains(summary, chr(10) || chr(10)) THEN 0 ELSE 20 END
    - CASE WHEN {_COMMON} < 5 THEN 25 ELSE 0 END END"""
_TAGSET = ", ".join(f"'{t}'" for t in M.TAGS_AVOID)
_TAGS = f"""CASE WHEN len(tags) < {M.TAGS_LEAST} THEN 0 ELSE 100 - 15 * len(list_filter(tags, lambda t: lower(t) IN ({_TAGSET})))
    - CASE WHEN len(list_filter(tags, lambda t: length(t) > 3 AND lower(t) NOT IN ({_TAGSET}))) < 2 THEN 20 ELSE 0 END END"""
_PLACE = f"""CASE WHEN location IS NULL OR lower(location) IN ('unknown', 'n/a', 'none', '') THEN CASE WHEN {" OR ".join(f"contains(lower(content), '{w}')" for w in M.PLACE_WORDS)} THEN 0 ELSE 100 END
    ELSE 100 - CASE WHEN coalesce(latitude, 0) = 0 OR coalesce(longitude, 0) = 0 THEN 20 ELSE 0 END - CASE WHEN length(location) < 3 THEN 30 ELSE 0 END END"""


@query(
    "audit_scores_G16",
    f"""WITH {ITEMS_SQL}, s AS (SELECT id, ({_SUMMARY})::INTEGER AS summary_score, ({_TAGS})::INTEGER AS tags_score, ({_PLACE})::INTEGER AS place_score FROM items)
    SELECT *, CASE WHEN (summary_score + tags_score + place_score) / 3.0::DOUBLE >= 90 THEN 'excellent' WHEN (summary_score + tags_score + place_score) / 3.0::DOUBLE >= 75 THEN 'good'
        WHEN (summary_score + tags_score + place_score) / 3.0::DOUBLE >= 50 THEN 'needs improvement' ELSE 'failed' END AS category FROM s""".replace("< 150 THEN", f"< {M.SUMMARY_LEAST} THEN"),
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = items(spark, sf_dir, "summary").select(
        "id", summary_score(F.col("summary"), F.col("content")).alias("summary_score"), tags_score(F.col("tags")).alias("tags_score"),
        place_score(F.col("location"), F.col("latitude"), F.col("longitude"), F.col("content")).alias("place_score"),
    )
    mean = (F.col("summary_score") + F.col("tags_score") + F.col("place_score")) / 3.0
    return scored.withColumn("category", F.when(mean >= 90, "excellent").when(mean >= 75, "good").when(mean >= 50, "needs improvement").otherwise("failed"))


_PARTS = " OR ".join(f"coalesce(json_extract_string(r, '$.{p}'), '') = ''" for p in M.RELATIONSHIP_PARTS)
_NAMED = " AND ".join(f"length(coalesce(json_extract_string(r, '$.{p}.name'), '')) > 2" for p in ("source", "target"))
_RELATED = f"""CASE WHEN coalesce(len(relationships::JSON::JSON[]), 0) = 0 THEN 50 ELSE 100 - 30 * len(list_filter(relationships::JSON::JSON[], lambda r: {_PARTS}))
    - CASE WHEN len(list_filter(relationships::JSON::JSON[], lambda r: {_NAMED})) = 0 THEN 40 ELSE 0 END END"""
_FINANCE = f"""CASE WHEN {" OR ".join(f"contains(lower(content), '{w}')" for w in M.FINANCE_WORDS)} THEN 30 ELSE 100 END"""


@query(
    "audit_five_scores_M9",
    f"""WITH {ITEMS_SQL}, s AS (SELECT id, ({_SUMMARY})::INTEGER AS summary_score, ({_TAGS})::INTEGER AS tags_score, ({_RELATED})::INTEGER AS relationships_score,
        ({_PLACE})::INTEGER AS place_score, ({_FINANCE})::INTEGER AS finance_score FROM items),
    m AS (SELECT *, (summary_score + tags_score + relationships_score + place_score + finance_score) / 5.0::DOUBLE AS mean FROM s)
    SELECT *, CASE WHEN mean >= 90 THEN 'excellent' WHEN mean >= 75 THEN 'good' WHEN mean >= 50 THEN 'needs improvement' ELSE 'failed' END AS category FROM m""".replace("< 150 THEN", f"< {M.SUMMARY_LEAST} THEN"),
)
def audit_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = {
        "summary_score": summary_score(F.col("summary"), F.col("content")), "tags_score": tags_score(F.col("tags")), "relationships_score": relationships_score(F.col("relationships")),
        "place_score": place_score(F.col("location"), F.col("latitude"), F.col("longitude"), F.col("content")), "finance_score": finance_score(F.col("content")),
    }
    scored = items(spark, sf_dir, "summary").select("id", *[c.alias(k) for k, c in five.items()])
    mean = reduce(add, [F.col(k) for k in five]) / F.lit(5.0)
    return scored.withColumn("mean", mean).withColumn("category", F.when(F.col("mean") >= 90, "excellent").when(F.col("mean") >= 75, "good").when(F.col("mean") >= 50, "needs improvement").otherwise("failed"))


_ISSUES = {
    "shot": "screenshot_url IS NULL AND url IS NOT NULL", "summary": "coalesce(trim(summary), '') = ''", "embedding": "embedding IS NULL", "tags": "tags IS NULL OR {size}(tags) = 0", "url": "url IS NULL",
    "old": f"created_at < {_NOW.replace('TIMESTAMP ', 'TIMESTAMP ')} - INTERVAL 14 DAY AND (summary IS NULL OR embedding IS NULL)",
}


@query("diagnose_G15", f"WITH {ITEMS_SQL} SELECT source, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c.format(size='len')}) AS {k}_missing" for k, c in _ISSUES.items()) + ", count(*) FILTER (WHERE " + " OR ".join(f"({c.format(size='len')})" for c in _ISSUES.values()) + ") AS ill FROM items GROUP BY source")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {k: F.expr(c.format(size="size").replace("TIMESTAMP '", "timestamp_ntz'").replace("INTERVAL 14 DAY", "INTERVAL 14 DAYS")) for k, c in _ISSUES.items()}
    return items(spark, sf_dir, "summary", "url", "embedding").groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(f"{k}_missing") for k, t in tests.items()], F.count_if(reduce(or_, tests.values())).alias("ill")
    )


_SCORE = f"""(CASE WHEN year(created_at) >= 2024 THEN 30 WHEN year(created_at) >= 2023 THEN 25 WHEN year(created_at) >= 2022 THEN 20 WHEN year(created_at) >= 2021 THEN 15 WHEN year(created_at) >= 2020 THEN 10 WHEN year(created_at) >= 2018 THEN 5 ELSE 0 END
    + CASE WHEN length(content) > 2000 THEN 20 WHEN length(content) > 1000 THEN 15 WHEN length(content) > 500 THEN 10 WHEN length(content) > 100 THEN 5 ELSE 0 END
    + CASE WHEN len(tags) >= 3 THEN 15 WHEN len(tags) >= 2 THEN 10 WHEN len(tags) >= 1 THEN 5 ELSE 0 END
    + CASE WHEN len(list_filter(tags, lambda t: {" OR ".join(f"contains(lower(t), '{x}')" for x in M.SPECIAL_TAGS)})) > 0 THEN 20 ELSE 0 END
    + CASE WHEN {" OR ".join(f"contains(url, '{x}')" for x in M.QUALITY_DOMAINS)} THEN 15 ELSE 0 END)::INTEGER"""
SCORED = f"WITH {ITEMS_SQL}, scored AS (SELECT id, created_at, {_SCORE} AS score FROM items)"
_TIER = "CASE WHEN score >= 70 THEN 'S' WHEN score >= 50 THEN 'A' WHEN score >= 30 THEN 'B' WHEN score >= 10 THEN 'C' ELSE 'D' END"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "url").select("id", "created_at", M.backlog_score(F.col("created_at"), F.col("content"), F.col("tags"), F.col("url")).alias("score"))


@query("backlog_score_M6", f"{SCORED} SELECT id, score FROM scored")
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "score")


@query("tiers_A25", f"{SCORED} SELECT {_TIER} AS tier, count(*) AS n, min(score) AS low, max(score) AS high FROM scored GROUP BY 1")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(M.tier(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("budget_A26", f"{SCORED}, best AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 100) SELECT min(score) AS least_score, strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day, count(*) * 35 AS seconds FROM best")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored(spark, sf_dir).orderBy(F.col("score").desc(), "id").limit(100)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return best.agg(F.min("score").alias("least_score"), day(F.min("created_at")).alias("first_day"), day(F.max("created_at")).alias("last_day"), (F.count(F.lit(1)) * 35).alias("seconds"))


@query(
    "repair_worklist_G30",
    f"""WITH {ITEMS_SQL}, r AS (SELECT id, round(greatest(0.0::DOUBLE, 100 - epoch({_NOW} - created_at)::BIGINT / 86400.0::DOUBLE) + CASE WHEN coalesce(url, '') <> '' THEN 50 ELSE 0 END
        + CASE source WHEN 'pinboard' THEN 30 WHEN 'arena' THEN 20 WHEN 'github' THEN 15 WHEN 'mastodon' THEN 10 ELSE 0 END + CASE WHEN length(title) > 10 THEN 10 ELSE 0 END + CASE WHEN length(content) > 100 THEN 10 ELSE 0 END, 6) AS priority
        FROM items WHERE coalesce(trim(summary), '') = '' OR embedding IS NULL) SELECT id, priority FROM r ORDER BY priority DESC, id LIMIT 100""",
)
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_items = items(spark, sf_dir, "summary", "url", "embedding").where((F.coalesce(F.trim("summary"), F.lit("")) == "") | F.col("embedding").isNull())
    score = M.repair_score(F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz"), F.col("url"), F.col("source"), F.col("title"), F.col("content"))
    return open_items.select("id", F.round(score, 6).alias("priority")).orderBy(F.col("priority").desc(), "id").limit(100)


@query("tag_coverage_Q2", f"WITH {ITEMS_SQL} SELECT source, count(*) FILTER (WHERE len(tags) > 0) AS tagged, round(avg(len(tags)), 6) AS mean_tags, count(*) FILTER (WHERE len(concept_tags) > 0) AS with_concepts FROM items GROUP BY source")
def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("source").agg(
        F.count_if(F.size("tags") > 0).alias("tagged"), F.round(F.avg(F.size("tags")), 6).alias("mean_tags"), F.count_if(F.size("concept_tags") > 0).alias("with_concepts")
    )


@query(
    "review_batch_W2",
    f"""WITH {ITEMS_SQL}, b AS (SELECT id, source, row_number() OVER (PARTITION BY source, type ORDER BY updated_at DESC, id DESC) AS k, type FROM items WHERE length(content) >= 180)
    SELECT id, source, type FROM b WHERE k <= 4""",
)
def review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    thick = items(spark, sf_dir).where(F.length("content") >= 180)
    k = F.row_number().over(W.partitionBy("source", "type").orderBy(F.col("updated_at").desc(), F.col("id").desc()))
    return thick.withColumn("k", k).where(F.col("k") <= 4).select("id", "source", "type")


#: Tags that say nothing.
USELESS_TAGS = ("pinboard", "bookmark", "link", "url", "web", "website", "page", "bookmarks")
_USELESS = ", ".join(f"'{t}'" for t in USELESS_TAGS)


@query(
    "tag_sync_plan_G24",
    rf"""WITH {ITEMS_SQL}, t AS (
        SELECT id, list_filter(tags, lambda t: lower(t) NOT IN ({_USELESS})) AS made,
            [list_extract(tags, 1), 'year' || (2016 + id % 12), 'link'] AS held FROM items WHERE source = 'pinboard' AND len(tags) > 0),
    k AS (SELECT *, list_filter(held, lambda t: NOT (coalesce(try_cast(nullif(regexp_extract(t, '([0-9]{{{{4}}}})', 1), '') AS INTEGER), 9999) BETWEEN 1901 AND 2022)) AS kept FROM t)
    SELECT id, len(held) - len(kept) AS outdated, len(list_filter(made, lambda t: NOT list_contains(held, t))) AS added, len(list_distinct(list_concat(kept, made))) AS merged FROM k""".replace("{{4}}", "{4}"),
)
def tag_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).where((F.col("source") == "pinboard") & (F.size("tags") > 0))
    held = F.array(F.get("tags", 0), F.concat(F.lit("year"), (2016 + F.col("id") % 12).cast("string")), F.lit("link"))
    t = i.select("id", F.filter("tags", lambda t: ~F.lower(t).isin(*USELESS_TAGS)).alias("made"), held.alias("held"))
    year = lambda t: F.coalesce(F.regexp_extract(t, "([0-9]{4})", 1).try_cast("int"), F.lit(9999))
    kept = t.withColumn("kept", F.filter("held", lambda t: ~year(t).between(1901, 2022)))
    return kept.select(
        "id", (F.size("held") - F.size("kept")).alias("outdated"), F.size(F.filter("made", lambda t: ~F.array_contains("held", t))).alias("added"),
        F.size(F.array_distinct(F.concat("kept", "made"))).alias("merged"),
    )


#: Pages that are held under one address, which the test tables lack.
_SAME = "CASE WHEN id % 10 = 0 THEN 'https://example.org/' || (id % 70) ELSE regexp_replace(url, '[?#].*$', '') END"


@query("dup_url_A8", f"WITH {ITEMS_SQL} SELECT url, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_SAME} AS url FROM items) u WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1")
def duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = items(spark, sf_dir, "url").select("id", F.expr(_SAME).alias("url")).where(F.col("url").isNotNull())
    return urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where(F.col("n") > 1)


#: Issues of an item by kind; screenshots are asked of all but most of one source, addresses of all but notes.
_KINDS = _ISSUES | {
    "shot": "screenshot_url IS NULL AND url IS NOT NULL AND (source <> 'github' OR type = 'repository')", "url": "url IS NULL AND type NOT IN ('note', 'thought')", "metadata": "metadata IS NOT NULL AND NOT {json}",
}
_HAS = {"summaries": "coalesce(trim(summary), '') <> ''", "embeddings": "embedding IS NOT NULL"}


@query(
    "diagnose_health_G15",
    f"""WITH {ITEMS_SQL}, c AS (SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS total, """
    + ", ".join(f"count(*) FILTER (WHERE {c.format(size='len', json='json_valid(metadata)')}) AS {k}_issues" for k, c in _KINDS.items())
    + ", count(*) FILTER (WHERE " + " OR ".join(f"({c.format(size='len', json='json_valid(metadata)')})" for c in _KINDS.values()) + ") AS ill, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _HAS.items())
    + """ FROM items GROUP BY GROUPING SETS ((source), ()))
    SELECT * EXCLUDE (summaries, embeddings), floor(100.0::DOUBLE * (total - ill) / total + 0.5)::BIGINT AS healthy_percent, floor(100.0::DOUBLE * (summaries + embeddings) / (2 * total) + 0.5)::BIGINT AS filled_percent FROM c WHERE total > 0""",
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, and of all, how many items have which issues, and the percents without any and with what models make."""
    found = items(spark, sf_dir, "summary", "url", "embedding").withColumn("is_json", T.is_json(F.col("metadata")))
    tests = {k: F.expr(c.format(size="size", json="is_json").replace("TIMESTAMP '", "timestamp_ntz'").replace("INTERVAL 14 DAY", "INTERVAL 14 DAYS")) for k, c in _KINDS.items()}
    counted = found.groupingSets([[F.col("source")], []], F.col("source")).agg(
        F.grouping("source").alias("whole"), F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(f"{k}_issues") for k, t in tests.items()], F.count_if(reduce(or_, tests.values())).alias("ill"),
        *[F.count_if(F.expr(c)).alias(k) for k, c in _HAS.items()],
    ).where(F.col("total") > 0)
    percent = lambda n, of: F.floor(100.0 * n / of + 0.5)
    return counted.select(
        F.when(F.col("whole") == 1, "all").otherwise(F.col("source")).alias("source"), "total", *[f"{k}_issues" for k in tests], "ill",
        percent(F.col("total") - F.col("ill"), F.col("total")).alias("healthy_percent"), percent(F.col("summaries") + F.col("embeddings"), 2 * F.col("total")).alias("filled_percent"),
    )


#: Fields that an item has to have.
REQUIRED = ("item_id", "source", "type", "url", "title", "content", "published_at", "created_at", "updated_at", "shared", "tags", "metadata")
_TYPES = ", ".join(f"'{t}'" for ts in TYPES.values() for t in ts)
#: Faults that the test tables lack, in words that Spark and DuckDB share.
_PLANTED = {
    "url": "CASE WHEN id % 17 = 0 THEN 'example.org/' || id ELSE url END", "location": "CASE WHEN id % 31 <> 0 THEN location END", "source": "CASE WHEN id % 89 = 0 THEN 'rss' ELSE source END",
    "screenshot_url": "CASE WHEN id % 3 = 0 THEN 'https://img.example.org/screenshots/' || id WHEN id % 3 = 1 THEN 'http://img.example.org/screenshots/' || id ELSE screenshot_url END",
    "metadata": "CASE WHEN id % 37 = 0 THEN '7' WHEN id % 59 <> 0 THEN metadata END",
}
_SHAPE = " OR ".join(f"coalesce(json_extract_string(r, '$.{p}'), '') = ''" for p in M.RELATIONSHIP_PARTS)


def item_errors(valid_sources: tuple[str, ...] = tuple(TYPES), shown: tuple[str, ...] = ("pinboard",)) -> Column:
    """What is wrong with an item, in this order: missing fields, metadata, source, type, address, screenshot, relationships.

    Sources in ``shown`` have screenshots, whose addresses are checked. Relationships are a JSON array; each malformed one
    is named by its place, from 0.
    """
    metadata = F.col("metadata")
    part = lambda r, path: F.coalesce(F.get_json_object(r, f"$.{path}"), F.lit(""))
    malformed = lambda r: reduce(or_, [part(r, p) == "" for p in M.RELATIONSHIP_PARTS])
    entries = F.coalesce(F.from_json("relationships", "array<string>"), F.array().cast("array<string>"))
    shapes = F.transform(entries, lambda r, i: F.when(malformed(r), F.concat(F.lit("Invalid relationship structure at index "), i.cast("string"))))
    shot = F.col("source").isin(*shown) & (F.coalesce("screenshot_url", F.lit("")) != "")
    single = [
        *[F.when(F.col(c).isNull(), f"Missing required field: {c}") for c in REQUIRED],
        F.when(~(T.is_json(metadata) & metadata.rlike(r"^\s*[{\[]")), "metadata must be type object"),
        F.when(~F.coalesce(F.col("source").isin(*valid_sources), F.lit(False)), F.concat(F.lit("Invalid source: "), F.coalesce("source", F.lit("")))),
        F.when(~F.coalesce(F.col("type").isin(*[t for ts in TYPES.values() for t in ts]), F.lit(False)), F.concat(F.lit("Invalid type: "), F.coalesce("type", F.lit("")))),
        F.when(~F.coalesce(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+"), F.lit(False)), "Invalid URL format"),
        F.when(shot & ~F.startswith("screenshot_url", F.lit("https://")), "Screenshot URL must be HTTPS"),
        F.when(shot & ~F.contains(F.col("screenshot_url"), F.lit("/screenshots/")), "Invalid screenshot URL path format"),
    ]
    return F.array_compact(F.concat(F.array(*single), shapes))


def item_warnings() -> Column:
    placed = (F.coalesce("latitude", F.lit(0.0)) != 0) | (F.coalesce("longitude", F.lit(0.0)) != 0)
    return F.array_compact(F.array(F.when((F.coalesce("location", F.lit("")) == "") & placed, "Location missing but coordinates present")))


@query(
    "item_errors_G19",
    rf"""WITH {ITEMS_SQL}, i AS (SELECT * REPLACE ({", ".join(f"{e} AS {c}" for c, e in _PLANTED.items())}) FROM items),
    v AS (SELECT id, list_filter(list_concat([{", ".join(f"CASE WHEN {c} IS NULL THEN 'Missing required field: {c}' END" for c in REQUIRED)},
        CASE WHEN NOT (json_valid(metadata) AND regexp_matches(metadata, '^\s*[{{\[]')) THEN 'metadata must be type object' END,
        CASE WHEN source NOT IN ({", ".join(f"'{s}'" for s in TYPES)}) THEN 'Invalid source: ' || source END, CASE WHEN type NOT IN ({_TYPES}) THEN 'Invalid type: ' || type END,
        CASE WHEN NOT coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+'), FALSE) THEN 'Invalid URL format' END,
        CASE WHEN source = 'pinboard' AND screenshot_url NOT LIKE 'https://%' THEN 'Screenshot URL must be HTTPS' END, CASE WHEN source = 'pinboard' AND NOT contains(screenshot_url, '/screenshots/') THEN 'Invalid screenshot URL path format' END],
        list_transform(relationships::JSON::JSON[], lambda r, n: CASE WHEN {_SHAPE} THEN 'Invalid relationship structure at index ' || (n - 1) END)), lambda e: e IS NOT NULL) AS errors,
        CASE WHEN location IS NULL AND (coalesce(latitude, 0) <> 0 OR coalesce(longitude, 0) <> 0) THEN ['Location missing but coordinates present'] ELSE [] END AS warnings FROM i)
    SELECT id, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings, len(errors) = 0 AS passed FROM v""",
)
def item_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = items(spark, sf_dir, "url").withColumns({c: F.expr(e) for c, e in _PLANTED.items()})
    told = planted.select("id", item_errors().alias("errors"), item_warnings().alias("warnings"))
    return told.select("id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), (F.size("errors") == 0).alias("passed"))
