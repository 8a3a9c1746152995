"""The archive's items, derived from the test tables, and the source mappers that make items of landed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows that end "now" end here: queries take it as a parameter, so that they can be repeated.
AS_OF = "2024-01-27 00:00:00"

#: The sources, and the types that each may have.
SOURCES = ("pinboard", "github", "mastodon", "arena")
TYPES = {
    "pinboard": ("bookmark",),
    "github": ("gist", "repo", "issue", "pr", "release", "starred"),
    "mastodon": ("status",),
    "arena": ("block",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of items that come from tables beside the documents.
JOINED = ("summary", "url", "embedding")


def items(spark: SparkSession, sf_dir: str, *joined: str) -> DataFrame:
    """One row an item: documents, with fields that follow from the id and the text.

    ``joined``: those of JOINED that are wanted too. Only their tables (labels, pages, embeddings) are joined, since a
    left join that nobody asked for is one that no optimizer may leave out.
    """
    docs = table(spark, sf_dir, "documents")
    of = lambda name, key, *columns: table(spark, sf_dir, name).select(F.col(key).alias(f"{name}_id"), *columns)
    for column, name, right in (
        ("summary", "labels", lambda: of("labels", "doc_id", "quality")), ("url", "pages", lambda: of("pages", "page_id", "url")),
        ("embedding", "embeddings", lambda: of("embeddings", "vec_id", "embedding")),
    ):
        if column in joined:
            docs = docs.join(right(), F.col("doc_id") == F.col(f"{name}_id"), "left")
    extra = [e for c, e in (("summary", "CASE WHEN quality = 1 THEN substring(text, 1, 200) END AS summary"), ("url", "url"), ("embedding", "embedding")) if c in joined]
    return docs.selectExpr(
        "doc_id AS id",
        "concat(element_at(array('pinboard', 'github', 'mastodon', 'arena'), cast(doc_id % 4 + 1 AS int)), '-', doc_id) AS item_id",
        "element_at(array('pinboard', 'github', 'mastodon', 'arena'), cast(doc_id % 4 + 1 AS int)) AS source",
        """CASE WHEN doc_id % 97 = 0 THEN 'unknown' WHEN doc_id % 4 = 0 THEN 'bookmark' WHEN doc_id % 4 = 2 THEN 'status' WHEN doc_id % 4 = 3 THEN 'block'
            ELSE element_at(array('repo', 'gist', 'issue', 'pr', 'starred'), cast(doc_id div 4 % 5 + 1 AS int)) END AS type""",
        "substring(text, 1, 60) AS title",
        "text AS content",
        "array_distinct(regexp_extract_all(lower(text), '[a-z]{8,}', 0)) AS tags",
        "array_distinct(regexp_extract_all(lower(text), '[a-z]{12,}', 0)) AS concept_tags",
        "CASE WHEN doc_id % 7 <> 3 THEN 40.0e0 + (doc_id * 7919 % 1000) / 1000.0e0 END AS latitude",
        "CASE WHEN doc_id % 7 <> 3 AND doc_id % 83 <> 0 THEN -74.0e0 - (doc_id * 104729 % 1000) / 1000.0e0 END AS longitude",
        "CASE WHEN doc_id % 7 <> 3 THEN concat('Place ', doc_id % 37) END AS location",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 AS int), 0) AS published_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 AS int), 0) AS created_at",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(CASE WHEN doc_id % 53 = 0 THEN -1 ELSE doc_id % 11 END AS int), 0, cast(doc_id * 37 AS int), 0) AS updated_at",
        "doc_id % 3 <> 0 AS shared",
        "CASE WHEN doc_id % 4 = 0 AND doc_id % 7 <> 0 THEN concat('shots/', doc_id, '.png') END AS screenshot_url",
        "CASE WHEN doc_id % 41 = 0 THEN '{broken' WHEN doc_id % 43 = 0 THEN '{\"n\": 1, \"tags_synced\": true} tail' WHEN doc_id % 47 = 0 THEN '{\"n\": 1}}' ELSE concat('{\"n\": ', doc_id % 9, ', \"tags_synced\": ', CASE WHEN doc_id % 6 = 0 THEN 'true' ELSE 'false' END, CASE WHEN doc_id % 5 = 0 THEN ', \"extra\": \"keep\", \"n2\": 2.5, \"seen\": [1]' ELSE '' END, '}') END AS metadata",
        "CASE WHEN doc_id % 29 = 0 THEN concat('worker-', doc_id % 3) END AS instance_id",
        "CASE WHEN doc_id % 29 = 0 AND doc_id % 58 = 0 OR doc_id % 71 = 0 THEN timestamp_ntz'2024-01-26 00:00:00' - make_dt_interval(0, 0, cast(doc_id % 240 AS int), 0) END AS started_at",
        f"concat('[', array_join(array_compact(array({_RELATIONSHIPS})), ', '), ']') AS relationships",
        *extra,
    )


#: Four kinds of raw relationship: nested with types, flat, without names, and with a junk name.
_RELATIONSHIPS = """
CASE WHEN doc_id % 3 <> 2 THEN concat('{"source": {"name": "Org ', doc_id % 17, '", "type": "organization"}, "type": "',
    element_at(array('basedIn', 'FUNDED_BY', 'owns', 'builds', 'admires'), cast(doc_id % 5 + 1 AS int)), '", "target": {"name": "',
    CASE WHEN doc_id % 5 = 0 THEN concat('Place ', doc_id % 7) WHEN doc_id % 5 = 1 THEN concat('Fund ', doc_id % 3) ELSE concat('Tool ', doc_id % 11) END, '", "type": "',
    CASE WHEN doc_id % 5 = 0 THEN 'Location' WHEN doc_id % 5 = 1 THEN 'org' ELSE 'software' END, '"}, "confidence": ', (doc_id % 13) / 10.0e0, '}') END,
CASE WHEN doc_id % 3 = 1 THEN concat('{"source": "Person ', doc_id % 13, '", "target": "Org ', doc_id % 17, '", "relationship": "worksFor", "sourceType": "person", "targetType": "Organization"}') END,
CASE WHEN doc_id % 11 = 0 THEN '{"name": "Orphan"}' END,
CASE WHEN doc_id % 19 = 0 THEN '{"source": {"name": "read more", "type": "Person"}, "type": "LEADS", "target": {"name": "Org 1", "type": "Organization"}, "claim_mode": "reported"}' END
"""

_DUCK_RELATIONSHIPS = _RELATIONSHIPS.replace("element_at(array(", "list_extract(list_value(").replace("cast(doc_id % 5 + 1 AS int)", "doc_id % 5 + 1")

#: The same items for DuckDB, as the first common table of a query.
ITEMS_SQL = f"""items AS (
    SELECT d.doc_id AS id, src.source || '-' || d.doc_id AS item_id, src.source,
        CASE WHEN d.doc_id % 97 = 0 THEN 'unknown' WHEN d.doc_id % 4 = 0 THEN 'bookmark' WHEN d.doc_id % 4 = 2 THEN 'status' WHEN d.doc_id % 4 = 3 THEN 'block'
            ELSE list_extract(['repo', 'gist', 'issue', 'pr', 'starred'], d.doc_id // 4 % 5 + 1) END AS type,
        p.url, substring(text, 1, 60) AS title, text AS content, CASE WHEN quality = 1 THEN substring(text, 1, 200) END AS summary,
        {{tags4}} AS tags, {{tags8}} AS concept_tags,
        CASE WHEN d.doc_id % 7 <> 3 THEN 40.0e0 + (d.doc_id * 7919 % 1000) / 1000.0e0 END AS latitude,
        CASE WHEN d.doc_id % 7 <> 3 AND d.doc_id % 83 <> 0 THEN -74.0e0 - (d.doc_id * 104729 % 1000) / 1000.0e0 END AS longitude,
        CASE WHEN d.doc_id % 7 <> 3 THEN 'Place ' || (d.doc_id % 37) END AS location,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 37) AS published_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 37) AS created_at,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 37) + to_days((CASE WHEN d.doc_id % 53 = 0 THEN -1 ELSE d.doc_id % 11 END)::INTEGER) AS updated_at,
        e.embedding, d.doc_id % 3 <> 0 AS shared,
        CASE WHEN d.doc_id % 4 = 0 AND d.doc_id % 7 <> 0 THEN 'shots/' || d.doc_id || '.png' END AS screenshot_url,
        CASE WHEN d.doc_id % 41 = 0 THEN '{{{{broken' WHEN d.doc_id % 43 = 0 THEN '{{{{"n": 1, "tags_synced": true}}}} tail' WHEN d.doc_id % 47 = 0 THEN '{{{{"n": 1}}}}}}}}'
            ELSE '{{{{"n": ' || (d.doc_id % 9) || ', "tags_synced": ' || CASE WHEN d.doc_id % 6 = 0 THEN 'true' ELSE 'false' END || CASE WHEN d.doc_id % 5 = 0 THEN ', "extra": "keep", "n2": 2.5, "seen": [1]' ELSE '' END || '}}}}' END AS metadata,
        CASE WHEN d.doc_id % 29 = 0 THEN 'worker-' || (d.doc_id % 3) END AS instance_id,
        CASE WHEN d.doc_id % 29 = 0 AND d.doc_id % 58 = 0 OR d.doc_id % 71 = 0 THEN TIMESTAMP '2024-01-26 00:00:00' - to_minutes(d.doc_id % 240) END AS started_at,
        '[' || array_to_string(list_filter([{{rel}}], lambda r: r IS NOT NULL), ', ') || ']' AS relationships
    FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id,
    LATERAL (SELECT list_extract(['pinboard', 'github', 'mastodon', 'arena'], d.doc_id % 4 + 1) AS source) src
)""".replace("{{tags4}}", "{tags4}").replace("{{tags8}}", "{tags8}").replace("{{rel}}", "{rel}")
_FIRST = "list_transform(list_filter(list_zip({m}, range(len({m}))), lambda x: list_position({m}, x[1]) = x[2] + 1), lambda x: x[1])"
ITEMS_SQL = ITEMS_SQL.format(
    tags4=_FIRST.format(m="regexp_extract_all(lower(text), '[a-z]{8,}')"),
    tags8=_FIRST.format(m="regexp_extract_all(lower(text), '[a-z]{12,}')"),
    rel=_DUCK_RELATIONSHIPS.replace("doc_id", "d.doc_id").strip(),
)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (ascending, nulls first); null keys are a key like any other.

    An aggregate over ordered structs rather than a window: it combines on the map side, so that no task holds the rows
    of a hot key.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("f")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"f.{c}") for c in df.columns])


def newest(c: str) -> Column:
    """Ascending order of this puts the latest time, or the greatest number, first, and nulls last."""
    column = F.col(c)
    return F.struct(column.isNull().alias("none"), (-F.unix_micros(column.cast("timestamp"))).alias("less"))


def greatest(c: str) -> Column:
    return F.struct(F.col(c).isNull().alias("none"), (-F.col(c)).alias("less"))


def bookmarks(df: DataFrame) -> DataFrame:
    """Items of landed bookmarks: hash, href, description, extended, tags, time, shared, toread."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select(
        F.concat(F.lit("pinboard-"), "hash").alias("item_id"), F.lit("pinboard").alias("source"), F.lit("bookmark").alias("type"), F.col("href").alias("url"),
        F.col("description").alias("title"), F.coalesce(filled("extended"), filled("description"), F.lit("")).alias("content"),
        F.filter(F.split(F.coalesce("tags", F.lit("")), " "), lambda t: t != "").alias("tags"), (F.col("shared") == "yes").alias("shared"),
        (F.col("toread") == "yes").alias("to_read"), F.to_timestamp("time").alias("created_at"),
    )


def statuses(df: DataFrame) -> DataFrame:
    """Items of landed statuses: id, url, content (HTML), created_at, edited_at, tags (array of names), visibility."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    return df.select(
        F.concat(F.lit("mastodon-"), "id").alias("item_id"), F.lit("mastodon").alias("source"), F.lit("status").alias("type"), "url",
        F.when(F.length(plain) > 100, F.concat(F.substring(plain, 1, 100), F.lit("..."))).otherwise(plain).alias("title"), plain.alias("content"),
        F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower), F.array("visibility")))).alias("tags"),
        F.to_timestamp("created_at").alias("created_at"), F.to_timestamp(F.coalesce("edited_at", "created_at")).alias("updated_at"),
    )


def merged_fetch(recent: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """Recent rows and those of the cache that they don't replace."""
    return recent.unionByName(cache.join(recent.select(key), key, "left_anti"))


def best_extraction(attempts: DataFrame, least: int = 500) -> DataFrame:
    """Of each url's attempts (url, tier, content): the first tier of ``least`` characters, else the longest, earliest of equals."""
    n = F.length(F.coalesce("content", F.lit("")))
    return first_by(attempts, ["url"], (n < least), F.when(n >= least, F.col("tier")), -n, F.col("tier"))
