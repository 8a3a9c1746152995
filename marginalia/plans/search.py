"""Searches and statistics over all items."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..sources.items import AS_OF, ITEMS_SQL, items
from .registry import registry
from .related import far

Q, SQL, query = registry()


def matching(df: DataFrame, words: str, *columns: str):
    """Rows with ``words`` in any of ``columns``, whatever the case; wildcards in them are plain signs."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False))
    return df.where(out)


@query("search_ilike_P8", f"WITH {ITEMS_SQL} SELECT id, title, source FROM items WHERE contains(lower(title), 'tion') OR contains(lower(coalesce(summary, '')), 'tion') OR contains(lower(content), 'tion') ORDER BY created_at DESC, id DESC LIMIT 50")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching(items(spark, sf_dir, "summary"), "tion", "title", "summary", "content")
    return found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50).select("id", "title", "source")


@query(
    "search_all_terms_P14",
    rf"WITH {ITEMS_SQL} SELECT id, created_at FROM items WHERE list_contains(regexp_split_to_array(lower(content), '[^a-z0-9]+'), 'the') AND list_contains(regexp_split_to_array(lower(content), '[^a-z0-9]+'), 'that') ORDER BY created_at DESC, id LIMIT 20",
)
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("content"), "[^a-z0-9]+")
    found = items(spark, sf_dir).where(F.array_contains(words, "the") & F.array_contains(words, "that"))
    return found.orderBy(F.col("created_at").desc(), "id").limit(20).select("id", "created_at")


@query("tag_contains_P15", f"WITH {ITEMS_SQL} SELECT id, array_to_string(tags, '|') AS tags FROM items WHERE contains(lower(title), 'ention') OR len(list_filter(tags, lambda t: contains(t, 'ention'))) > 0 ORDER BY id LIMIT 20")
def search_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("ention")) | F.exists("tags", lambda t: F.contains(t, F.lit("ention"))))
    return found.orderBy("id").limit(20).select("id", F.array_join("tags", "|").alias("tags"))


@query(
    "search_items_G28",
    f"""WITH {ITEMS_SQL} SELECT i.id, round({far("c", "i")} * {M.KM_PER_MILE}::DOUBLE, 6) AS km FROM items i, (SELECT 40.5::DOUBLE AS latitude, -74.5::DOUBLE AS longitude) c
    WHERE source IN ('github', 'arena') AND location IS NOT NULL AND created_at >= TIMESTAMP '2024-01-02' AND {far("c", "i")} * {M.KM_PER_MILE}::DOUBLE <= 40""",
)
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = M.haversine_miles(F.lit(40.5), F.lit(-74.5), F.col("latitude"), F.col("longitude")) * M.KM_PER_MILE
    found = items(spark, sf_dir).where(F.col("source").isin("github", "arena") & F.col("location").isNotNull() & (F.col("created_at") >= F.lit("2024-01-02").cast("timestamp_ntz")))
    return found.select("id", km.alias("km")).where(F.col("km") <= 40).select("id", F.round("km", 6).alias("km"))


@query(
    "stats_api_G26",
    f"""WITH {ITEMS_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE created_at >= date_trunc('day', TIMESTAMP '{AS_OF}') - INTERVAL 1 DAY) AS last_day,
    count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_week, count(DISTINCT type) AS types FROM items GROUP BY source""",
)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return items(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("created_at") >= F.date_trunc("day", as_of) - F.expr("interval 1 day")).alias("last_day"),
        F.count_if(F.col("created_at") >= as_of - F.expr("interval 7 days")).alias("last_week"), F.count_distinct("type").alias("types"),
    )


@query("daily_rollup_A9", f"WITH {ITEMS_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT source) AS sources FROM items GROUP BY 1")
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("json_flag_P10", f"WITH {ITEMS_SQL} SELECT id FROM items WHERE json_valid(metadata) AND json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.tags_synced') = 'true'")
def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.try_variant_get(T.parsed_json(F.col("metadata")), "$.tags_synced", "boolean")
    return items(spark, sf_dir).where(flag).select("id")


@query("broken_json_N7", f"WITH {ITEMS_SQL} SELECT source, count(*) AS broken FROM items WHERE metadata IS NOT NULL AND NOT json_valid(metadata) GROUP BY source")
def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(~T.is_json(F.col("metadata"))).groupBy("source").agg(F.count(F.lit(1)).alias("broken"))


@query("truthy_concat_P22", f"WITH {ITEMS_SQL} SELECT id, length(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(summary, ''), nullif(location, ''), nullif(url, ''))) AS chars FROM items")
def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.nullif(F.col(c), F.lit("")) for c in ("title", "summary", "location", "url")]
    return items(spark, sf_dir, "summary", "url").select("id", F.length(F.concat_ws("\n\n", *fields)).cast("long").alias("chars"))


@query("prefix_P9", f"WITH {ITEMS_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE metadata LIKE '{{%') AS braced FROM items WHERE item_id LIKE 'pinboard-%' OR location LIKE 'Place 1%' GROUP BY source")
def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir).where(F.startswith("item_id", F.lit("pinboard-")) | F.coalesce(F.startswith("location", F.lit("Place 1")), F.lit(False)))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("metadata", F.lit("{"))).alias("braced"))


def truthy(df: DataFrame, c: str) -> Column:
    """Whether a value counts as one: no null, no empty string, no false, no zero and no NaN; an array or struct always does."""
    kind = df.schema[c].dataType.typeName()
    column = F.col(c)
    if kind in ("float", "double"):
        return F.coalesce((column != 0) & ~F.isnan(column), F.lit(False))
    there = column != "" if kind == "string" else column if kind == "boolean" else column != 0 if kind in ("byte", "short", "integer", "long", "decimal") else column.isNotNull()
    return F.coalesce(there, F.lit(False))


_TRUTHY = {
    "title": "coalesce(title, '') <> ''", "summary": "coalesce(summary, '') <> ''", "shared": "coalesce(shared, FALSE)", "latitude": "latitude IS NOT NULL AND latitude <> 0 AND NOT isnan(latitude)",
    "n": "coalesce(n, 0) <> 0", "tags": "tags IS NOT NULL", "created_at": "created_at IS NOT NULL",
}
_VALUES = {"n": "id % 9", "latitude": "CASE WHEN id % 23 = 0 THEN {nan} WHEN id % 23 = 1 THEN 0.0e0 ELSE latitude END"}


@query(
    "truthy_P16",
    f"""WITH {ITEMS_SQL}, v AS (SELECT * REPLACE ({_VALUES["latitude"].format(nan="'NaN'::DOUBLE")} AS latitude), {_VALUES["n"]} AS n FROM items)
    SELECT id, concat_ws('|', {", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _TRUTHY.items())}) AS there FROM v""",
)
def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = items(spark, sf_dir, "summary").withColumns({c: F.expr(e.format(nan="double('NaN')")) for c, e in _VALUES.items()})
    return v.select("id", F.concat_ws("|", *[F.when(truthy(v, c), c) for c in _TRUTHY]).alias("there"))


@query(
    "search_terms_or_short_id_P14",
    rf"""WITH {ITEMS_SQL}, s AS (SELECT id, created_at, string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[^\pL\pN]+') AS words, 'x' || (id % 97) AS short_id FROM items)
    SELECT DISTINCT id, created_at FROM s WHERE (list_contains(words, 'the') AND list_contains(words, 'x50')) OR (list_contains(words, 'tion') AND list_contains(words, 'the')) OR short_id = 'x50' ORDER BY created_at DESC, id LIMIT 20""",
)
def search_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).select("id", "created_at", F.concat_ws(" ", "title", "content").alias("text"), F.concat(F.lit("x"), (F.col("id") % 97).cast("string")).alias("short_id"))
    found = s.where(all_terms(F.col("text"), "the x50!") | all_terms(F.col("text"), "tion, the") | all_terms(F.col("short_id"), "x50"))
    return found.select("id", "created_at").distinct().orderBy(F.col("created_at").desc(), "id").limit(20)


def all_terms(text: Column, asked: str) -> Column:
    """Whether ``text`` has all words of ``asked``, in any case; signs in ``asked`` that no word has go. Without words nothing is found."""
    words = re.sub(r"[^\w\s]", "", asked, flags=re.ASCII).lower().split()
    have = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.coalesce(reduce(and_, [F.array_contains(have, w) for w in words]), F.lit(False)) if words else F.lit(False)


#: Members of an item's metadata that may hold its text or address, in the order in which they are joined.
TEXT_MEMBERS, URL_MEMBERS = ("description", "content", "original_content", "text"), ("url", "original_url")
#: Metadata with such members, which the test tables lack, in words that Spark and DuckDB share; and a description.
_HELD = {
    "description": "CASE WHEN id % 3 = 0 THEN title WHEN id % 3 = 1 THEN '' END", "content": "CASE WHEN id % 4 = 0 THEN content END", "original_content": "CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN content END",
    "text": "CASE WHEN id % 7 = 0 THEN '\"q\" ' || item_id END", "url": "CASE WHEN id % 2 = 0 THEN url END", "original_url": "CASE WHEN id % 6 = 0 THEN 'https://example.org/' || id END",
}
_DESCRIBED = "CASE WHEN id % 8 = 0 THEN '' WHEN id % 8 = 1 THEN 'About ' || item_id END"
_FIELDS = ["content", "description", "title", *[f"json_extract_string(held, '$.{m}')" for m in TEXT_MEMBERS], "url", *[f"json_extract_string(held, '$.{m}')" for m in URL_MEMBERS]]


def content_to_process(metadata: Column) -> Column:
    """All that an item says: content, description, title, texts of its metadata, url and addresses of its metadata; empty ones are left out.

    ``metadata`` is JSON; one that is none, or a member that isn't there, says nothing.
    """
    parsed = T.parsed_json(metadata)
    member = lambda m: F.try_variant_get(parsed, f"$.{m}", "string")
    fields = [F.col("content"), F.col("description"), F.col("title"), *map(member, TEXT_MEMBERS), F.col("url"), *map(member, URL_MEMBERS)]
    return F.concat_ws("\n\n", *[F.nullif(f, F.lit("")) for f in fields])


@query(
    "content_to_process_P22",
    f"""WITH {ITEMS_SQL}, m AS (SELECT id, content, title, url, {_DESCRIBED} AS description, CASE WHEN id % 41 <> 0 THEN json_object({", ".join(f"'{k}', {e}" for k, e in _HELD.items())}) END AS held FROM items)
    SELECT id, concat_ws(chr(10) || chr(10), {", ".join(f"nullif({f}, '')" for f in _FIELDS)}) AS told FROM m""",
)
def to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.to_json(F.struct(*[F.expr(e).alias(k) for k, e in _HELD.items()]))
    i = items(spark, sf_dir, "url").withColumns({"held": F.when(F.col("id") % 41 == 0, "{broken").otherwise(held), "description": F.expr(_DESCRIBED)})
    return i.select("id", content_to_process(F.col("held")).alias("told"))
