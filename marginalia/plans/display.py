"""Queries of context texts, dates, ids, images and what readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import measures as M
from ..operators import related as R
from ..sources.items import AS_OF, ITEMS_SQL, items, table
from .registry import registry
from .related import OVERLAPS, Q as RELATED, SQL as RELATED_SQL, far, seeds

Q, SQL, query = registry()

_THREADS = RELATED_SQL["thread_candidates_G10"].removeprefix("WITH ")
_SHARED = "list_filter(i.tags, lambda t: list_contains(s.tags, t))"
_LINE = r"coalesce(list_filter(string_split(coalesce(nullif(i.summary, ''), 'No summary available'), chr(10)), lambda l: trim(l) <> '')[1], i.summary)"
_SNIP = rf"substring(regexp_replace({_LINE}, '^(?:•|-|\*)\s*', ''), 1, {D.SNIPPET})"
_HEAD, _TAIL = _THREADS.rsplit("SELECT seed_id, id, CASE", 1)


@query(
    "thread_context_F34_Q7",
    f"""WITH {_HEAD.rstrip()}, found AS (SELECT seed_id, id, CASE{_TAIL}),
    blocks AS (SELECT f.seed_id, f.rank, f.rank || '. [' || strftime(i.created_at, '%Y-%m-%d') || '] "' || coalesce(nullif(i.title, ''), nullif(substring(i.url, 1, {D.URL_TITLE}), ''), 'Untitled') || '"' || chr(10) || '   Location: ' || coalesce(i.location, 'Unknown location')
        || ' | Type: ' || i.type || CASE WHEN f.found_by = 'place' THEN ' | Distance: ' || printf('%.1f', {far("s", "i")}) || ' mi' ELSE chr(10) || '   Shared tags: ' || array_to_string({_SHARED}, ', ') END
        || chr(10) || '   Summary: ' || {_SNIP} || CASE WHEN length({_SNIP}) >= {D.SNIPPET} THEN '...' ELSE '' END AS block
        FROM found f JOIN items s ON s.id = f.seed_id JOIN items i ON i.id = f.id)
    SELECT seed_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY seed_id""",
)
def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related items of each seed as one text: those found by tags with the tags they share, those near with their distance."""
    i = items(spark, sf_dir, "summary", "url")
    found = RELATED["thread_candidates_G10"](spark, sf_dir)
    own = seeds(i).select(F.col("id").alias("seed_id"), F.col("tags").alias("seed_tags"), F.col("latitude").alias("seed_lat"), F.col("longitude").alias("seed_lon"))
    full = R.small(found).join(i, "id").join(own, "seed_id")
    place = F.col("found_by") == "place"
    miles = F.when(place, M.haversine_miles(F.col("seed_lat"), F.col("seed_lon"), F.col("latitude"), F.col("longitude")))
    shared = F.when(~place, F.filter("tags", lambda t: F.array_contains("seed_tags", t)))
    told = full.select("seed_id", "rank", "created_at", "title", "url", "summary", "location", "type", miles.alias("miles"), shared.alias("shared"))
    block = D.context_block(*[F.col(c) for c in ("rank", "created_at", "title", "url", "summary", "location", "type")], F.col("miles"), F.col("shared"))
    blocks = told.withColumn("block", block).groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))  # a few a seed
    return blocks.select("seed_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


@query("shared_tags_U5", f"WITH {ITEMS_SQL}, {OVERLAPS} SELECT seed_id, x.id, array_to_string(list_sort(list_filter(i.tags, lambda t: list_contains(s.tags, t))), '|') AS shared FROM shared_tags x JOIN items s ON s.id = seed_id JOIN items i ON i.id = x.id")
def shared_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags that each seed shares with each item related to it."""
    i = items(spark, sf_dir)
    return R.shared_tags(seeds(i), i, AS_OF)


@query(
    "strength_Q6",
    f"WITH {ITEMS_SQL}, {OVERLAPS} SELECT seed_id, CASE WHEN avg(overlap) >= 4 THEN 'strong' WHEN avg(overlap) >= 2 THEN 'medium' ELSE 'weak' END AS strength, count(*) AS n FROM shared_tags GROUP BY seed_id",
)
def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    mean = F.col("total") / F.col("n")
    return R.overlap_sums(seeds(i), i, AS_OF).select("seed_id", F.when(mean >= 4, "strong").when(mean >= 2, "medium").otherwise("weak").alias("strength"), "n")


@query(
    "dates_D5_D6_D8",
    f"""SELECT event_id, strftime(date_trunc('month', ts) - INTERVAL 6 MONTH + to_days((day(ts) - 1)::INTEGER), '%Y-%m-%d') AS half_a_year_before, ts::DATE = DATE '2024-01-26' AS same_day, epoch_us(TIMESTAMP '{AS_OF}' - ts) > 86400000000 AS stale FROM events""",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    stale = F.timestamp_diff("MICROSECOND", ts, F.lit(AS_OF).cast("timestamp_ntz")) > 86_400_000_000
    same = ts.cast("date") == F.lit("2024-01-26").cast("date")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(D.months_before(ts.cast("date"), 6), "yyyy-MM-dd").alias("half_a_year_before"), same.alias("same_day"), stale.alias("stale"))


@query("short_ids_F43", f"WITH {ITEMS_SQL} SELECT id, regexp_replace(substring(item_id, 1, 8), '[^0-9a-f]', '0', 'g') AS short_id FROM items")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", D.short_id(F.col("item_id")).alias("short_id"))


_RESERVED = ("CASE doc_id % 50 WHEN 3 THEN concat('__lock-', doc_id) ELSE concat('s-', doc_id) END AS scrap_id", "CASE doc_id % 70 WHEN 5 THEN 'lock' WHEN 6 THEN NULL ELSE source END AS source")


@query("reserved_P19", f"SELECT source, count(*) AS n FROM (SELECT {", ".join(_RESERVED)} FROM documents) WHERE NOT starts_with(scrap_id, '__') AND source IS DISTINCT FROM 'lock' GROUP BY source")
def unreserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are items: locks and other reserved rows are left out, rows without a source are not."""
    rows = table(spark, sf_dir, "documents").selectExpr(*_RESERVED)
    return rows.where(~F.col("scrap_id").startswith("__") & ~F.col("source").eqNullSafe("lock")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("newest_told_O3", f"WITH {ITEMS_SQL} SELECT id FROM items WHERE summary IS NOT NULL AND len(tags) >= 2 AND location IS NOT NULL ORDER BY created_at DESC, id LIMIT 20")
def newest_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest items that can be told of: filtered first, so that there are as many as are asked for if they exist."""
    fit = items(spark, sf_dir, "summary").where(F.col("summary").isNotNull() & (F.size("tags") >= 2) & F.col("location").isNotNull())
    return fit.orderBy(F.col("created_at").desc(), "id").limit(20).select("id")


_in = lambda c, names: f"{c} IN ({', '.join(repr(n) for n in names)})"


@query(
    "claim_domains_Q11",
    f"""WITH c AS (SELECT ['asserted', 'reported', 'quoted', 'alleged', 'guessed', ''][doc_id % 6 + 1] AS mode, CASE WHEN doc_id % 11 > 0 THEN ['unreviewed', 'supported', 'settled'][doc_id % 3 + 1] END AS state FROM documents)
    SELECT mode, state, {_in("mode", D.CLAIM_MODES)} AS known_mode, {_in("mode", D.EXTRACTED_MODES)} AS extracted, coalesce({_in("state", D.CLAIM_STATES)}, false) AS known_state, count(*) AS n FROM c GROUP BY ALL""",
)
def claim_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.element_at(F.array(*[F.lit(m) for m in ("asserted", "reported", "quoted", "alleged", "guessed", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    states = F.when(F.col("doc_id") % 11 > 0, F.element_at(F.array(*[F.lit(s) for s in ("unreviewed", "supported", "settled")]), (F.col("doc_id") % 3 + 1).cast("int")))
    counted = table(spark, sf_dir, "documents").select(modes.alias("mode"), states.alias("state")).groupBy("mode", "state").agg(F.count(F.lit(1)).alias("n"))
    known = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    return counted.select("mode", "state", known("mode", D.CLAIM_MODES).alias("known_mode"), known("mode", D.EXTRACTED_MODES).alias("extracted"), known("state", D.CLAIM_STATES).alias("known_state"), "n")


#: Metadata of blocks with some of their images.
IMAGES = """CASE id % 6 WHEN 0 THEN concat('{"image_data": {"display": "d', id, '", "cloudinary_url": "c"}}') WHEN 1 THEN concat('{"image_data": {"display": "", "cloudinary_url": "c', id, '"}}') WHEN 2 THEN concat('{"image_data": {"original_url": "o', id, '"}}')
    WHEN 3 THEN '{"image_data": null}' WHEN 4 THEN '{"image_data": {"display"' END"""


@query(
    "images_Q13",
    f"""WITH {ITEMS_SQL}, m AS (SELECT id, screenshot_url, {IMAGES} AS raw FROM items), v AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM m)
    SELECT id, coalesce(nullif(j->>'$.image_data.display', ''), nullif(j->>'$.image_data.cloudinary_url', ''), nullif(j->>'$.image_data.original_url', ''), nullif(screenshot_url, '')) AS image FROM v""",
)
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", D.image(F.expr(IMAGES), F.col("screenshot_url")).alias("image"))


_REL = lambda k: f"coalesce(nullif(json_extract_string(r, '$.{k}.name'), ''), CASE WHEN json_type(r, '$.{k}') = 'VARCHAR' THEN nullif(json_extract_string(r, '$.{k}'), '') END)"


@query(
    "shown_Q14",
    f"""WITH {ITEMS_SQL}, r AS (SELECT id, list_filter(json_extract(relationships, '$[*]'), lambda r: json_type(r) = 'OBJECT' AND ({_REL("source")} IS NOT NULL OR {_REL("target")} IS NOT NULL)) AS v FROM items)
    SELECT id, array_to_string(list_transform(v[:1], lambda r: coalesce({_REL("source")}, '?') || ' →[' || coalesce(json_extract_string(r, '$.relationship'), json_extract_string(r, '$.type'), '') || ']→ ' || coalesce({_REL("target")}, '?')), '|') AS lines,
        greatest(len(v) - 1, 0)::INTEGER AS more FROM r""",
)
def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first relationship of each item as a reader sees it, and how many more there are."""
    return items(spark, sf_dir).select("id", D.shown(F.col("relationships"), 1).alias("s")).select("id", F.array_join("s.lines", "|").alias("lines"), "s.more")


@query(
    "progress_Q15",
    f"""WITH {ITEMS_SQL}, f AS (SELECT id % 4 AS lot, (summary IS NOT NULL)::INTEGER + (len(concept_tags) > 0)::INTEGER + (relationships <> '[]')::INTEGER + (location IS NOT NULL)::INTEGER + (id % 3 = 0)::INTEGER AS n FROM items)
    SELECT lot, CASE WHEN n = 5 THEN 'complete' WHEN n > 0 THEN 'processing' ELSE 'new' END AS state, count(*) AS items FROM f GROUP BY ALL""",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col("summary").isNotNull(), F.size("concept_tags") > 0, F.col("relationships") != "[]", F.col("location").isNotNull(), F.col("id") % 3 == 0]
    return items(spark, sf_dir, "summary").groupBy((F.col("id") % 4).alias("lot"), D.progress(*fields).alias("state")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "merged_relationships_U6",
    f"""WITH {ITEMS_SQL}, b AS (SELECT a.id, list_concat(json_extract(a.relationships, '$[*]'), json_extract(b.relationships, '$[*]')) AS r FROM items a JOIN items b ON b.id = a.id + 55)
    SELECT id, len(list_distinct(list_transform(r, lambda x: x::VARCHAR)))::BIGINT AS n FROM b""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different relationships an item and a later one have together."""
    i = items(spark, sf_dir).select("id", "relationships")
    both = i.join(i.select((F.col("id") - 55).alias("id"), F.col("relationships").alias("later")), "id")
    return both.select("id", F.size(D.merged(F.col("relationships"), F.col("later"))).cast("long").alias("n"))


@query("text_chunks_F27")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole texts, of 300 characters about (compared with a plain version in tests)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(D.text_chunks(F.col("text"), 300)).alias("place", "chunk"))


@query("listed_order_J4", "SELECT e.event_id AS at, d.doc_id, d.lang FROM events e JOIN documents d ON d.doc_id = e.user_id")
def listed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of a list of ids that is a table itself; ids that nothing has are left out, repeated ones stay."""
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").alias("doc_id"))
    return asked.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("at", "doc_id", "lang").orderBy("at")


@query(
    "core_tags_S20",
    f"""WITH {ITEMS_SQL}, core AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS tag FROM benchmark), t AS (SELECT id, unnest(tags) AS tag FROM items)
    SELECT id, string_agg(tag, '|' ORDER BY tag) AS core FROM t JOIN core USING (tag) GROUP BY id""",
)
def core_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' tags that a controlled vocabulary has, here the long words of the benchmark; without a vocabulary none."""
    core = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("tag")).distinct()
    each = items(spark, sf_dir).select("id", F.explode("tags").alias("tag")).join(R.small(core), "tag", "left_semi")
    return each.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("tag")), "|").alias("core"))
