"""Queries of the smaller rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T
from ..operators.folds import running_totals
from ..sources.items import AS_OF, ITEMS_SQL, SOURCES, TYPES, items, table
from .registry import registry
from .text import _NAME

Q, SQL, query = registry()

_NOW = f"TIMESTAMP '{AS_OF}'"
_q = lambda s: s.replace("'", "''")


#: Names of parts in four spellings, so that several patterns fit.
_NAMES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('Dr ', p_name) WHEN 1 THEN concat(p_name, ' Fund') WHEN 2 THEN concat(p_name, '.py') WHEN 3 THEN concat('the ', p_name, ' project')
    WHEN 4 THEN p_name ELSE '' END AS name FROM {part}"""
_TYPE = "CASE WHEN n = '' THEN 'Organization' " + " ".join(f"WHEN regexp_matches(n, '{_q(p)}') THEN '{k}'" for k, p in R.ENTITY_PATTERNS) + " ELSE 'Project' END"


@query("entity_type_F16", f"WITH p AS ({_NAMES.format(part='part')}) SELECT p_partkey, {_TYPE} AS entity_type FROM (SELECT p_partkey, {_NAME.format('name')} AS n FROM p)")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _NAMES.split("FROM")[0].replace("SELECT p_partkey, ", "").rsplit(" AS name", 1)[0]
    return table(spark, sf_dir, "part").select("p_partkey", R.entity_type(F.expr(cases)).alias("entity_type"))


_POINTS = " + ".join(
    [f"CASE WHEN contains(lower(p), '{w}') THEN {n} ELSE 0 END" for w, n in R.PASSAGE_POINTS]
    + ["CASE WHEN " + " OR ".join(f"contains(lower(p), '{w}')" for w in words) + f" THEN {n} ELSE 0 END" for words, n in R.PASSAGE_ANY]
    + [f"CASE WHEN regexp_matches(p, '{R.PASSAGE_PATH}') THEN 2 ELSE 0 END", f"CASE WHEN length(p) > {R.LONG_PASSAGE} THEN -2 ELSE 0 END", f"CASE WHEN length(p) < {R.SHORT_PASSAGE} THEN -1 ELSE 0 END"]
)


#: Texts, in three of which in seven a sentence of the kind that is looked for follows.
_WORDS_OF = """concat(text, CASE doc_id % 7 WHEN 0 THEN concat('. This repository is maintained by ', source, ' and its license and attribution stand below') WHEN 2 THEN '. Skip to content and sign up, then pip install what it requires now'
    WHEN 4 THEN '. The model depends on Some-Org/some-repo, built with a library of its owner (c)' ELSE '' END)"""


@query(
    "passages_F28",
    rf"""WITH x AS (SELECT doc_id, unnest(list_zip(ps, range(len(ps)))) AS z FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(replace({_WORDS_OF}, '. ', '.' || chr(10) || chr(10)), '\n{{2,}}'), lambda p: trim(regexp_replace(p, '[\s\x{{00A0}}\x{{FEFF}}]+', ' ', 'g'))), lambda p: length(p) >= {R.LEAST_PASSAGE}) AS ps FROM documents)),
    s AS (SELECT doc_id, z[2]::INTEGER AS place, p, {_POINTS} AS score FROM (SELECT doc_id, z, z[1] AS p FROM x))
    SELECT doc_id, place AS "at", score::INTEGER AS score, md5(p) AS md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM s WHERE score > 0) WHERE k <= 5""",
)
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.expr(_WORDS_OF), F.lit(". "), F.lit(".\n\n"))  # a sentence is a paragraph here
    found = table(spark, sf_dir, "documents").select("doc_id", F.inline(R.best_passages(text, 5)))
    return found.select("doc_id", "at", "score", F.md5("passage").alias("md5"))


_SHORT, _META, _STOP = (", ".join(f"'{t}'" for t in x) for x in (R.SHORT_TAGS, R.META_TAGS, (*R.STOP_TAGS, *R.TITLE_TAGS)))


@query(
    "clean_tags_F36",
    rf"""WITH p AS (SELECT conv_id, turn, list_transform(string_split(regexp_replace(replace(text, ' ', ','), '[\n\r]', ',', 'g'), ','), lambda t: trim(t)) AS parts FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(list_filter(parts, lambda t: length(t) > 0 AND length(t) < 30 AND lower(t) NOT IN ({_META})
        AND CASE WHEN length(t) <= 2 THEN starts_with(t, '!') OR lower(t) IN ({_SHORT}) ELSE NOT regexp_matches(list_filter(parts, lambda o: lower(o) = lower(t))[1], '[A-Z]') END), lambda t: lower(t)), '|') AS tags FROM p""",
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.clean_tags(F.replace("text", F.lit(" "), F.lit(","))), "|").alias("tags"))


@query(
    "bad_tags_F37",
    f"""WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS tags FROM conversations)
    SELECT conv_id, turn, len(tags) = 1 AND tags[1] = 'pinboard' OR len(list_filter(tags, lambda t: t IN ({_STOP}) OR length(t) > 2 AND regexp_matches(t, '^[A-Z]'))) > 0 AS bad FROM t""",
)
def bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.bad_tags(F.split("text", " ", -1)).alias("bad"))


@query(
    "keyword_tags_F38",
    f"""WITH {ITEMS_SQL} SELECT id, array_to_string(list_filter([source, {", ".join(f"CASE WHEN contains(lower(content), '{k}') AND '{k}' <> source THEN '{k}' END" for k in R.KEYWORDS)}], lambda t: t IS NOT NULL), '|') AS tags FROM items""",
)
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.array_join(R.keyword_tags(F.col("source"), F.col("content")), "|").alias("tags"))


_AGE = "CASE " + " ".join(f"WHEN s // {n} >= 1 THEN (s // {n}) || ' {u}' || CASE WHEN s // {n} > 1 THEN 's' ELSE '' END || ' ago'" for u, n in R.AGES) + " ELSE 'just now' END"


@query(
    "ages_F31_F32",
    f"""WITH {ITEMS_SQL}, a AS (SELECT id, epoch({_NOW} - created_at)::BIGINT - id AS s, id * 61 AS d FROM items)
    SELECT id, {_AGE} AS age, CASE WHEN d >= 3600 THEN (d // 3600) || 'h ' || (d % 3600 // 60) || 'm' WHEN d >= 60 THEN (d // 60) || 'm ' || (d % 60) || 's' ELSE d || 's' END AS duration FROM a""",
)
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz")) - F.col("id")
    return items(spark, sf_dir).select("id", R.age(seconds).alias("age"), R.duration(F.col("id") * 61).alias("duration"))


_AI = {"summary": "string", "concept_tags": "array<string>", "relationships": "string", "location": "string", "screenshot_url": "string", "embedding": "array<float>"}


@query(
    "completeness_A21_P17",
    f"""WITH {ITEMS_SQL} SELECT id, floor(100.0e0 * ((coalesce(trim(summary), '') <> '')::INTEGER + (coalesce(len(concept_tags), 0) > 0)::INTEGER + (coalesce(trim(relationships), '') <> '')::INTEGER
    + (coalesce(trim(location), '') <> '')::INTEGER + (coalesce(trim(screenshot_url), '') <> '')::INTEGER + (coalesce(len(embedding), 0) > 0)::INTEGER) / 6 + 0.5e0)::BIGINT AS percent FROM items""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = sum((R.filled(F.col(c), t).cast("int") for c, t in _AI.items()), F.lit(0))
    return items(spark, sf_dir, "summary", "embedding").select("id", F.floor(F.lit(100.0) * there / len(_AI) + 0.5).alias("percent"))


@query(
    "fix_priority_M7",
    f"""WITH {ITEMS_SQL}, d AS (SELECT *, (summary IS NULL)::INTEGER + (location IS NULL)::INTEGER + (screenshot_url IS NULL)::INTEGER AS issues, epoch({_NOW} - created_at) / 86400.0e0 AS days FROM items)
    SELECT id, (CASE source WHEN 'pinboard' THEN 3 WHEN 'arena' THEN 2 WHEN 'mastodon' THEN 1 ELSE 0 END + issues + CASE WHEN coalesce(url, '') <> '' THEN 2 ELSE 0 END
        + CASE WHEN days < 7 THEN 3 WHEN days < 30 THEN 2 WHEN days < 90 THEN 1 ELSE 0 END)::INTEGER AS score FROM d""",
)
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = sum((F.col(c).isNull().cast("int") for c in ("summary", "location", "screenshot_url")), F.lit(0))
    days = F.timestamp_diff("SECOND", F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz")) / 86400.0
    return items(spark, sf_dir, "summary", "url").select("id", R.fix_priority(F.col("source"), issues, F.col("url"), days).cast("int").alias("score"))


@query(
    "rates_A12_A20",
    "SELECT user_id, round(coalesce(sum(value) / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 0.0e0), 6) AS per_purchase, round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 6) AS passed FROM events GROUP BY user_id",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.round(R.ratio(F.sum("value"), F.count_if(F.col("event_type") == "purchase")), 6).alias("per_purchase"),
        F.round(R.ratio(F.count_if(F.col("event_type") != "error"), F.count(F.lit(1))), 6).alias("passed"),
    )


@query("vector_stats_A24", "SELECT vec_id, round(list_min(embedding), 6) AS least, round(list_max(embedding), 6) AS most, round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x = F.col("embedding"), F.transform("embedding", lambda a: a.cast("double"))
    mean = R.ratio(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), F.size(v))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_min(v), 6).alias("least"), F.round(F.array_max(v), 6).alias("most"), F.round(mean, 6).alias("mean"))


@query(
    "in_order_J4",
    "SELECT o.at::INTEGER AS at, d.doc_id, d.lang FROM (SELECT unnest([7, 3, -1, 11, 3]) AS doc_id, unnest(range(5)) AS at) o JOIN documents d USING (doc_id)",
)
def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a list of ids; ids that nothing has are left out."""
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (7, 3, -1, 11, 3)])).alias("at", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(asked), "doc_id").select("at", "doc_id", "lang").orderBy("at")


@query(
    "bulk_update_K6_K5",
    f"""WITH {ITEMS_SQL}, fixed AS (SELECT id, source, CASE WHEN type = 'unknown' THEN CASE source WHEN 'pinboard' THEN 'bookmark' WHEN 'mastodon' THEN 'status' WHEN 'arena' THEN 'block' ELSE type END ELSE type END AS type FROM items)
    SELECT source, type, count(*) AS n FROM fixed GROUP BY ALL""",
)
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown types set to the only one that their source has."""
    only = {s: TYPES[s][0] for s in SOURCES if len(TYPES[s]) == 1}
    own = F.coalesce(*[F.when(F.col("source") == s, t) for s, t in only.items()], F.col("type"))
    fixed = items(spark, sf_dir).withColumn("type", F.when(F.col("type") == "unknown", own).otherwise(F.col("type")))
    return fixed.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "news_quota_G25",
    f"""WITH {ITEMS_SQL}, news AS (SELECT id, created_at, list_contains(tags, 'ofonrereer') AND type NOT IN ('gist', 'starred') AS is_news FROM items),
    k AS (SELECT *, row_number() OVER (PARTITION BY created_at::DATE ORDER BY created_at DESC, id DESC) AS k FROM news WHERE is_news)
    SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS news, least(count(*), 5) AS allowed, min(id) FILTER (WHERE k <= 5) AS first_allowed FROM k GROUP BY 1""",
)
def news_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day's news the latest five; filtered before they are counted, so that none is missed. No task sorts a day."""
    news = items(spark, sf_dir).where(F.array_contains("tags", "ofonrereer") & ~F.col("type").isin("gist", "starred")).select("id", "created_at", F.to_date("created_at").alias("date"))
    k = F.row_number().over(W.partitionBy("date").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    first = news.withColumn("k", k).where(F.col("k") <= 5).groupBy("date").agg(F.min("id").alias("first_allowed"))  # five rows a day and task are shuffled
    days = news.groupBy("date").agg(F.count(F.lit(1)).alias("news"), F.least(F.count(F.lit(1)), F.lit(5)).alias("allowed"))
    return days.join(first, "date").select(F.date_format("date", "yyyy-MM-dd").alias("day"), "news", "allowed", "first_allowed")


@query(
    "health_G29",
    """WITH h AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT hour, CASE WHEN errors * 2 > n THEN 'unhealthy' WHEN errors > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM h""",
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return h.select("hour", F.when(F.col("errors") * 2 > F.col("n"), "unhealthy").when(F.col("errors") > 0, "degraded").otherwise("healthy").alias("status"))


@query(
    "running_costs_W7",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS day_total,
    round(sum(value) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS hour_total FROM events""",
)
def running_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that begin anew each day and each hour: minutes are totalled, and the sums of those before are added."""
    ts, order = F.col("ts"), ["ts", "event_id"]
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value", ts.cast("date").alias("day"), F.date_trunc("hour", ts).alias("hour"))
    by_day = running_totals(e, F.date_trunc("minute", ts), order, "value", "day_total", ["day"])
    both = running_totals(by_day, F.date_trunc("minute", ts), order, "value", "hour_total", ["hour"])
    return both.select("event_id", F.round("day_total", 4).alias("day_total"), F.round("hour_total", 4).alias("hour_total"))


@query(
    "error_windows_T10",
    "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS started, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1",
)
def error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and failures of windows of five minutes, each begun by the clock."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    w = e.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return w.select(F.col("w.start").alias("started"), "attempts", "failures")


@query(
    "json_set_N2_O7",
    f"""WITH {ITEMS_SQL}, m AS (SELECT id, json_extract_string(metadata, '$.n')::INTEGER AS n, json_merge_patch(metadata, json_object('seen', id::VARCHAR)) AS new FROM items WHERE json_valid(metadata) ORDER BY n DESC, id LIMIT 100)
    SELECT id, n, array_to_string(list_sort(json_keys(new)), '|') AS keys, json_extract_string(new, '$.seen') AS seen, json_extract_string(new, '$.extra') AS extra,
        json_extract_string(new, '$.n2')::DOUBLE AS n2, json_extract_string(new, '$.tags_synced') AS synced FROM m""",
)
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with one key set and all others kept, the first by a number within them; told by its keys and values."""
    held = items(spark, sf_dir).where(T.is_json(F.col("metadata"))).select("id", "metadata", F.try_variant_get(T.parsed_json(F.col("metadata")), "$.n", "int").alias("n"))
    first = held.orderBy(F.col("n").desc(), "id").limit(100)
    new = F.try_parse_json(R.json_with(F.col("metadata"), "seen", F.col("id").cast("string")))
    out = first.select("id", "n", F.col("metadata"), new.alias("new"))
    get = lambda key, kind: F.try_variant_get("new", f"$.{key}", kind).alias({"tags_synced": "synced"}.get(key, key))
    keys = F.array_join(F.array_sort(F.map_keys(F.from_json(F.to_json("new"), "map<string,string>"))), "|")
    return out.select("id", "n", keys.alias("keys"), get("seen", "string"), get("extra", "string"), get("n2", "double"), get("tags_synced", "string"))


@query(
    "sentiment_A29_U5",
    """WITH a AS (SELECT doc_id, unnest([((doc_id * 3) % 25) / 10.0e0 - 1.2e0, ((doc_id * 5) % 25) / 10.0e0 - 1.2e0]) AS s FROM documents)
    SELECT doc_id, round(avg(s), 6) AS mean, (doc_id % 3 = doc_id % 5)::INTEGER AS shared FROM a GROUP BY doc_id""",
)
def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*[((F.col("doc_id") * k) % 25) / 10.0 - 1.2 for k in (3, 5)])
    mean = R.ratio(F.aggregate(scores, F.lit(0.0), lambda a, b: a + b), F.size(scores))
    shared = F.size(F.array_intersect(F.array(F.col("doc_id") % 3), F.array(F.col("doc_id") % 5)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(mean, 6).alias("mean"), shared.alias("shared"))


@query(
    "escaped_F33",
    """SELECT conv_id, turn, md5(CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS csv,
    md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html FROM conversations""",
)
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(R.csv_field(F.col("text"))).alias("csv"), F.md5(R.escaped(F.col("text"))).alias("html"))


#: Pages with tags to find: quoted in both ways or bare, with signs between quotes, repeated, and cut short.
PAGE = """concat(html, CASE page_id % 6 WHEN 0 THEN concat('<META Property="og:locality" content="Ghent > all ', page_id, '"><meta name=description content=first><meta name="description" content="second">')
    WHEN 1 THEN concat('<meta content=''A "quoted" town'' name=''geo.placename''/><meta name="geo.position" content="', page_id % 90, ';4">') WHEN 2 THEN '<meta name="description" content="no end' WHEN 3 THEN '<metadata name="x" content="y">' ELSE '' END)"""
_META_SQL = R.ATTRIBUTES.replace("'", "''")
_VALUE_SQL = R.VALUE.replace("'", "''")
_attribute = lambda t, names: "concat(" + ", ".join(f"regexp_extract({t}, '(?is)[\\s\\\"''/](?:{names}){_VALUE_SQL}', {i})" for i in (1, 2, 3)) + ")"
_METAS = f"""(SELECT page_id, key, first(value ORDER BY i) AS value FROM (
        SELECT page_id, i, lower({_attribute("t", "name|property")}) AS key, {_attribute("t", "content")} AS value
        FROM (SELECT page_id, unnest(m) AS t, unnest(range(len(m))) AS i FROM (SELECT page_id, regexp_extract_all({PAGE}, '(?is)<meta[\\s/]{_META_SQL}>') AS m FROM pages))) WHERE key <> '' GROUP BY page_id, key)"""


@query("meta_tags_L10", f"SELECT page_id, count(*) AS tags, max(value) FILTER (WHERE key = 'description') AS description, max(value) FILTER (WHERE key = 'og:locality') AS locality FROM {_METAS} GROUP BY page_id")
def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", R.meta_tags(F.expr(PAGE)).alias("m")).where(F.size("m") > 0)
    value = lambda key: F.try_element_at("m", F.lit(key))
    return found.select("page_id", F.size("m").cast("long").alias("tags"), value("description").alias("description"), value("og:locality").alias("locality"))
