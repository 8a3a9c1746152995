"""Queries of the text and URL functions, over documents, pages and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.items import ITEMS_SQL, items, table
from .registry import registry

Q, SQL, query = registry()


S = r"[\s\x{{00A0}}\x{{FEFF}}]+"
SLUG = r"""regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[''"`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"""
TOKEN = r"""upper(regexp_replace(regexp_replace(regexp_replace(trim({0}), '([a-z])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g'))"""
HTML = rf"trim(regexp_replace(regexp_replace({{0}}, '<[^>]*>', ' ', 'g'), '{S}', ' ', 'g'))"
HOST = r"""coalesce(regexp_replace(lower(nullif(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '')), '^www\.', ''), '')"""
PATH = r"""regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"""


@query("slug_whole_F4", f"SELECT doc_id, {SLUG.format('text')} AS slug, sha1({SLUG.format('text')}) AS slug_sha1 FROM documents")
def whole_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.slug(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("slug"), F.sha1(s).alias("slug_sha1"))


@query("predicate_token_whole_F5", f"SELECT {TOKEN.format('text')} AS token, count(*) AS n FROM documents GROUP BY 1")
def whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(T.predicate_token(F.col("text")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "html_strip_F22",
    f"SELECT page_id, length({HTML.format('html')}) AS plain_chars, length({HTML.format('html')}) < 100 AS too_thin, ceil(length(html) / 4.0)::BIGINT AS tokens, md5({HTML.format('html')}) AS plain_md5 FROM pages",
)
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = T.without_html(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(plain).cast("long").alias("plain_chars"), T.too_thin(F.col("html")).alias("too_thin"), T.token_estimate(F.col("html")).alias("tokens"), F.md5(plain).alias("plain_md5")
    )


@query(
    "host_L1",
    f"""SELECT page_id, {HOST.format("url")} AS host, lower(coalesce(regexp_extract(url, '^([a-zA-Z]+)://', 1), '')) IN ('http', 'https') AS valid,
    CASE WHEN len(string_split({HOST.format("url")}, '.')) >= 2 THEN list_extract(string_split({HOST.format("url")}, '.'), -2) END AS domain FROM pages""",
)
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = T.host(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), T.valid_url(F.col("url")).alias("valid"), F.when(F.size(F.split(host, r"\.")) >= 2, F.try_element_at(F.split(host, r"\."), F.lit(-2))).alias("domain")
    )


_SEG = ", ".join(f"CASE WHEN contains(u, '/{s}/') OR contains(u, '-{s}-') THEN '{s}' END" for s in T.PLACE_SEGMENTS)
_TLD = ", ".join(f"CASE WHEN contains(u, '{t}') THEN 'geographic domain ({t})' END" for t in T.PLACE_TLDS)
_DOM = ", ".join(f"CASE WHEN contains(u, '{d}') THEN 'location-focused domain ({d})' END" for d in T.PLACE_DOMAINS)


@query(
    "url_hints_L5",
    f"SELECT page_id, array_to_string(list_filter([{_SEG}, {_TLD}, {_DOM}], lambda x: x IS NOT NULL), '|') AS hints FROM (SELECT page_id, lower(coalesce(url, '')) AS u FROM pages)",
)
def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.place_hints(F.col("url")), "|").alias("hints"))


_TITLE = f"""coalesce(CASE WHEN last IS NOT NULL THEN upper(substring(last, 1, 1)) || substring(last, 2) END, nullif(host, ''))"""


@query(
    "url_title_L7",
    f"""SELECT page_id, {_TITLE} AS title FROM (
        SELECT page_id, host, regexp_replace(translate(list_extract(list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> 'index.html'), -1), '-_', '  '), '\\.[^.]+$', '') AS last
        FROM (SELECT page_id, {HOST.format("url")} AS host, {PATH.format("url")} AS path FROM pages))""",
)
def url_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_title(F.col("url")).alias("title"))


_TYPES = " ".join(f"WHEN regexp_matches(u, '{p}')" + (f" OR regexp_matches(t, '{q}')" if q else "") + f" THEN '{k}'" for k, p, q in T.CONTENT_TYPES)


@query("content_type_F19", f"WITH {ITEMS_SQL} SELECT id, CASE {_TYPES} ELSE 'article' END AS content_type FROM (SELECT id, lower(coalesce(url, '')) AS u, lower(coalesce(title, '')) AS t FROM items)")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "url").select("id", T.content_type(F.col("url"), F.col("title")).alias("content_type"))


_JUNK = " OR ".join("regexp_matches(n, '" + p.replace("'", "''").replace("(?i)", "(?i)") + "')" for p in T.JUNK_PATTERNS)
_NAME = rf"""translate(trim(regexp_replace(regexp_replace(coalesce({{0}}, ''), '^["''`]+|["''`]+$', '', 'g'), '{S}', ' ', 'g')), '’“”', '''""')"""


@query(
    "junk_names_whole_F9",
    f"""SELECT word, n, length(n) < 2 OR lower(n) IN ({", ".join(f"'{x}'" for x in T.JUNK_NAMES)}) OR {_JUNK} AS junk
    FROM (SELECT word, {_NAME.format("word")} AS n FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM conversations))""",
)
def whole_junk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.select("word", T.entity_name(F.col("word")).alias("n"), T.junk_name(F.col("word")).alias("junk"))


_CLEAN = r"""trim(regexp_replace(regexp_replace(summary, '(?m)^#+\s*', '', 'g'), '\*\*', '', 'g'))"""
_CUT = "CASE WHEN length({0}) > 100 THEN substring({0}, 1, 97) || '...' ELSE {0} END"


@query(
    "title_from_summary_F20",
    rf"""WITH {ITEMS_SQL}, u AS (SELECT id, summary, {_CLEAN} AS clean, host,
        regexp_replace(translate(list_extract(list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> 'index.html'), -1), '-_', '  '), '\.[^.]+$', '') AS last
        FROM (SELECT id, summary, {HOST.format("url")} AS host, {PATH.format("url")} AS path FROM items)),
    b AS (SELECT *, list_extract(list_filter(list_transform(list_filter(list_transform(string_split(clean, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[•\-*]')), lambda x: trim(substring(x, 2))),
        lambda x: length(x) > 10), 1) AS bullet, split_part(clean, '. ', 1) AS sentence, trim(substring(clean, 1, 100)) AS short FROM u)
    SELECT id, CASE WHEN trim(coalesce(summary, '')) = '' THEN {_TITLE} ELSE coalesce({_CUT.format("bullet")}, CASE WHEN length(sentence) > 10 THEN {_CUT.format("trim(sentence)")} END,
        CASE WHEN length(clean) > 100 THEN short || '...' ELSE short END) END AS made_title FROM b""",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "summary", "url").select("id", T.summary_title(F.col("summary"), F.col("url")).alias("made_title"))


def _plain(c: str) -> str:
    steps = (
        ("<[^>]*>", " "), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), ("__(.+?)__", r"\1"), ("_(.+?)_", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
        (r"```[\s\S]*?```", ""), ("`([^`]+)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\n{3,}", "\n\n"), (r"\n", " "),
    )
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim({c})"


@query(
    "meta_summary_F21",
    "WITH " + ITEMS_SQL + f""", p AS (SELECT id, summary, concat_ws(' · ', CASE WHEN type <> 'bookmark' THEN upper(type) END, substring({_plain("nullif(title, '')")}, 1, 40),
        CASE WHEN location <> '' AND location <> 'Unknown' THEN '@ ' || location END, CASE WHEN json_array_length(relationships) > 0 THEN json_array_length(relationships) || ' connections' END,
        CASE WHEN len(tags) > 0 THEN '#' || array_to_string(list_slice(tags, 1, 2), ' #') END) AS parts FROM items),
    t AS (SELECT id, CASE WHEN length(parts) < 120 AND coalesce(summary, '') <> '' AND 140 - length(parts) - 3 > 20
        THEN parts || ' - ' || substring({_plain("summary")}, 1, 140 - length(parts) - 3) ELSE parts END AS text FROM p)
    SELECT id, CASE WHEN text = '' THEN 'No summary available' WHEN length(text) > 140 THEN substring(text, 1, 139) || '…' ELSE text END AS meta_summary FROM t""",
)
def meta_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.size(F.from_json("relationships", "array<string>"))
    return items(spark, sf_dir, "summary").select("id", T.meta_summary(F.col("type"), F.col("title"), F.col("location"), links, F.col("tags"), F.col("summary")).alias("meta_summary"))


#: Sentences are numbered and gathered one after the other: a chunk is closed by the sentence that would pass the limit.
@query(
    "chunks_F26",
    r"""WITH RECURSIVE s AS (
        SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS all_ FROM documents),
    walk AS (
        SELECT doc_id, all_, 0::BIGINT AS i, 0 AS chunk, '' AS open, NULL::VARCHAR AS done FROM s
        UNION ALL
        SELECT doc_id, all_, i + 1, chunk + CASE WHEN closes THEN 1 ELSE 0 END,
            CASE WHEN i >= len(all_) THEN '' WHEN closes OR open = '' THEN all_[i + 1] ELSE open || ' ' || all_[i + 1] END, CASE WHEN closes OR i >= len(all_) THEN open END
        FROM (SELECT *, i < len(all_) AND open <> '' AND ceil(length(open || ' ' || all_[i + 1]) / 4.0) > 250 AS closes FROM walk) WHERE i <= len(all_))
    SELECT doc_id, (CASE WHEN i > len(all_) THEN chunk ELSE chunk - 1 END)::INTEGER AS chunk, length(done)::INTEGER AS chars, ceil(length(done) / 4.0)::BIGINT AS tokens, md5(done) AS md5
    FROM walk WHERE coalesce(done, '') <> ''""",
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentence_chunks(F.col("text"), 250)).alias("chunk", "part"))
    return parts.select("doc_id", "chunk", F.length("part").alias("chars"), T.token_estimate(F.col("part")).alias("tokens"), F.md5("part").alias("md5"))


_ASSET = """CASE WHEN t = '' THEN 'unknown'
    WHEN contains(t, '-USD') OR contains(t, 'USDT') OR t IN ('BTC', 'ETH', 'ADA', 'DOT', 'SOL', 'MATIC', 'AVAX', 'DOGE') THEN 'crypto'
    WHEN contains(t, '=X') OR contains(t, '/') THEN 'forex' WHEN starts_with(t, '^') OR t IN ('SPX', 'NDX', 'DJX') THEN 'index'
    WHEN length(t) = 3 AND (contains(t, 'ETF') OR t IN ('SPY', 'QQQ', 'VTI', 'IWM', 'GLD', 'SLV') OR ends_with(t, 'Y')) THEN 'etf'
    WHEN contains(t, '=F') OR split_part(t, '=', 1) IN ('GC', 'SI', 'CL', 'NG') THEN 'commodity' ELSE 'stock' END"""


@query(
    "asset_type_F18",
    f"""SELECT asset_type, count(*) AS n FROM (SELECT {_ASSET} AS asset_type FROM (
        SELECT upper(list_extract(string_split(p_name, ' '), 1)) || list_extract(['', '-usd', '=X', '=F', 'Y'], p_partkey % 5 + 1) AS raw FROM part), LATERAL (SELECT upper(raw) AS t) x) GROUP BY 1""",
)
def asset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("concat(upper(split(p_name, ' ')[0]), element_at(array('', '-usd', '=X', '=F', 'Y'), cast(p_partkey % 5 + 1 AS int))) AS t")
    return part.groupBy(T.asset_type(F.col("t")).alias("asset_type")).agg(F.count(F.lit(1)).alias("n"))
