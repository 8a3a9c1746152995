"""Landed records of sources, made of the test tables, as items and as texts for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mappers as R
from ..sources.items import table
from .registry import registry

Q, SQL, query = registry()

#: A document as a repository record, in words that Spark and DuckDB share.
_REPOSITORY = {
    "id": "doc_id", "type": "CASE doc_id % 7 WHEN 0 THEN 'repo' WHEN 1 THEN 'pr' WHEN 2 THEN 'issue' WHEN 3 THEN 'gist' WHEN 4 THEN 'release' WHEN 5 THEN 'starred' ELSE 'event' END",
    "html_url": "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 > 1 THEN 'https://example.org/r/' || doc_id END", "url": "CASE WHEN doc_id % 10 <> 0 THEN 'https://api.example.org/r/' || doc_id END",
    "title": "CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id END", "name": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'name-' || doc_id END", "description": "CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 > 1 THEN text END",
    "body": "CASE WHEN doc_id % 4 > 0 THEN text END", "topics": "CASE WHEN doc_id % 8 > 0 THEN regexp_extract_all(lower(text), '[a-z]{10,}', 0) END", "language": "upper(lang)",
    "state": "CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END", "private": "doc_id % 9 = 0", "fork": "doc_id % 2 = 0", "stars": "CASE WHEN doc_id % 3 > 0 THEN n_chars END",
    "author": "CASE WHEN doc_id % 11 > 0 THEN source END", "created_at": "'2024-01-' || (10 + doc_id % 20)", "updated_at": "'2024-02-' || (10 + doc_id % 19)",
}
_LANDED = "landed AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _REPOSITORY.items()) + " FROM documents)"
#: A list of strings without nulls, empty and repeated ones.
_DISTINCT = "list_transform(list_filter(list_zip(a, range(len(a))), lambda x: coalesce(x[1], '') <> '' AND list_position(a, x[1]) = x[2] + 1), lambda x: x[1])"


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in _REPOSITORY.items()])


_KIND = """CASE WHEN type IN ('repo', 'gist', 'starred') THEN coalesce(nullif(description, ''), 'No description') WHEN type IN ('pr', 'issue', 'release') THEN coalesce(nullif(body, ''), 'No content') ELSE 'No content' END"""


@query(
    "repository_rows_S7",
    f"""WITH {_LANDED}, t AS (SELECT *, list_concat(coalesce(topics, []), [lower(language), type, CASE WHEN type IN ('pr', 'issue') THEN state END,
        CASE WHEN type IN ('repo', 'gist') THEN CASE WHEN private THEN 'private' ELSE 'public' END END, CASE WHEN type = 'repo' AND fork THEN 'fork' END]) AS a FROM landed)
    SELECT 'github-' || id AS item_id, type, coalesce(nullif(html_url, ''), nullif(url, '')) AS url, coalesce(nullif(title, ''), nullif(name, ''), 'Untitled') AS title, {_KIND} AS content,
        array_to_string({_DISTINCT}, '|') AS tags FROM t""",
)
def repository_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repository_rows(repositories(spark, sf_dir)).select("item_id", "type", "url", "title", "content", F.array_join("tags", "|").alias("tags"))


@query(
    "repository_union_S10",
    f"WITH {_LANDED} SELECT 'github-' || id AS item_id, type FROM landed WHERE type <> 'event' ORDER BY list_position(['repo', 'pr', 'issue', 'gist', 'release', 'starred'], type), id LIMIT 100",
)
def repository_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_of = repositories(spark, sf_dir)
    lists = [all_of.where(F.col("type") == t).select("id", "type") for t in ("repo", "pr", "issue", "gist", "release", "starred")]
    return R.union_of(lists, F.col("id"), 100).select(F.concat(F.lit("github-"), F.col("id").cast("string")).alias("item_id"), "type")


#: A page as a block: its columns, and members of its structs.
_BLOCK = {
    "id": "page_id", "class": "CASE page_id % 8 WHEN 0 THEN 'Image' WHEN 1 THEN 'Text' WHEN 2 THEN 'Link' WHEN 3 THEN 'Attachment' WHEN 4 THEN 'MEDIA' WHEN 5 THEN 'Channel' WHEN 6 THEN '' END",
    "base_class": "CASE WHEN page_id % 3 > 0 THEN 'Block' END", "title": "CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id END", "generated_title": "CASE WHEN page_id % 5 > 0 THEN 'Made ' || page_id END",
    "description": "CASE WHEN page_id % 5 < 2 THEN 'About ' || url WHEN page_id % 5 = 2 THEN '' END", "content": "CASE WHEN page_id % 4 > 0 THEN html END",
}
_MEMBERS = {
    "source": {"url": "CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '' END", "title": "CASE WHEN page_id % 4 < 3 THEN 'Source ' || page_id END"},
    "attachment": {"url": "CASE WHEN page_id % 7 = 1 THEN url || '#file' END"},
    "embed": {"url": "CASE WHEN page_id % 11 = 1 THEN url || '#embed' END", "title": "CASE WHEN page_id % 16 = 4 THEN 'Embedded' END", "thumbnail_url": "CASE WHEN page_id % 2 = 0 THEN url || '#t' END"},
    "image": {n: f"CASE WHEN page_id % {m} = {r} THEN url || '#{n}' END" for n, m, r in (("original", 6, 0), ("large", 6, 1), ("display", 12, 2), ("square", 12, 3), ("thumb", 12, 4))},
}
_BLOCKS = "blocks AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in _BLOCK.items()) + ", " + ", ".join(f"{e} AS {s}_{m}" for s, ms in _MEMBERS.items() for m, e in ms.items()) + " FROM pages)"
_OF = lambda last, *cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + f", '{last}')"


@query(
    "block_rows_S9",
    f"""WITH {_BLOCKS} SELECT 'arena-' || id AS item_id, coalesce(nullif(source_url, ''), attachment_url, embed_url, 'https://www.are.na/block/' || id) AS url, {_OF("Untitled Block", "title", "generated_title")} AS title,
        CASE WHEN coalesce("class", '') = '' THEN 'No content' WHEN "class" = 'Image' THEN {_OF("Untitled image", "description", "title", "generated_title")} WHEN "class" = 'Text' THEN {_OF("Empty text block", "content", "description")}
        WHEN "class" = 'Link' THEN {_OF("Untitled link", "description", "source_title")} WHEN "class" = 'Attachment' THEN {_OF("Untitled attachment", "description", "title")}
        WHEN "class" = 'MEDIA' THEN {_OF("Untitled media", "description", "embed_title")} ELSE {_OF("No content", "content", "description")} END AS content,
        coalesce(image_original, image_large, image_display, image_square, image_thumb, attachment_url, embed_thumbnail_url) AS image_url,
        array_to_string(list_filter([lower("class"), lower(base_class)], lambda t: coalesce(t, '') <> ''), '|') AS tags FROM blocks""",
)
def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    structs = [F.struct(*[F.expr(e).alias(m) for m, e in ms.items()]).alias(s) for s, ms in _MEMBERS.items()]
    landed = table(spark, sf_dir, "pages").select(*[F.expr(e).alias(c) for c, e in _BLOCK.items()], *structs)
    return R.block_rows(landed).select("item_id", "url", "title", "content", "image_url", F.array_join("tags", "|").alias("tags"))


@query(
    "cached_fetch_S1",
    """WITH b AS (SELECT doc_id AS hash, md5(coalesce(text, '')) AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37) AS marked FROM documents WHERE doc_id IS NOT NULL),
    held AS (SELECT hash, 'held' AS state, content, marked FROM b WHERE hash % 10 <> 7), recent AS (SELECT hash, 'recent' AS state, content, marked FROM b ORDER BY marked DESC, hash DESC LIMIT 100)
    SELECT * FROM recent UNION ALL SELECT * FROM held WHERE hash NOT IN (SELECT hash FROM recent)""",
)
def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 AS int), 0) AS marked"
    b = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).selectExpr("doc_id AS hash", "md5(coalesce(text, '')) AS content", at)
    state = lambda s: b.select("hash", F.lit(s).alias("state"), "content", "marked")
    return R.cached_fetch(state("held").where("hash % 10 <> 7"), state("recent"), "hash", "marked", "2024-01-01", "2024-01-02")


_TEXT = lambda c, none: f"coalesce(nullif({c}::VARCHAR, ''), '{none}')"


@query(
    "repository_text_Q12",
    f"""WITH {_LANDED} SELECT id, 'Type: ' || type || chr(10) || 'Name: ' || {_TEXT("name", "")} || chr(10) || 'Description: ' || {_TEXT("description", "No description")} || chr(10) || 'Language: ' || {_TEXT("language", "Not specified")}
        || chr(10) || 'Stars: ' || {_TEXT("stars", "0")} || chr(10) || 'Topics: ' || {_TEXT("array_to_string(topics, ', ')", "None")} || chr(10) || 'Author: ' || {_TEXT("author", "Unknown")}
        || chr(10) || 'Created: ' || created_at || chr(10) || 'Updated: ' || updated_at || chr(10) AS told FROM landed""",
)
def repository_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = repositories(spark, sf_dir)
    return landed.select("id", R.repository_text(landed).alias("told"))


_MEDIA = """CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Media attachments:' || chr(10) || '  1. Type: image, Description: ' || coalesce(nullif(source, ''), 'No description') || chr(10)
    ELSE 'Media attachments:' || chr(10) || '  1. Type: image, Description: ' || coalesce(nullif(source, ''), 'No description') || chr(10) || '  2. Type: video, Description: No description' || chr(10) END"""


@query(
    "status_text_Q12",
    rf"""WITH s AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN regexp_extract_all(lower(text), '[a-z]{{10,}}', 0) ELSE [] END AS tags FROM documents)
    SELECT doc_id, 'Status: ' || coalesce(text, '') || chr(10) || 'Created at: 2024-01-' || (10 + doc_id % 20) || chr(10) || {_MEDIA}
        || CASE WHEN len(tags) > 0 THEN 'Existing tags: ' || array_to_string(tags, ', ') || chr(10) ELSE '' END || 'Visibility: ' || CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'unlisted' END || chr(10)
        || 'Language: ' || coalesce(nullif(lang, ''), 'unknown') || chr(10) AS told FROM s""",
)
def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, video = "named_struct('type', 'image', 'description', source)", "named_struct('type', 'video', 'description', cast(null AS string))"
    s = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text AS content", "'2024-01-' || (10 + doc_id % 20) AS created_at", f"CASE doc_id % 3 WHEN 1 THEN array({image}) WHEN 2 THEN array({image}, {video}) END AS media",
        "CASE WHEN doc_id % 4 > 0 THEN regexp_extract_all(lower(text), '[a-z]{10,}', 0) END AS tags", "CASE WHEN doc_id % 2 = 0 THEN 'public' ELSE 'unlisted' END AS visibility", "lang AS language",
    )
    return s.select("doc_id", R.status_text().alias("told"))


@query(
    "line_tags_Q12",
    r"""WITH r AS (SELECT doc_id, replace(regexp_replace(text, '[.!?] ', chr(10) || ' #', 'g'), ', ', chr(10) || '##') AS reply FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, list_filter(list_transform(string_split(reply, chr(10)), lambda t: regexp_replace(regexp_replace(t, '#', ''), '^\s+|\s+$', '', 'g')), lambda t: t <> '') AS tags FROM r""",
)
def tags_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    reply = F.replace(F.regexp_replace("text", "[.!?] ", "\n #"), F.lit(", "), F.lit("\n##"))
    return docs.select("doc_id", R.line_tags(reply).alias("tags"))


#: A page's address as people write it, in words that Spark and DuckDB share.
_WRITTEN = """CASE page_id % 7 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN regexp_replace(url, '^http://([^/]+)', 'http://{one}:80') WHEN 3 THEN regexp_replace(url, '[?].*$', '') || ' a/é?q=a b'
    WHEN 4 THEN 'HTTPS://' || regexp_replace(url, '^https?://([^/]+).*$', '{one}') WHEN 5 THEN regexp_replace(url, '^https?://[^/]*', 'https://EXAMPLE.org:8080') ELSE 'http://a b/' END"""


@query(
    "clean_url_L3",
    rf"""WITH w AS (SELECT page_id, {_WRITTEN.format(one=chr(92) + "1")} AS written FROM pages), s AS (SELECT *, trim(written) AS t FROM w),
    u AS (SELECT *, CASE WHEN starts_with(t, 'http://') OR starts_with(t, 'https://') THEN t ELSE 'https://' || t END AS u FROM s),
    p AS (SELECT *, regexp_extract(u, '^(https?)://', 1) AS scheme, lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(u, '^https?://[^/?#:]+:([0-9]*)', 1) AS port, regexp_extract(u, '^https?://[^/?#]+(.*)$', 1) AS rest FROM u),
    r AS (SELECT *, replace(replace(CASE WHEN starts_with(rest, '/') THEN rest WHEN starts_with(u, 'https://HTTPS:') THEN '/' || rest ELSE '/' || rest END, ' ', '%20'), 'é', '%C3%A9') AS path FROM p)
    SELECT page_id, written, CASE WHEN NOT contains(host, ' ') THEN scheme || '://' || host || CASE WHEN port IN ('', '80') AND NOT (port = '80' AND scheme = 'https') THEN '' ELSE ':' || port END || path END AS clean FROM r""",
)
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "pages").select("page_id", F.expr(_WRITTEN.format(one="$1")).alias("written"))
    return written.withColumn("clean", T.clean_url(F.col("written")))
