"""Queries of the rules that judge relationships by their documents, on relationships made of the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import document_rules as R
from ..sources.items import table
from .registry import registry
from .text import HOST, _NAME

Q, SQL, query = registry()

#: Fields of a relationship by the document's number, the same text in both dialects but for word(n).
_CASES = {
    "subject": "CASE doc_id % 6 WHEN 0 THEN 'masked officers' WHEN 1 THEN concat({w0}, ' ', {w1}) WHEN 2 THEN 'Jane Doe' WHEN 3 THEN {w0} WHEN 4 THEN 'systems' ELSE {w2} END",
    "object": "CASE doc_id % 7 WHEN 0 THEN 'software engineer' WHEN 1 THEN concat({w3}, ' ', {w4}) WHEN 2 THEN 'video about cats' WHEN 3 THEN 'homebrew' WHEN 4 THEN {w5} WHEN 5 THEN 'GitHub' ELSE {w1} END",
    "subject_type": "CASE doc_id % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Tool' ELSE 'Model' END",
    "object_type": "CASE doc_id % 5 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Artwork' WHEN 2 THEN 'Tool' WHEN 3 THEN 'Project' ELSE 'Person' END",
    "predicate": """CASE doc_id % 11 WHEN 0 THEN 'WORKS_FOR' WHEN 1 THEN 'LEADS' WHEN 2 THEN 'MEMBER_OF' WHEN 3 THEN 'ADVISES' WHEN 4 THEN 'FOUNDED' WHEN 5 THEN 'DEVELOPS' WHEN 6 THEN 'OWNS'
        WHEN 7 THEN 'USES' WHEN 8 THEN 'HOSTED_ON' WHEN 9 THEN 'CREATED' ELSE 'FUNDS' END""",
    "claim_mode": "CASE WHEN doc_id % 9 = 0 THEN 'reported' ELSE 'asserted' END",
    "evidence": """CASE doc_id % 6 WHEN 1 THEN substring(text, 1, 60) WHEN 2 THEN 'it was built by a maintainer' WHEN 3 THEN 'uploaded a video: brew install it' WHEN 4 THEN 'never said here at all'
        WHEN 5 THEN 'it was founded and is owned by them' END""",
    "url": """CASE doc_id % 5 WHEN 0 THEN 'https://github.com/a/b' WHEN 1 THEN 'https://www.nytimes.com/x' WHEN 2 THEN 'https://youtube.com/watch?v=1' WHEN 3 THEN 'https://a.example/b' END""",
    "title": "CASE WHEN doc_id % 8 = 0 THEN concat(substring(text, 1, 60), ' | site') ELSE substring(text, 1, 60) END",
    "summary": "CASE WHEN doc_id % 3 = 0 THEN 'Jane Doe wrote GitHub tools' END",
}


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {f"w{i}": f"coalesce(get(split(text, ' ', 7), {i}), '')" for i in range(6)}
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS content", *[f"{e.format(**words)} AS {c}" for c, e in _CASES.items()])


_WORDS = {f"w{i}": f"coalesce(list_extract(string_split(text, ' '), {i + 1}), '')" for i in range(6)}


def _any(c: str, words: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ", false)"


def _match(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _quote(c: str) -> str:
    return _match(rf"regexp_replace({_NAME.format(c)}, '[\"''`]+', '', 'g')")


def _regexes(c: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(c, p.replace("'", "''")) for p in patterns) + ")"


_BARE = _NAME.format("object")
_OCCUPATION = rf"""(lower({_BARE}) <> '' AND length({_BARE}) <= 80 AND NOT regexp_matches(lower({_BARE}), '^(the|a|an)\s+') AND NOT regexp_matches({_BARE}, '[,:;()\[\]{{}}0-9]')
    AND len(string_split_regex({_BARE}, '\s+')) <= 6 AND ({" OR ".join(f"lower({_BARE}) = '{t}' OR ends_with(lower({_BARE}), ' {t}')" for t in R.OCCUPATIONS)}))"""
_MEDIA = f"""({_BARE} <> '' AND ({" OR ".join(f"lower({_BARE}) = '{t}' OR starts_with(lower({_BARE}), '{t} ')" for t in R.MEDIA)} OR {_regexes(_BARE, (R.MEDIA_WITH_ARTICLE,))}
    OR {_regexes(_BARE, (R.MEDIA_NOUN,))} AND {_regexes(_BARE, (R.MEDIA_VERB,))}))"""
_VIDEO = f"({_any('url', ('youtube.com/', 'youtu.be/'))} OR {_any('title', ('youtube',))} OR {_any('content', (' - youtube', 'youtube.com/watch'))})"
_ARTICLE = f"""((length(content) >= 1200 OR length(content) >= 700 AND len(regexp_extract_all(content, '{R.SENTENCE_END.replace("'", "''")}')) >= 6
    OR {_any("title", (*R.ARTICLE_TITLES, *R.ARTICLE_WORDS))} OR {_any("host", R.ARTICLE_HOSTS)} OR {_any("content", (*R.ARTICLE_WORDS, *R.ARTICLE_TEXTS))}) AND NOT {_VIDEO} AND host <> 'github.com')"""
_HUMAN = r"regexp_matches({0}, '^[A-Z][A-Za-z''.-]+( [A-Z][A-Za-z''.-]+){{1,3}}$')"
RELS = f"""rels AS (SELECT doc_id, text AS content, {", ".join(f"{e.format(**_WORDS)} AS {c}" for c, e in _CASES.items())} FROM documents),
hosted AS (SELECT *, {HOST.format("url")} AS host, coalesce(nullif(evidence, ''), content) AS backing FROM rels),
d AS (SELECT *, host = 'github.com' AS github, {_ARTICLE} AS article, {_VIDEO} AND length(content) < {R.THIN} AND content <> '' AND {_any("content", R.SHELLS)} AS thin,
    CASE WHEN host = 'github.com' THEN coalesce(summary, '') ELSE '' END AS more FROM hosted)"""
_ACTOR = lambda c: _regexes(f"lower({_NAME.format(c)})", T.GENERIC_ACTORS)
_PEOPLE = "('Person', 'Organization')"
_DROP = f"""CASE WHEN subject_type IN {_PEOPLE} AND {_ACTOR("subject")} OR object_type IN {_PEOPLE} AND {_ACTOR("object")} THEN 'generic actor'
    WHEN predicate IN ('WORKS_FOR', 'LEADS', 'MEMBER_OF', 'ADVISES') AND object_type = 'Organization' AND {_OCCUPATION} THEN 'occupation'
    WHEN predicate = 'CREATED' AND article AND object_type = 'Artwork' AND {_MEDIA} AND {_any("evidence", R.MEDIA_MAKING)} THEN 'media'
    WHEN github AND (subject_type = 'Person' AND NOT {_HUMAN.format(_NAME.format("subject"))} OR object_type = 'Person' AND NOT {_HUMAN.format(_NAME.format("object"))}) THEN 'no person'
    WHEN github AND predicate IN ('INTEGRATES_WITH', 'HOSTED_ON') AND {_any("backing", R.INSTALLED)} THEN 'install'
    WHEN github AND predicate = 'HOSTED_ON' AND object_type = 'Organization' AND {_match("object")} = 'github' THEN 'host'
    WHEN github AND (ends_with(lower(object), '/tap') OR regexp_matches(object, '(?i)\\bhomebrew\\b')) THEN 'package' END"""
_BUILT = f"""CASE WHEN github AND predicate = 'FOUNDED' AND subject_type = 'Person' AND object_type IN ('Tool', 'Model', 'Dataset', 'Project') AND NOT {_any("backing", R.FOUNDED)} AND {_any("backing", R.DEVELOPED)}
    THEN 'DEVELOPS' ELSE predicate END"""


@query("rel_rewrite_G2", f'WITH {RELS} SELECT doc_id, subject, {_BUILT} AS predicate, object, {_DROP} AS "drop" FROM d')
def rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rewritten(relationships(spark, sf_dir)).select("doc_id", "subject", "predicate", "object", "drop")


_TEXTS = ("title", "coalesce(url, '')", "content", "more")
_IN = lambda c: f"({_match(_NAME.format(c))} <> '' AND (" + " OR ".join(f"contains({_match(_NAME.format(t))}, {_match(_NAME.format(c))})" for t in _TEXTS) + "))"
_QUOTED = f"coalesce(length({_quote('evidence')}) >= 16 AND (" + " OR ".join(f"contains({_quote(t)}, {_quote('evidence')})" for t in ("title", "content", "more")) + "), false)"
_SIGNAL = "CASE " + " ".join(f"WHEN predicate = '{p}' THEN {_any('content', w)}" for p, w in R.FORMAL.items()) + " ELSE true END"
_REASON = f"""CASE WHEN NOT {_IN("subject")} THEN 'subject not in document' WHEN NOT {_IN("object")} THEN 'object not in document' WHEN thin THEN 'thin video page' WHEN claim_mode = 'reported' THEN NULL
    WHEN NOT {_SIGNAL} THEN 'no formal signal' WHEN predicate = 'DEVELOPS' AND NOT {_any("backing", R.DEVELOPED)} THEN 'no sign of development'
    WHEN coalesce(evidence <> '', false) AND (article OR github) AND NOT {_QUOTED} THEN 'evidence not in document'
    WHEN predicate = 'FOUNDED' AND NOT {_any("backing", R.FOUNDED)} THEN 'no sign of founding' WHEN predicate = 'OWNS' AND NOT {_any("backing", R.OWNED)} THEN 'no sign of ownership'
    WHEN subject_type IN ('Tool', 'Model') AND predicate = 'USES' AND {_regexes("subject", (R.NO_USERS,))} THEN 'no user' END"""


@query("rel_low_value_G3", f"WITH {RELS} SELECT doc_id, subject, predicate, object, {_REASON} AS reason FROM d")
def low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.low_value(relationships(spark, sf_dir)).select("doc_id", "subject", "predicate", "object", "reason")


@query("document_kinds_F15", f"WITH {RELS} SELECT doc_id, github, article, {_VIDEO} AS video, thin FROM d")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, title, content = F.col("url"), F.col("title"), F.col("content")
    video = R.video_like(url, title, content)
    return relationships(spark, sf_dir).select(
        "doc_id", F.coalesce(R.github(url), F.lit(False)).alias("github"), R.article_like(url, title, content).alias("article"), video.alias("video"), (video & R.thin_shell(content)).alias("thin")
    )


@query("names_F10_F13", f"WITH {RELS} SELECT doc_id, {_OCCUPATION} AS occupation, {_MEDIA} AS media FROM d")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(spark, sf_dir).select("doc_id", R.occupation(F.col("object")).alias("occupation"), R.generic_media(F.col("object")).alias("media"))


@query("anchored_J14", f"WITH {RELS} SELECT doc_id, {_IN('subject')} AS subject_in, {_QUOTED} AS quoted FROM d")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relationships(spark, sf_dir).withColumn("more", F.when(R.github(F.col("url")), F.coalesce("summary", F.lit(""))).otherwise(""))
    texts = [F.coalesce(c, F.lit("")) for c in ("title", "url", "content", "more")]
    return r.select("doc_id", R.anchored(F.col("subject"), *texts).alias("subject_in"), R.evidence_anchored(F.col("evidence"), texts[0], texts[2], texts[3]).alias("quoted"))
