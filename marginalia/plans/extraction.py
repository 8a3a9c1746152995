"""Queries of staged extraction, over replies made of the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from .graph import NORMAL, RAW
from .registry import registry
from .rules import _ARTICLE, _BUILT, _CASES, _DROP, _QUOTED, _REASON, _VIDEO, _WORDS, R, _any
from .rules import relationships as documents
from .text import HOST

Q, SQL, query = registry()

_FIELDS = ("subject", "subject_type", "predicate", "object", "object_type", "claim_mode", "evidence")
_MADE = {"subject": "{w0}", "subject_type": "'Person'", "predicate": "'CREATED'", "object": "{w3}", "object_type": "'Artwork'", "claim_mode": "'asserted'", "evidence": "cast(NULL AS {string})"}
_QUOTE = "substring(text, 1, 60)"

#: Which documents have a reply of each stage, and the one candidate that it holds.
REPLIES = {
    X.FIRST: ("doc_id % 13 <> 12", _CASES),
    X.REMAP: ("doc_id % 2 = 0", _MADE),
    X.REVIEW: ("doc_id % 3 = 1", _CASES | {"claim_mode": "'reported'", "evidence": "cast(NULL AS {string})"}),
    X.RECOVERY: ("doc_id % 5 <> 1", _MADE | {"object": "{w5}", "evidence": f"CASE WHEN doc_id % 4 <> 1 THEN {_QUOTE} END"}),
    X.RECOVERY_REVIEW: ("doc_id % 7 < 4", _MADE | {"object": "CASE WHEN doc_id % 3 <> 0 THEN {w5} ELSE {w4} END", "evidence": _QUOTE}),
}
_SOURCE = "CASE WHEN doc_id % 4 = 3 THEN 'arena' ELSE 'github' END"


def replies(docs: DataFrame) -> DataFrame:
    """id, stage, reply of documents (doc_id, text)."""
    words = {f"w{i}": f"w{i}" for i in range(6)} | {"string": "string"}
    named = {"subject": "source", "object": "target", "predicate": "relationship", "subject_type": "sourceType", "object_type": "targetType"}
    # a document is read once for all stages
    made = [f"CASE WHEN {where} THEN struct('{stage}' AS stage, struct(" + ", ".join(f"{fields[c].format(**words)} AS {named.get(c, c)}" for c in _FIELDS) + ") AS c) END" for stage, (where, fields) in REPLIES.items()]
    split = docs.selectExpr("doc_id", "substring(text, 1, 60) AS text", *[f"coalesce(get(split(text, ' ', 7), {i}), '') AS w{i}" for i in range(6)])
    out = split.selectExpr("doc_id AS id", f"inline(array_compact(array({', '.join(made)})))")
    return out.select("id", "stage", F.to_json(F.array("c")).alias("reply"))


def settled(spark: SparkSession, sf_dir: str, seen=None) -> DataFrame:
    docs = documents(spark, sf_dir)
    asked = docs.selectExpr("doc_id AS id", f"{_SOURCE} AS source", "url", "title", "summary", "content")
    return X.settled(spark, asked, replies(docs.select("doc_id", F.col("content").alias("text"))), seen)


def _stage(i: int, stage: str) -> str:
    where, fields = REPLIES[stage]
    fill = _WORDS | {"string": "VARCHAR"}
    return f"SELECT doc_id AS id, {i} AS n, {', '.join(f'{fields[c].format(**fill)} AS {c}' for c in _FIELDS)} FROM documents WHERE {where}"


_NEED = f"WHEN n >= 3 AND NOT (coalesce(evidence <> '', false) AND {_QUOTED}) THEN 'no evidence' WHEN subject_type IN ('Tool'"
_DOCUMENT = ", ".join(f"{_CASES[c].format(**_WORDS)} AS {c}" for c in ("url", "title", "summary"))
CASCADE = NORMAL.replace(
    f"WITH {RAW}",
    f"""WITH staged AS ({" UNION ALL ".join(_stage(i, s) for i, s in enumerate(REPLIES))}),
rels AS (SELECT id, n, subject, subject_type, object, object_type, predicate AS label, NULL::DOUBLE AS confidence, claim_mode FROM staged)""",
) + f""",
pages0 AS (SELECT doc_id AS id, text AS content, {_DOCUMENT}, {_SOURCE} AS source FROM documents),
pages1 AS (SELECT *, {HOST.format("url")} AS host FROM pages0),
docs AS (SELECT *, host = 'github.com' AS github, {_ARTICLE} AS article, {_VIDEO} AND length(content) < {R.THIN} AND content <> '' AND {_any("content", R.SHELLS)} AS thin,
    CASE WHEN host = 'github.com' THEN coalesce(summary, '') ELSE '' END AS more FROM pages1),
d AS (SELECT j.id, j.n, j.reject, j.claim_mode, j.subject, j.s AS subject_type, j.predicate, j.object, j.o AS object_type, s.evidence, coalesce(nullif(s.evidence, ''), content) AS backing,
    content, url, title, summary, host, github, article, thin, more FROM judged j JOIN staged s USING (id, n) JOIN docs USING (id)),
dropped AS (SELECT * EXCLUDE (predicate), {_BUILT} AS predicate, {_DROP} AS gone FROM d),
known AS (SELECT id, n, reject, reject IS NULL AND gone IS NULL AS fits, reject IS NULL AND gone IS NULL AND ({_REASON.replace("WHEN subject_type IN ('Tool'", _NEED)}) IS NULL AS strict,
    concat_ws('|', subject, predicate, object) AS k, struct_pack(subject := subject, subject_type := subject_type, predicate := predicate, object := object, object_type := object_type, claim_mode := claim_mode) AS r
    FROM dropped),
one AS (
    SELECT p.id, article, source = 'arena' AS block, length(content) >= {X.WORTH_RECOVERY} OR coalesce(summary, '') <> '' AS worth,
        CASE WHEN content = '' THEN 'empty_content' WHEN thin THEN 'thin_video_shell' WHEN f.id IS NULL THEN 'no_llm_response' END AS skipped,
        f.r AS fr, f.k AS fk, coalesce(f.strict, false) AS fs, coalesce(f.fits, false) AS ff, f.reject IS NOT NULL AS fx, m.r AS mr, coalesce(m.strict, false) AS ms, m.k AS mk,
        v.id IS NOT NULL AS reviewed, v.r AS vr, v.k AS vk, coalesce(v.strict, false) AS vs, c.r AS cr, c.k AS ck, coalesce(c.strict, false) AS cs, coalesce(c.fits, false) AS cf,
        w.id IS NOT NULL AS rereviewed, w.r AS wr, w.k AS wk, coalesce(w.strict, false) AS ws
    FROM docs p LEFT JOIN known f ON f.id = p.id AND f.n = 0 LEFT JOIN known m ON m.id = p.id AND m.n = 1 LEFT JOIN known v ON v.id = p.id AND v.n = 2
        LEFT JOIN known c ON c.id = p.id AND c.n = 3 LEFT JOIN known w ON w.id = p.id AND w.n = 4
),
s1 AS (SELECT *, CASE WHEN skipped IS NOT NULL THEN NULL WHEN fs THEN 'strict' WHEN ff AND (article OR block) THEN 'permissive' WHEN fx AND ms THEN 'remap' END AS b1 FROM one),
s2 AS (SELECT *, CASE WHEN b1 = 'remap' THEN mk WHEN b1 IS NOT NULL THEN fk END AS bk FROM s1),
s3 AS (SELECT *, CASE WHEN skipped IS NOT NULL THEN NULL WHEN reviewed THEN CASE WHEN vs THEN CASE WHEN vk = bk THEN b1 ELSE 'review' END END WHEN b1 <> 'permissive' THEN b1 END AS a1 FROM s2),
s4 AS (SELECT *, skipped IS NULL AND a1 IS NULL AND article AND worth AS again FROM s3),
s5 AS (SELECT *, CASE WHEN again AND cs THEN 'recovery' WHEN again AND cf THEN 'recovery permissive' END AS c1 FROM s4),
s6 AS (SELECT *, CASE WHEN NOT again THEN a1 WHEN rereviewed THEN CASE WHEN ws THEN CASE WHEN wk = ck AND c1 IS NOT NULL THEN c1 ELSE 'recovery review' END END WHEN c1 = 'recovery' THEN c1 END AS settled_by FROM s5),
s7 AS (SELECT *, CASE WHEN settled_by IS NULL THEN NULL WHEN again THEN CASE WHEN rereviewed THEN wr ELSE cr END WHEN reviewed THEN vr WHEN b1 = 'remap' THEN mr ELSE fr END AS r FROM s6)
"""


@query("extraction_G4", f"{CASCADE} SELECT id, 0 AS place, r.subject, r.subject_type, r.predicate, r.object, r.object_type, r.claim_mode, settled_by FROM s7 WHERE settled_by IS NOT NULL")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relationships(settled(spark, sf_dir))


@query(
    "extraction_diagnostics_A27",
    f"""{CASCADE} SELECT skipped, used_recovery, count(*) AS documents, {", ".join(f"sum({e})::BIGINT AS {c}" for c, e in zip(X.COUNTERS, (
        "(skipped IS NULL AND fr IS NOT NULL)::INTEGER", "(skipped IS NULL AND fx)::INTEGER", "(coalesce(b1, '') = 'remap')::INTEGER", "(b1 IS NOT NULL)::INTEGER", "(a1 IS NOT NULL)::INTEGER", "(c1 IS NOT NULL)::INTEGER",
        "(settled_by IS NOT NULL)::INTEGER", "(coalesce(r.claim_mode, '') = 'asserted')::INTEGER", "(coalesce(r.claim_mode, '') = 'reported')::INTEGER")))}
    FROM (SELECT *, again AS used_recovery FROM s7) GROUP BY ALL""",
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, sf_dir).groupBy("skipped", "used_recovery").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in X.COUNTERS])
