"""Queries of runs by version: the query writes some runs, and reads what stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V
from ..sources.items import table
from ..sources.stored import new_path
from .registry import registry

Q, SQL, query = registry()

SCHEMA = "id long, lang string, score long"

#: Runs: name, versions, time, whether it is complete, which documents it read, and what it found.
RUNS = (
    ("r1", "v1", "o1", "2024-01-01", True, "true", "doc_id % 7"),
    ("r2", "v2", "o1", "2024-01-03", True, "doc_id % 3 = 0", "doc_id % 11"),
    ("r3", "v2", "o2", "2024-01-05", False, "doc_id % 2 = 0", "doc_id % 13"),
    ("r4", "v1", "o2", "2024-01-02", True, "doc_id % 4 = 1", "doc_id % 17"),
)
_SELECTS = " UNION ALL ".join(f"SELECT doc_id AS id, lang, {found} AS score, '{n}' AS run, '{e}' AS extractor, '{o}' AS ontology, DATE '{at}' AS day, {str(done).lower()} AS complete FROM documents WHERE {which}" for n, e, o, at, done, which, found in RUNS)
_LAST = f"WITH r AS ({_SELECTS}) SELECT id, lang, score, run, extractor, ontology FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS k FROM r WHERE {{where}}) WHERE k = 1"


def runs(spark: SparkSession, sf_dir: str) -> str:
    """Every run is written, the second and third twice, and one more is begun and never ends."""
    path, docs = new_path(spark, "runs"), table(spark, sf_dir, "documents")
    for name, extractor, ontology, at, done, which, found in (*RUNS, RUNS[1], RUNS[2]):
        V.written(docs.where(which).selectExpr("doc_id AS id", "lang", f"{found} AS score"), path, name, extractor, ontology, at, done, parts=8)
    V.begun(docs.selectExpr("doc_id AS id", "lang", "-1L AS score"), path, "r2", "v2", "o1", parts=8)
    V.begun(docs.selectExpr("doc_id AS id", "lang", "-2L AS score"), path, "r5", "v3", "o3", parts=8)
    return path


@query("complete_runs_Q9_Q10", _LAST.format(where="complete"))
def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document what the last complete run found."""
    return V.read(spark, runs(spark, sf_dir), SCHEMA)


@query("partial_runs_Q10", _LAST.format(where="extractor = 'v2'"))
def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one extractor's runs, partial ones included."""
    return V.read(spark, runs(spark, sf_dir), SCHEMA, extractor="v2", include_partial=True)


@query(
    "run_changes_Q9",
    f"""WITH a AS ({_LAST.format(where="complete AND extractor = 'v1'")}), b AS ({_LAST.format(where="complete AND extractor = 'v2'")})
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.score IS DISTINCT FROM b.score""",
)
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which two versions of an extractor say different things."""
    path = runs(spark, sf_dir)
    return V.changed(spark, V.read(spark, path, SCHEMA, "v1"), V.read(spark, path, SCHEMA, "v2"), "id", ["score"]).select(F.col("id"), "change")
