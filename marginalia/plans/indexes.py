"""Searches that are answered from written indexes. The queries build theirs first; ``operators`` opens a kept one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext as T
from ..operators import ivf
from ..operators import related as R
from ..sources.items import AS_OF, ITEMS_SQL, items, table
from .registry import registry
from .related import seeds

Q, SQL, query = registry()

_TERMS = rf"""WITH held AS (SELECT id, created_at, regexp_extract_all(lower(coalesce(content, '')), '{T.TERM}') AS ts FROM items),
    each_one AS (SELECT id, created_at, len(ts)::DOUBLE AS length, unnest(ts) AS term FROM held),
    postings AS (SELECT id, created_at, length, term, count(*)::DOUBLE AS n FROM each_one GROUP BY ALL),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T.TERM}')) AS term FROM benchmark)""".replace("WITH held", f"WITH {ITEMS_SQL}, held")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", "created_at", F.col("content").alias("text"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(
    "fulltext_all_terms_S15",
    f"""{_TERMS}, hits AS (SELECT query_id, id, created_at FROM q JOIN postings USING (term) JOIN (SELECT query_id, count(*) AS asked FROM q GROUP BY 1) USING (query_id)
        GROUP BY query_id, id, created_at, asked HAVING count(*) = asked)
    SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id)::INTEGER AS rank FROM hits) WHERE rank <= 20""",
)
def all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest items that have all words of a benchmark passage."""
    return T.matching(T.build(texts(spark, sf_dir), parts=16), benchmark(spark, sf_dir)).select("query_id", "id", "rank")


@query(
    "fulltext_ranked_S15",
    f"""{_TERMS}, dn AS (SELECT count(*)::DOUBLE AS items, avg(len(ts)) AS mean FROM held),
    w AS (SELECT query_id, q.term, ln(1 + (items - h + 0.5) / (h + 0.5)) AS idf FROM q JOIN (SELECT term, count(*)::DOUBLE AS h FROM postings GROUP BY 1) USING (term), dn),
    scored AS (SELECT query_id, id, sum(idf * n * {T.K1 + 1}::DOUBLE / (n + {T.K1}::DOUBLE * ({1 - T.B}::DOUBLE + {T.B}::DOUBLE * length / mean))) AS score FROM w JOIN postings USING (term), dn GROUP BY 1, 2)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM scored) WHERE rank <= 20""",
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a benchmark passage's words weigh most in."""
    return T.best(T.build(texts(spark, sf_dir), parts=16), benchmark(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("related_ivf_J11_M2")
def by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related items by embedding from the nearest cells of an index; nearly those of related_embedding_G9b (its recall is tested)."""
    i = items(spark, sf_dir, "embedding")
    return ivf.similar(seeds(i), ivf.build(i), after(), least=0.2).select("seed_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def after(days: int = R.DAYS) -> int:
    """The beginning of the window that ends at AS_OF, in microseconds."""
    from datetime import datetime, timedelta, timezone

    return int((datetime.fromisoformat(AS_OF).replace(tzinfo=timezone.utc) - timedelta(days=days)).timestamp()) * 1_000_000
