"""Every registered query of the archive against its SQL, and those without SQL for their invariants."""

import pytest
from pyspark.sql import functions as F

from marginalia import plans

WITH_SQL = sorted(plans.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(name, same):
    same(plans.queries()[name], plans.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["seed_id", "id"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_titles(spark, sf_dir):
    rows = plans.queries()["title_from_summary_F20"](spark, sf_dir)
    assert rows.where(F.length("made_title") > 103).count() == 0
    assert rows.where(F.col("made_title").isNotNull()).count() > 0


def test_meta_summaries_are_short(spark, sf_dir):
    assert plans.queries()["meta_summary_F21"](spark, sf_dir).where(F.length("meta_summary") > 140).count() == 0


def test_chunks_keep_all_sentences(spark, sf_dir):
    import re

    parts = plans.queries()["chunks_F26"](spark, sf_dir)
    kept = {r["doc_id"]: r["n"] for r in parts.groupBy("doc_id").agg(F.sum("chars").alias("n"), F.count(F.lit(1)).alias("k")).select("doc_id", (F.col("n") + F.col("k") - 1).alias("n")).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", r["text"]) if s]
        assert kept.get(r["doc_id"], 0) == max(0, sum(map(len, sentences)) + len(sentences) - 1)


def test_breaker_and_limiter(spark, sf_dir):
    states = plans.queries()["breaker_T8"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert states.count() == events
    assert {r["state"] for r in states.select("state").distinct().collect()} <= {"closed", "open", "half-open"}
    levels = plans.queries()["rate_level_T9"](spark, sf_dir)
    assert levels.count() == events and levels.where("level NOT BETWEEN 0 AND 5").count() == 0


def test_whole_texts_are_read(spark, tmp_path):
    from marginalia.plans import text as X

    start = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, f"{start} one"), (2, f"{start} two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"{start} Last")], "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["slug"][-3:] for r in X.Q["slug_whole_F4"](spark, tmp_path).collect()} == {"one", "two"}
    assert {r["token"][-3:]: r["n"] for r in X.Q["predicate_token_whole_F5"](spark, tmp_path).collect()} == {"ONE": 1, "TWO": 1}
    assert "Last" in {r["word"] for r in X.Q["junk_names_whole_F9"](spark, tmp_path).collect()}
