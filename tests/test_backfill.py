"""Tables brought up to date: ids stay, unchanged rows aren't written again, and all that is pointed to is there."""

from pyspark.sql import functions as F

from marginalia.operators import backfill as B
from marginalia.sources.items import items


def test_a_second_run_writes_nothing(spark, sf_dir):
    i = items(spark, sf_dir, "url").where("id < 60")
    first = B.brought_up(i, "2024-01-01")
    again = B.brought_up(i, "2024-01-02", first)
    for name, key in B.KEYS.items():
        assert {r["state"] for r in first[name].select("state").distinct().collect()} == {"added"}
        rows = again[name].select("state", "last_written").distinct().collect()
        assert [(r["state"], r["last_written"].day) for r in rows] == [("same", 1)]
        assert again[name].count() == again[name].select(key).distinct().count() == again[name].select("row_id").distinct().count()
    assert again["evidence"].where("document_id IS NULL OR target_id IS NULL").count() == 0
    assert again["claims"].where("subject_id IS NULL OR object_id IS NULL").count() == 0


def test_upsert_states(spark):
    table = lambda *rows: spark.createDataFrame(rows, "k string, v string, n int")
    one = B.upserted(None, table(("a", "x", 1), ("b", None, 2), ("c", "z", None)), "k", "2024-01-01")
    two = B.upserted(one, table(("a", "x", 1), ("b", "", 2), ("d", "new", 3)), "k", "2024-01-02")
    got = {r["k"]: (r["state"], r["v"], r["first_written"].day, r["last_written"].day) for r in two.collect()}
    assert got == {"a": ("same", "x", 1, 1), "b": ("changed", "", 1, 2), "c": ("kept", "z", 1, 1), "d": ("added", "new", 2, 2)}
    three = B.upserted(two, table(), "k", "2024-01-03")
    assert {r["state"] for r in three.collect()} == {"kept"} and three.where(F.col("last_written") > F.lit("2024-01-02").cast("timestamp_ntz")).count() == 0
