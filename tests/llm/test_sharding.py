import zlib

from pyspark.sql import functions as F

from marginalia.llm import sharding
from marginalia.llm.queries import ORACLES, QUERIES


def brute(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_same_as_sql(same):
    same(QUERIES["op1_jump_sharding"], ORACLES["op1_jump_sharding"])


def test_published_algorithm(spark, sf_dir):
    rows = QUERIES["op1_jump_sharding"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (brute(r["doc_id"], 24), brute(r["doc_id"], 25))
        assert r["grown_shard"] in (r["shard"], 24)
        assert r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["size"] == len(docs[r["doc_id"]].encode()) + 8


def test_edges(spark):
    df = spark.createDataFrame([(-5, "a"), (None, "b"), (7, "c"), (7, "c"), (2**62, None)], "doc_id long, shard string").withColumn("slot", F.lit("x"))
    out = sharding.shard(df.withColumnRenamed("slot", "note"), "doc_id", 3).collect()
    assert len(out) == 5
    for r in out:
        key = r["doc_id"] or 0
        assert r["shard"] == brute(key, 3) and r["grown_shard"] == brute(key, 4)
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard(df.limit(0).drop("slot")).count() == 0
    names = sharding.shard(spark.createDataFrame([("k1",), (None,), ("k2",)], "name string"), "name", 5).collect()
    assert all(0 <= r["shard"] < 5 for r in names)
