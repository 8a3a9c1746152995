import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from marginalia.llm import resampling as R
from marginalia.llm.common import written
from marginalia.llm.queries import ORACLES, QUERIES


def runs(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(run, n):
    return zlib.crc32(run.encode()) % n


def expected(docs, target, share, least, n=R.BUCKETS):
    s = Counter(bucket(x, n) for _, text in docs for x in runs(text)[1])
    t = Counter(bucket(x, n) for text in target for x in runs(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out = []
    for doc_id, text in docs:
        words, found = runs(text)
        weight = sum(gain(bucket(x, n)) for x in found) // len(found) if found else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): i for i, x in enumerate(able[: share * len(able) // 100], 1)}
    return Counter((*x[:4], ranks.get(id(x))) for x in out)


def got(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


DOCS = [(i, f"Alpha beta{i % 7} gamma {'straße Élan ' * (i % 5)} x{i}_y") for i in range(200)] + [(300, None), (301, ""), (302, "--- \t\x7f"), (None, "one two three"), (303, "w " * 50_000), (304, "Été\x00ÀB aB" * 3)]


@pytest.mark.parametrize(("share", "least"), [(25, 5), (100, 1), (0, 1), (50, 10**6)])
def test_as_by_hand(spark, share, least):
    target = ["alpha beta1 x", None, "gamma straße straße"]
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)
    assert got(R.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), share, least)) == expected(DOCS, target, share, least)


def test_few_buckets_and_longer_runs(spark):
    target = spark.createDataFrame([("beta1 gamma",)], "text string")
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert got(R.resample(df, target, 25, 5, buckets=16)) == expected(DOCS, ["beta1 gamma"], 25, 5, 16)
    assert R.features(b"a b c", 3)[1] == [zlib.crc32(x) for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]


def test_ties_and_repeated_rows(spark):
    rows = [(score, doc) for score in (5, -3, 0) for doc in [7] * 40 + [None] * 30 + list(range(10, 30))]
    table = written(spark.createDataFrame(rows, "score long, doc long").repartition(3).withColumn("nr", F.monotonically_increasing_id()), "test")
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for need in (0, 1, 39, 41, 60, 89, 90, 91, 200, 270):
        drawn = [(r["score"], r["doc"]) for r in table.where(R.highest(table, need)).collect()]
        assert sorted(drawn, key=order) == sorted(rows, key=order)[:need]


def test_edges(spark):
    target = spark.createDataFrame([], "text string")
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ["row", "nr", "doc", "bytes", "n_words", "range_part", "Score", "RANK"]})
    out = R.resample(df, target, 50, 1)
    assert sorted(c.lower() for c in out.columns) == sorted([*{c.lower() for c in df.columns} - {"score", "rank"}, "n_features", "weight", "score", "rank"])
    rows = out.collect()
    assert sorted((r["rank"] or 0) for r in rows) == [0, 1] and all(r["nr"] == "nr" and r["n_words"] == "n_words" for r in rows)
    assert R.resample(df.limit(0), target).count() == 0


def test_query(spark, sf_dir, same):
    same(QUERIES["op12_importance_resampling"], ORACLES["op12_importance_resampling"])
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_importance_resampling"](spark, sf_dir)) == expected(docs, target, 25, 20)
