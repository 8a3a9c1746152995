import math
import random

from pyspark.sql import functions as F

from marginalia.llm import topk as T
from marginalia.llm.queries import ORACLES, QUERIES


def test_same_as_sql(same):
    same(QUERIES["op5_exact_topk"], ORACLES["op5_exact_topk"])


def brute(queries, rows, k):
    out = []
    for qid, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid)
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_tiles_and_merges(spark):
    random.seed(3)
    rows = [(i, [float(random.randint(-3, 3)) for _ in range(4)]) for i in range(150)] + [(1000 + i, [2.0, 2.0, 0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, q array<double>").withColumn("score", F.lit("x"))
    got = T.top_k(df.where("vec_id % 20 = 0"), df, 7, query_bytes=200, shard_bytes=400)
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] % 20 == 0], rows, 7)


def test_edges(spark):
    big = float(2**40)
    rows = [(1, [1.0]), (2, [big, big]), (2, [1.0, 1.0]), (3, [big, 1.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, None), (None, [1.0]), (7, []), (8, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", T.quantised(F.col("v"), 64.0).alias("q"))
    assert {r["vec_id"] for r in df.where("q IS NOT NULL").collect()} == {None, 1, 2, 3, 7}
    got = sorted(map(tuple, T.top_k(df.where("vec_id IN (2, 3)"), df, 20).collect()))
    s = 64
    assert [x for x in got if x[0] == 2] == [(2, 1, 3, int(s * s * (2**40 + 1))), (2, 2, 1, s * s), (2, 3, 7, 0)]
    assert [x[2:] for x in got if x[0] == 3][:2] == [(2, min(2**63 - 1, int(s * s * (2**80 + 2**40)))), (2, int(s * s * (2**40 + 1)))]
    assert [x for x in got if x[0] == 3][0][2:] == (2, min(2**63 - 1, s * s * (2**80 + 2**40)))
    assert T.top_k(df.limit(0), df, 3).count() == 0 and T.top_k(df, df.limit(0), 3).count() == 0
    assert math.isfinite(got[0][3])


def test_repeated_ids_and_great_components(spark):
    huge = spark.createDataFrame([(1, [1e18, -1e18, 2.5, -0.001])], "vec_id long, v array<double>").select(T.quantised(F.col("v"), 64.0).alias("q")).first()["q"]
    assert huge == [6.4e19, -6.4e19, 160.0, -1.0]
    rows = [(7, [1.0, 2.0])] * 50 + [(i, [float(i % 3), 1.0]) for i in range(40)] + [(7, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, q array<double>").withColumn("SIDE", F.lit(3)).withColumn("Tile", F.lit("t"))
    got = T.top_k(df.where("vec_id IN (7, 20)"), df, 60, shard_bytes=600, least_shard=5)
    queries = [(7, min(v for i, v in rows if i == 7)), (20, [2.0, 1.0])]
    assert sorted(map(tuple, got.collect())) == brute(queries, rows, 60)
