"""Families of hosts by the longest domain, and the newest few of each bucket."""

import datetime as dt

from pyspark.sql import functions as F

from marginalia.operators import review as R


def test_the_longest_domain_decides(spark):
    hosts = ["a.b.example.org", "b.example.org", "example.org", "org", "notexample.org", "", None, "x.com", "a.b.example.org"]
    df = spark.createDataFrame(list(enumerate(hosts)), "id long, host string").withColumn("_best", F.lit(1))
    lists = {"all": ["org"], "one": ["example.org", "b.example.org"], "two": ["b.example.org", "z.a.b.example.org"]}
    got = {r["id"]: (r["family"], r["domain"], r["_best"]) for r in R.with_family(df.drop("_best"), "host", lists).withColumn("_best", F.lit(1)).collect()}
    assert got == {
        0: ("one", "b.example.org", 1), 1: ("one", "b.example.org", 1), 2: ("one", "example.org", 1), 3: ("all", "org", 1), 4: ("all", "org", 1), 5: (None, None, 1), 6: (None, None, 1),
        7: (None, None, 1), 8: ("one", "b.example.org", 1),
    }
    assert R.with_family(df.drop("_best").limit(0), "host", lists).count() == 0


def test_a_bucket_of_most_rows_is_cut_before_it_is_sorted(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("bucket"), (F.col("id") * 37 % 4999).alias("t"))
    top = R.newest_in(df.repartition(8), "bucket", 4, F.col("t").desc(), F.col("id").desc())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    rows = sorted((b, -t, -i) for i, b, t in df.collect())
    want = {(b, p + 1, -i) for name in ("hot", "rare") for p, (b, _, i) in enumerate([r for r in rows if r[0] == name][:4])}
    assert {(r["bucket"], r["place"], r["id"]) for r in top.collect()} == want


def test_what_is_passed_over(spark):
    long, day = "word " * 60, dt.datetime(2024, 1, 1)
    rows = [
        (1, "pinboard", "https://www.nytimes.com/a", "t", long), (2, "pinboard", "https://vox.com/a", "t", long), (3, "pinboard", "https://sub.nytimes.com/a", "t", long), (4, "pinboard", None, "t", long),
        (5, "pinboard", "https://github.com/a", "t", "short"), (6, "arena", None, None, long), (7, "arena", "https://a.example/x.png?y", "t", long), (8, "arena", "https://reddit.com/r", "t", long),
        (9, "arena", "https://a.example/", "t", "x" * 300), (10, "arena", "", "t", long + "photo.jpg"), (11, "pinboard", "https://github.com/b", "t", None), (12, "pinboard", "https://github.com/c", "t", long),
    ]
    df = spark.createDataFrame([(*r, day + dt.timedelta(minutes=r[0])) for r in rows], "id long, source string, url string, title string, content string, updated_at timestamp_ntz")
    assert {(r["bucket"], r["place"], r["id"]) for r in R.review_batch(df).collect()} == {("news", 1, 1), ("codeResearch", 1, 12), ("arenaText", 1, 6)}
