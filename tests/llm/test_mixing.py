from pyspark.sql import functions as F

from marginalia.llm import mixing as M
from marginalia.llm.queries import ORACLES, QUERIES


def test_same_as_sql(same):
    same(QUERIES["op4_budget_mixing"], ORACLES["op4_budget_mixing"])


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "a", 1000), ("d1", "en", "a", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, held long")
    got = {tuple(r[:3]): r["given"] for r in M.leaf_budgets(df, {}, 400.5 / 3010, 1).collect()}
    # each domain 200; d0's languages 100 each; of en, a holds 10 only and b takes its rest
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 90, ("d0", "fr", "a"): 100, ("d1", "en", "a"): 200}


def test_a_short_domain_leaves_its_rest_to_the_others(spark):
    df = spark.createDataFrame([("d0", "en", "a", 30), ("d1", "en", "a", 500)], "domain string, lang string, source string, held long")
    got = {r["domain"]: r["given"] for r in M.leaf_budgets(df, {"domain": {"d0": 3, "d1": 1}}, 200.0 / 530, 1).collect()}
    assert got == {"d0": 30, "d1": 170}


def test_no_leaf_passes_its_budget_and_epochs_come_whole(spark):
    rows = [(i, "x" * (4 * (i % 7 + 1)), "en" if i % 2 else "fr", f"src{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.mix(df, weights={}, budget_share=1.3, max_epochs=2)
    total = df.agg(F.sum(M.tokens(F.col("text")))).first()[0]
    used = out.agg(F.sum("tokens")).first()[0]
    assert total * 1.25 < used <= total * 1.3
    per = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("e")).collect()
    assert {r["n"] for r in per} <= {1, 2} and all(r["n"] == r["e"] + 1 for r in per)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, M.mix(df.repartition(7), weights={}, budget_share=1.3, max_epochs=2).collect()))


def test_edges(spark):
    rows = [(None, None, None, None), (1, "", "en", "src1"), (1, "abcd" * 9, "en", "src1"), (1, "abcd" * 9, "en", "src1"), (2, "y" * 100_000, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("t")).withColumn("held", F.lit(1))
    out = M.mix(df, budget_share=1.0, weights={"lang": {"en": 0}})
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "held", "domain", "tokens", "epoch"}
    assert out.where("lang = 'en' AND tokens > 0").count() == 0
    assert M.mix(df.limit(0)).count() == 0
