import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import token_counts as C
from marginalia.llm.queries import QUERIES
from marginalia.llm.tokenise import default_path


@pytest.fixture(scope="module")
def count():
    return C.byte_counter(default_path("byte_bpe_50k.tiktoken"))


def test_recounts_equal_counting_anew(count):
    for seed in range(1500):
        random.seed(seed)
        signs, leaf = random.choice(["ab  \n.1é", "a b", "abc \t\n", "  a\x1c b'ts ", "ab1's.;中文。 ", "a9Z+/", "x''res1 \x85\u2028²\u0301"]), random.choice([1, 4, 16])
        some = lambda n: "".join(random.choice(signs) for _ in range(n))
        text = some(random.choice([0, 1, 5, 40, 200]))
        at = C.cut(text, leaf)
        sums = C.tree(count([text[a:b] for a, b in zip(at, [*at[1:], len(text)])]))
        assert sums[1] == count([text])[0]
        edits = [(a, a + random.choice([0, 0, 1, 3, 20]), some(random.choice([0, 1, 3, 30]))) for a in (random.randint(-1, len(text) + 1) for _ in range(random.choice([0, 1, 2, 5])))]
        new, at, sums, _ = C.recount(text, at, sums, edits, count, leaf)
        assert new == C.edited(text, C.ordered(edits, len(text))) and sums[1] == count([new])[0]
        m = len(sums) // 2
        assert sums[m : m + len(at)] == count([new[a:b] for a, b in zip(at, [*at[1:], len(new)])])
        assert all(sums[i] == sums[2 * i] + sums[2 * i + 1] for i in range(1, m))


def test_texts_without_spaces_have_many_leaves(count):
    random.seed(3)
    for text in ("".join(random.choice("abcXYZ0123456789+/") for _ in range(20_000)), "这是一个很长的句子，没有空格。" * 500):
        at = C.cut(text)
        assert len(at) > len(text) / (C.LEAF + 40)
        assert sum(count([text[a:b] for a, b in zip(at, [*at[1:], len(text)])])) == count([text])[0]


def test_chains_of_edits_take_every_leaf_once(count):
    text = " ".join(["ab"] * 20_000)
    at = C.cut(text, 4)
    sums = C.tree(count([text[a:b] for a, b in zip(at, [*at[1:], len(text)])]))
    edits = [(i, i + 1, "  " if i % 4 else "") for i, c in enumerate(text) if c == " "]
    new, at, sums, _ = C.recount(text, at, sums, edits, count, 4)
    assert sums[1] == count([new])[0] and new == C.edited(text, edits)


def test_query(spark, sf_dir, count):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_edit_aware_counts"](spark, sf_dir).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        new, n = re.subn(C.MASKED, C.MASK, text)
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) == (count([text])[0], n, count([new])[0])
        assert r["n_leaves_encoded"] <= 3 * n
    assert any(r["n_edits"] for r in rows) and sum(r["n_leaves_encoded"] for r in rows) < sum(r["n_leaves"] for r in rows) / 2


def test_edges(spark, count):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "d e"), (4, "x" * 50_000 + " y" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tree", F.lit(1)).withColumn("N_Encoded", F.lit("n")).withColumn("__t", F.lit(2)).withColumn("edits", F.lit("mine"))
    trees = C.with_trees(docs)
    edit = F.struct(F.lit(-3).alias("start"), F.lit(1).alias("end"), F.lit("new ").alias("text"))
    out = C.with_edits(trees, F.when(F.coalesce("doc_id", F.lit(0)) != 3, F.array(edit))).collect()
    for r in out:
        want = r["text"] or ""
        assert r["token_tree"][1] == count([want])[0] and r["tree"] == 1 and r["edits"] == "mine"
    assert {r["doc_id"]: r["n_encoded"] for r in out}[3] == 0
    assert {r["doc_id"]: r["text"] for r in out}[1] == "new "
    assert C.with_edits(trees.limit(0), F.array(edit)).count() == 0
