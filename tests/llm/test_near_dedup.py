import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import dart_minhash as D
from marginalia.llm import near_dedup as N
from marginalia.llm.queries import QUERIES
from marginalia.llm.shingles import hashed_words, mixed, shingles


def grams(text, width=5):
    """Weights of the shingles of a text: 1 + ln n of one that it has n times."""
    w = (text or "").lower().split()
    all_ = [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    return {g: 1 + math.log(n) for g, n in Counter(all_).items()}


def brute(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    sums = [sum(s.values()) for s in sets]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        few, many = sorted((sets[a], sets[b]), key=len)
        both = sum(min(w, many[g]) for g, w in few.items() if g in many)
        if (both >= 0.8 * (sums[a] + sums[b] - both) - 1e-9) if sets[a] or sets[b] else True:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op7_dart_minhash"](spark, sf_dir).collect()} == brute(rows)


def planted():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for c in range(10):
            w = list(base)
            for _ in range(random.randint(0, 4)):
                w[random.randrange(120)] = word()
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    rows += [(1000 + i, " ".join(word() for _ in range(80)) + " " + passage) for i in range(40)]
    return rows


def test_planted_groups_and_blocks(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r["doc_id"]: r["class_id"] for r in N.classed(df).collect()} == want
    monkeypatch.setattr(N, "BLOCK", 3)  # every bucket over several tiles
    assert {r["doc_id"]: r["class_id"] for r in N.classed(df).collect()} == want
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 200)
    assert {r["doc_id"]: r["class_id"] for r in N.classed(df).collect()} == want
    kept = N.deduplicated(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_edges(spark):
    rows = [(5, "One  two\nthree"), (3, "one two three"), (3, "one two three"), (9, "one two"), (7, None), (8, " \n "), (None, "solo text here"), (4, "a " * 60_000), (6, "a " * 60_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("root", F.lit(2))
    got = {(r["doc_id"], r["text"]): r["class_id"] for r in N.classed(df).collect()}
    assert got[5, "One  two\nthree"] == got[3, "one two three"] == 3 and got[9, "one two"] == 9
    assert got[7, None] == got[8, " \n "] == 7 and got[None, "solo text here"] is None and got[6, "a " * 60_001] == 4
    kept = N.deduplicated(df)
    assert kept.count() == 5 and kept.columns == df.columns
    assert N.classed(df.limit(0)).count() == 0 and N.deduplicated(df.limit(0)).count() == 0


def test_long_chains_are_one_component(spark):
    n = 60
    links = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(n)] + [(b"x", b"y"), (b"z", b"z")], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in N.components(links).collect()}
    assert got == {**{f"{i:03d}".encode(): b"000" for i in range(n + 1)}, b"x": b"x", b"y": b"x"}


def test_lists_that_repeat_lines_are_weighed(spark):
    line = lambda n: f"one two three four five six seven {n}\n"
    rows = [(1, line(1) * 40 + line(2)), (2, line(1) * 44 + line(2)), (3, line(1) * 2 + line(3)), (4, "".join(line(i) for i in range(9)))]
    got = {r["doc_id"]: r["class_id"] for r in N.classed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[2] == 1 and got[3] == 3


def test_what_a_leader_is_not_near_to_is_still_compared(spark, monkeypatch):
    """A chain in one bucket, of which only neighbours are near, over blocks of two texts."""
    monkeypatch.setattr(N, "BLOCK", 2)
    word = lambda i: f"w{i:03d}"
    rows = [(k, " ".join(word(k * 4 + i) for i in range(60))) for k in range(12)]
    texts = spark.createDataFrame([(k, t, f"{k:02d}".encode(), 56, [7]) for k, t in rows], "doc_id long, text string, key binary, n long, bands array<long>")
    keyed = texts.select(N.text_key(F.col("text")).alias("key"), "doc_id", "n", "bands")
    links = N.links_of(keyed, texts.select("doc_id", "text"), 5, 0.8)
    found = {r["node"]: r["root"] for r in N.components(links).collect()}
    want = brute(rows)
    assert set(want.values()) == {0} and len(found) == len(rows) and len(set(map(bytes, found.values()))) == 1


def test_copies_of_one_id_and_ids_of_many_texts(spark):
    rows = [(1, "a b c d e f")] * 5 + [(1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (None, "m n o p q"), (None, "m n o p q"), (None, "r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Row", F.lit("mine")).withColumn("KEY", F.lit(1)).withColumn("stays", F.lit(2))
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in N.deduplicated(df).collect())
    assert kept == [(0, "m n o p q"), (0, "r s t u v"), (1, "a b c d e f"), (1, "g h i j k l")]
    assert N.deduplicated(df).columns == df.columns


@pytest.mark.parametrize("j", [0.3, 0.8])
def test_agreement_estimates_jaccard(j):
    rng = np.random.default_rng(1)
    seen = []
    for _ in range(40):
        common, rest = rng.integers(0, 2**63, int(600 * j), dtype=np.uint64), int(300 * (1 - j))
        a, b = (np.concatenate([common, rng.integers(0, 2**63, rest, dtype=np.uint64)]) for _ in range(2))
        seen.append((D.signature(a, 240) == D.signature(b, 240)).mean())
    assert np.mean(seen) == pytest.approx(j, abs=0.02)


def test_weights_count():
    rng = np.random.default_rng(2)
    x, a = rng.integers(0, 2**63, 200, dtype=np.uint64), rng.random(200) * 4
    b = a * rng.uniform(0.5, 1.5, 200)
    seen = [(D.signature(mixed(x + np.uint64(t)), 240, a) == D.signature(mixed(x + np.uint64(t)), 240, b)).mean() for t in range(20)]
    assert np.mean(seen) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.02)
    assert D.signature(x[:0], 24) is None and D.signature(x, 24, np.zeros(200)) is None


def test_shingles_are_of_words():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" \n")) == len(shingles(None)) == 0
    assert np.array_equal(shingles("A  b\tc d\ne"), shingles("a b c d e")) and not np.array_equal(shingles("a b c d e"), shingles("b a c d e"))
    assert len(np.unique(hashed_words("ab ba aab abb b a"))) == 6
