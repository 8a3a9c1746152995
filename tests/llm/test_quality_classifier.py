import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality_classifier as C
from marginalia.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op8_attention_mil"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(9, 5)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    draw = lambda *s: rng.normal(size=s)
    w = {"W": draw(5, 4), "b": draw(4), "V": draw(4, 3), "U": draw(4, 3), "a": draw(3), "c": draw(4), "d": np.array(0.3)}

    def loss(w):
        p = C._forward(w, x, at)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in C._gradients(w, x, at, y).items():
        for i in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(np.asarray(g)[i], abs=1e-6)


def test_attention_finds_the_passage_that_counts():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(200):
        bag = rng.normal(size=(8, C.WIDTH))
        bag[:, 0] = 0
        if i % 2:
            bag[rng.integers(8), 0] = 4
        bags.append(bag)
        labels.append(float(i % 2))
    model = C.fit(bags[:150], np.array(labels[:150]), epochs=150, batch=64)
    assert np.mean((model.scores(bags[150:]) > 0.5) == (np.array(labels[150:]) > 0.5)) > 0.85


def test_passages_cover_the_whole_text():
    x = C.passages("word " * (C.PASSAGE * 3 + 1))
    assert x.shape == (4, C.WIDTH) and C.passages(None).shape == C.passages(" \n").shape == (1, C.WIDTH)
    assert not np.array_equal(C.passages("a " * 500 + "XXX!!!")[-1], C.passages("a " * 500 + "a")[-1])


def plain_score(model, text):
    """Encoder, gated attention and scorer, passage by passage and unit by unit."""
    w, encoded, weights = model.weights, [], []
    for x in C.passages(text).astype(float):
        x = [max(-8.0, min(8.0, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale)]
        h = [math.tanh(sum(a * b for a, b in zip(x, w["W"][:, j])) + w["b"][j]) for j in range(C.HIDDEN)]
        dot = lambda m, j: sum(a * b for a, b in zip(h, m[:, j]))
        encoded.append(h)
        weights.append(math.exp(sum(w["a"][j] * math.tanh(dot(w["V"], j)) / (1 + math.exp(-dot(w["U"], j))) for j in range(C.ATTENTION))))
    z = [sum(e * h[j] for e, h in zip(weights, encoded)) / sum(weights) for j in range(C.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["c"])) + float(w["d"]))))


def test_scores_equal_a_plain_version(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = C.train(docs, labels)
    for r in docs.orderBy("n_chars").limit(60).unionByName(docs.orderBy(F.desc("n_chars")).limit(3)).withColumn("s", C.scorer(model)(F.col("text"))).collect():
        assert r["s"] == pytest.approx(plain_score(model, r["text"]), abs=1e-4)


def test_the_sample_is_bounded_in_passages(spark, monkeypatch):
    rows = [(i, "word " * (64 * (1 + i % 3))) for i in range(40)] + [(99, "word " * 64 * 50)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(C, "fit", lambda bags, *more: seen.append([len(b) for b in bags]))
    C.train(docs, labels, passages_in_all=40)
    C.train(docs, labels)
    assert 35 <= sum(seen[0]) <= 40 and seen[0] == [n for n in seen[1] if n <= 5][: len(seen[0])]
    assert len(seen[1]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows)


def test_edges(spark):
    rows = [(i, ("good words in a line " * 5) if i % 2 else "### $$$ %%%" * 9) for i in range(60)] + [(100, None), (101, ""), (7, "another text"), (None, "x"), (102, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("quality", F.lit(9)).withColumn("ROW", F.lit("r")).withColumn("Predicted", F.lit("p"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, None), (None, 1), (9, 5)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in C.scored(docs, labels).collect()}
    assert out[51]["predicted"] == 1 and out[50]["predicted"] == 0 and out[100]["score"] == out[101]["score"] and out[1]["quality"] == 9
    assert {r["score"] for r in C.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert C.scored(docs.limit(0), labels).count() == 0
