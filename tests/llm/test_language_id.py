import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language_id as L
from marginalia.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op2_hyperdimensional"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = got.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_vector(text, dimension=L.DIMENSION):
    """Letters, binding and bundling one n-gram at a time."""
    x = [0]
    for c in (text or "").lower():
        code = ord(c) if c.isalpha() else 0
        if code or x[-1]:
            x.append(code)
    x += [0] if x[-1] else []
    if not any(x):
        return None
    base = dict(zip(sorted(set(x)), L.letter_vectors(np.array(sorted(set(x))), dimension, L.SEED).astype(int)))
    total = 0
    for (a, b, c), n in Counter(zip(x, x[1:], x[2:])).items():
        total = total + n * np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return total / np.linalg.norm(total)


def test_predictions_equal_a_plain_version(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [(9000, "Пример русского текста для проверки", "ru"), (9003, "これは日本語の文章です。漢字もあります", "ja"), (9006, "ещё один русский текст", None), (9009, None, None)]
    vectors = {i: plain_vector(t) for i, t, _ in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, _, lang in docs:
        if lang and not held(i) and vectors[i] is not None:
            sums[lang] = sums.get(lang, 0) + vectors[i]
    sums = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.identified(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).collect()}
    for i, v in vectors.items():
        cos = {k: float(v @ p) for k, p in sums.items()} if v is not None else {}
        want = max(cos, key=cos.get, default="und")
        assert got[i]["lang_pred"] == want and abs(got[i]["score"] - max(0, cos.get(want, 0))) < 1e-4


def test_vectors_of_letters_differ_and_are_bundled():
    e = L.Encoder(64)
    for t in ("Ab, ba", "šb ůp ţd ųt", "漢字 кот"):
        assert np.allclose(e.vector(t), plain_vector(t, 64), atol=1e-5)
    v = L.letter_vectors(np.array([ord(c) for c in "šbůpţdųtкабвг漢字"]), 1024, L.SEED).astype(int)
    assert np.abs(v @ v.T - 1024 * np.eye(len(v))).max() < 200
    assert np.array_equal(L.letters("AB!!ba"), L.letters("ab ba")) and e.vector("12 !") is None and e.vector(None) is None


def test_more_letters_than_are_kept(monkeypatch):
    monkeypatch.setattr(L, "LETTERS", 5)
    few = L.Encoder(64)
    for t in ("the cat sat on the mat", "漢字かな交じり文", "кот и пёс"):
        assert np.allclose(few.vector(t), plain_vector(t, 64), atol=1e-5)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 2)
    df = spark.createDataFrame([(i, "abc def", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.identified(df, F.lit(True))


def test_more_ngrams_than_are_kept(monkeypatch):
    monkeypatch.setattr(L, "KEPT", 4)
    few, many = L.Encoder(32), None
    monkeypatch.setattr(L, "KEPT", 4096)
    many = L.Encoder(32)
    for t in ("the cat sat on the mat", "another text here", "zz"):
        assert np.allclose(few.vector(t), many.vector(t), atol=1e-5)


def test_edges(spark):
    rows = [(1, "aaa bbb aaa bbb", "x"), (2, "ccc ddd ccc", "y"), (3, None, "x"), (4, "", None), (5, "123 !?", "y"), (6, "aaa bbb", None), (6, "aaa bbb", None), (7, "c" * 200_000 + "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine")).withColumn("extra", F.lit(1)).withColumn("__p", F.lit(2)).withColumn("Lang_Pred", F.lit("x"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identified(df, F.lit(True)).collect()}
    assert out[3] == out[4] == out[5] == ("und", 0.0) and out[6][0] == "x" and out[7][0] == "y" and out[1][0] == "x"
    assert L.identified(df.limit(0), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in L.identified(df, F.lit(False)).collect()} == {"und"}
