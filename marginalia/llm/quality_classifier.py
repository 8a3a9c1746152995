"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A document is a bag of passages and only the bag has a label. Every passage of the whole text is encoded, a gated
attention weighs the passages, and the weighted sum of their codes is scored; encoder, attention and scorer are learnt
together from document labels. Training takes a bounded sample of labelled documents; scoring is a pass over all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import carried, written
from .shingles import word_bounds, word_hashes

#: Words of a passage; buckets of hashed byte pairs.
PASSAGE, PAIRS = 64, 48
#: Bounds of the training sample: labelled documents (the first by a hash of their id), and their passages in all. A
#: document of the sample comes with all its passages; one that alone has more than an eighth of the bound is left out.
SAMPLE, SAMPLE_PASSAGES = 4000, 200_000
#: Units of the encoder and of the attention, and training.
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 40, 256, 0.01, 1e-3, 5

THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0

# Classes of bytes, whose shares describe a passage.
_CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)  # other signs
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 7

WIDTH = _CLASSES + 6 + PAIRS


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of a text; one row of zeros for a text without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros((1, WIDTH), np.float32)
    words = word_hashes(raw, starts, ends)
    of_word = np.arange(len(starts)) // PASSAGE
    n = int(of_word[-1]) + 1
    first = starts[np.arange(n) * PASSAGE]
    first[0] = 0
    of_byte = np.repeat(np.arange(n), np.diff(np.append(first, len(raw))))
    size = np.bincount(of_byte, minlength=n)[:, None]
    shares = np.bincount(of_byte * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, -1) / size
    pairs = ((raw[:-1].astype(np.uint32) * 31 + raw[1:]) * 2654435761 >> 7) % PAIRS
    pairs = np.bincount(of_byte[:-1] * PAIRS + pairs, minlength=n * PAIRS).reshape(n, -1) / size
    count = np.bincount(of_word, minlength=n)
    order = np.lexsort((words, of_word))
    new = np.ones(len(words), bool)
    new[1:] = (np.diff(words[order].view(np.int64)) != 0) | (np.diff(of_word[order]) != 0)
    distinct = np.bincount(of_word[order], weights=new, minlength=n) / count
    again = np.zeros(len(words))
    again[1:] = words[1:] == words[:-1]
    again = np.bincount(of_word, weights=again, minlength=n) / count
    whole = len(np.unique(words)) / len(words)
    rest = np.stack([np.log(count), np.log(size[:, 0]), size[:, 0] / count / 10, distinct, again, np.full(n, whole)], axis=1)
    return np.concatenate([shares, rest, np.sqrt(pairs)], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        x = (np.concatenate(bags) - self.mean) / self.scale
        return _forward(self.weights, np.clip(x, -8, 8), np.cumsum([0] + [len(b) for b in bags])[:-1])["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """``at``: where each bag begins in ``x``."""
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (v * u) @ w["a"]
    bag = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, at)
    out = (f["p"] - y) / len(y)
    dz = out[:, None] * w["c"]
    da = (dz[f["bag"]] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, at)[f["bag"]])
    gate = de[:, None] * w["a"]
    dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
    dh = f["a"][:, None] * dz[f["bag"]] + dv @ w["V"].T + du @ w["U"].T
    inner = dh * (1 - f["h"] ** 2)
    return {
        "W": x.T @ inner, "b": inner.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ out, "d": out.sum()
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS, batch: int = BATCH) -> Model:
    """Adam on the log loss of ``batch`` bags at a time; bags in a fixed order give the same model again."""
    x = np.concatenate(bags)
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(())}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for own in (order[i : i + batch] for i in range(0, len(order), batch)):
            some = [bags[i] for i in own]
            part, at = np.clip((np.concatenate(some) - mean) / scale, -8, 8), np.cumsum([0] + [len(b) for b in some])[:-1]
            t += 1
            for k, g in _gradients(w, part, at, labels[own]).items():
                g = g + DECAY * w[k] * (k not in "bd")
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, passages_in_all: int = SAMPLE_PASSAGES) -> Model | None:
    """A model from ``labels`` (doc_id, quality 0 or 1) outside the held-out fold and the texts of their documents.

    At most ``sample`` labels are used, by the least hash of their id, and of these documents as many as have
    ``passages_in_all`` passages together. An id with several labels or texts counts once, with the least of each. Null
    ids, null labels and labels other than 0 and 1 are left out. None without any label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))
    taken = known.withColumn("place", place).orderBy("place", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "place").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bags = [passages(t) for t in f["text"]]
            yield pd.DataFrame({"place": f["place"], "quality": f["quality"], "n": [len(x) for x in bags], "x": [x.astype("<f4").tobytes() for x in bags]})

    encoded = written(texts.mapInPandas(encode, "place string, quality int, n long, x binary"), "bags")
    encoded = encoded.where(F.col("n") * 8 <= passages_in_all)
    so_far = F.sum("n").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))  # of the sample's rows at most
    last = encoded.select("place", so_far.alias("so_far")).where(F.col("so_far") <= passages_in_all).agg(F.max("place")).first()[0]
    rows = sorted(encoded.where(F.col("place") <= F.lit(last)).collect(), key=lambda r: r["place"])
    if not rows:
        return None
    bags = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, WIDTH) for r in rows]
    return fit(bags, np.array([float(r["quality"]) for r in rows]), seed)


def scorer(model: Model | None) -> Callable[[Column], Column]:
    """A column function: the score of a whole text, 0 to 1; 0.5 for all without a model."""

    @F.pandas_udf("double")
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            parts = [np.full(len(texts), 0.5)] if model is None else [model.scores([passages(t) for t in texts.iloc[i : i + 64]]) for i in range(0, len(texts), 64)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 is likelier) and predicted (1 from ``threshold`` on).

    A null or empty text, and one without words, is a bag of one empty passage and gets that bag's score; equal texts
    get equal scores. Columns of ``docs`` of these names, in any case, are replaced, all others stay; an empty table gives
    an empty one.
    """
    model = train(docs, labels, sample)
    rows = carried(docs, ["score", "predicted"], score=scorer(model)(F.col("text")))
    return rows.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(docs, labels).select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
