"""Language identification by hyperdimensional profiles (Joshi, Halseth and Kanerva, 2016).

Each letter has a random vector of +1 and -1, made of hashes of its code point. The vector of an n-gram binds (multiplies) its letters' vectors, each
permuted once for every place before the last; a document's vector bundles (adds) those of its n-grams, and a
language's prototype those of its documents at equal length. The language whose prototype has the greatest cosine with
a document wins. Prototypes are added up in Spark, one row a language and component, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, emptied, written
from .quality_classifier import fold
from .shingles import mixed

DIMENSION, GRAM, SEED = 1024, 3, 11
FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"

#: Letters and n-grams whose vectors a worker keeps; whole parts that a unit is counted in when documents are added up.
LETTERS, KEPT, PARTS = 256, 16_384, 1 << 20

#: Languages that may be told apart: their prototypes, a vector each, come to the driver.
LANGUAGES = 10_000


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """The code points of letters, whatever their case, and 0 for each stretch of other characters; begins and ends with 0."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.zeros(len(codes) + 2, np.int64)
    x[1:-1] = np.where(_is_letter()[codes], codes, 0)
    return x[(x != 0) | (np.append(1, x[:-1]) != 0)]


def letter_vectors(codes: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point (or 0 for a gap): the bits of hashes of it."""
    words = np.arange(-(-dimension // 64), dtype=np.uint64) + np.uint64(seed << 32)
    bits = mixed(mixed(codes.astype(np.uint64) + np.uint64(1))[:, None] + words[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimension].astype(np.int8) * 2 - 1


class Encoder:
    """Unit vectors of texts; the vectors of frequent letters and n-grams are kept between texts."""

    def __init__(self, dimension: int = DIMENSION, gram: int = GRAM, seed: int = SEED) -> None:
        self.dimension, self.gram, self.seed = dimension, gram, seed
        self.number, self.known = np.full(0x110000, -1, np.int32), 0  # of the letters that are kept
        self.place = np.zeros((gram, LETTERS, dimension), np.int8)
        self.row = np.full(LETTERS**gram, -1, np.int32)
        self.kept, self.n = np.zeros((KEPT, dimension), np.float32), 0

    def _placed(self, codes: np.ndarray) -> list[np.ndarray]:
        """The vectors of letters in each place of an n-gram."""
        base = letter_vectors(codes, self.dimension, self.seed)
        return [np.roll(base, self.gram - 1 - i, axis=1) for i in range(self.gram)]

    def _numbers(self, x: np.ndarray) -> np.ndarray:
        if self.known < LETTERS and (self.number[x] < 0).any():
            new = np.unique(x[self.number[x] < 0])[: LETTERS - self.known]
            self.number[new] = np.arange(self.known, self.known + len(new))
            self.place[:, self.known : self.known + len(new)] = self._placed(new)
            self.known += len(new)
        return self.number[x]

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-grams of kept letters."""
        v = np.ones((len(codes), self.dimension), np.int8)
        for i in range(self.gram):
            v *= self.place[i][codes // LETTERS ** (self.gram - 1 - i) % LETTERS]
        return v.astype(np.float32)

    def _rare(self, grams: np.ndarray) -> np.ndarray:
        """The sum of the vectors of n-grams with other letters."""
        grams, times = np.unique(grams, axis=0, return_counts=True)
        total = np.zeros(self.dimension, np.float32)
        for at in range(0, len(grams), 1024):
            own, index = np.unique(grams[at : at + 1024], return_inverse=True)
            placed, index = self._placed(own), index.reshape(-1, self.gram)
            v = np.ones((len(index), self.dimension), np.int8)
            for i in range(self.gram):
                v *= placed[i][index[:, i]]
            total += times[at : at + 1024].astype(np.float32) @ v.astype(np.float32)
        return total

    def vector(self, text: str | None) -> np.ndarray | None:
        """None for a text without letters."""
        x = letters(text)
        if not x.any():
            return None
        n = len(x) - self.gram + 1
        numbers = self._numbers(x).astype(np.int64)
        codes = sum(numbers[i : i + n] * LETTERS ** (self.gram - 1 - i) for i in range(self.gram))
        frequent = np.logical_and.reduce([numbers[i : i + n] >= 0 for i in range(self.gram)])
        rare = self._rare(np.lib.stride_tricks.sliding_window_view(x, self.gram)[~frequent]) if not frequent.all() else 0
        codes, times = np.unique(codes[frequent], return_counts=True)
        new = codes[self.row[codes] < 0][: len(self.kept) - self.n]
        if len(new):
            self.kept[self.n : self.n + len(new)] = self._bound(new)
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        row = self.row[codes]
        known, times = row >= 0, times.astype(np.float32)
        total = times[known] @ self.kept[row[known]] + rare
        rest = codes[~known]
        for at in range(0, len(rest), 1024):
            total = total + times[~known][at : at + 1024] @ self._bound(rest[at : at + 1024])
        size = np.linalg.norm(total)
        return total / size if size else total


@lru_cache(maxsize=1)
def encoder(dimension: int, gram: int, seed: int) -> Encoder:
    return Encoder(dimension, gram, seed)


def prototypes(docs: DataFrame, dimension: int = DIMENSION, gram: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (text, lang) and their unit prototypes; rows of null language don't count.

    Sums are of whole numbers, so they don't depend on the order of rows. More than LANGUAGES languages raise ValueError.
    """

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = encoder(dimension, gram, seed), {}
        for f in frames:
            for text, lang in zip(f["text"], f["lang"]):
                if (v := own.vector(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(float) * PARTS).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": list(sums.values())})

    sums = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInPandas(bundle, "lang string, v array<long>")
    added = written(sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")), "prototypes")
    if (n := added.where("i = 0").count()) > LANGUAGES:
        raise ValueError(f"lang holds {n} values; at most {LANGUAGES} languages can be told apart")
    # one array a language comes to the driver: 8 KB each, 80 MB for LANGUAGES of them
    whole = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda y: y["x"]).alias("v"))
    rows = whole.toPandas().sort_values("lang")
    emptied(added)
    out = np.array(rows["v"].tolist(), float).reshape(len(rows), dimension)
    return rows["lang"].tolist(), out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predictor(langs: list[str], profiles: np.ndarray, gram: int = GRAM, seed: int = SEED):
    """A column function: struct<lang_pred, score> of a whole text; the score is the cosine, at least 0."""
    dimension = profiles.shape[1]

    @F.pandas_udf("lang_pred string, score double")
    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(dimension, gram, seed)
        for texts in frames:
            out = []
            for text in texts:
                v = own.vector(text) if langs else None
                cos = profiles @ v if v is not None else None
                out.append((UNKNOWN, 0.0) if cos is None else (langs[int(cos.argmax())], float(min(1.0, max(0.0, cos.max())))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict


def identified(docs: DataFrame, learn_from: Column, dimension: int = DIMENSION, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """``docs`` with lang_pred and score, learnt from the rows where ``learn_from`` holds and lang isn't null.

    ``und`` with score 0: a null text, one without letters, and all texts where there is nothing to learn from. Of
    languages with equal cosines the first by name wins; equal texts get equal results. Columns of these names, in any
    case, are replaced, all others stay; an empty table gives an empty one.
    """
    langs, profiles = prototypes(docs.where(learn_from), dimension, gram, seed)
    rows = carried(docs, ["lang_pred", "score"], found=predictor(langs, profiles, gram, seed)(F.col("text")))
    return rows.select("row.*", "found.lang_pred", "found.score")


def op2_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identified(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
