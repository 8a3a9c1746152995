"""Importance resampling towards a target: hashed n-gram features, Gumbel scores, and a cutoff found by counting.

A feature's bucket has a gain, the log ratio of its share in the target to its share in the documents; a document's weight
is the mean gain of its features. A seeded Gumbel number on top makes the highest scores a sample without replacement in
proportion to the weights. Gains are one array of fixed size, so weights need no join. The documents to draw are found
without sorting all: bisection of the score's range by exact count jobs over the written scores, then likewise of doc_id
among the rows that tie at the cutoff. Only drawn rows are dealt by ranges and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, named, written
from .ranges import ranked

BUCKETS, GRAMS, SHARE, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7

#: Thresholds that a job counts at a time: each job leaves a sixteenth of the range, as four halvings would.
PROBES = 15

#: Bytes: A-Z to a-z; letters, digits and all of what isn't ASCII stay; the rest separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

LAST = 2**63 - 1


def features(text: bytes | None, grams: int = GRAMS) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of each run of 1 to ``grams`` words, joined by a space; repeats stay."""
    words = (text or b"").translate(_WORDS).split()
    runs = list(map(zlib.crc32, words))
    out = list(runs)
    for n in range(1, grams):
        runs = list(map(zlib.crc32, words[n:], map(zlib.crc32, repeat(b" "), runs)))
        out += runs
    return len(words), out


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """How many features of all ``texts`` each bucket holds. A task sums up its own; ``buckets`` rows a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.array(features(x.as_py(), grams)[1], np.int64) % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    sums = texts.select(named(text).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a Gumbel number that depends on ``seed`` and ``doc_id`` alone (null: as an empty name)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """``docs`` (with ``bytes``, which goes) and n_words, n_features, weight: the floored mean gain, 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("bytes"):
                n, found = features(x.as_py(), grams)
                rows.append((n, len(found), int(gain[np.array(found, np.int64) % len(gain)].sum()) // len(found) if found else 0))
            kept = [c for c in batch.schema.names if c != "bytes"]
            added = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], [*kept, "n_words", "n_features", "weight"])

    kept = docs.drop("bytes").schema
    return docs.mapInArrow(weigh, kept.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def least_reaching(table: DataFrame, value: Column, need: int) -> tuple[int, int]:
    """The least whole x such that ``need`` rows or more (1 at least; as many exist) have value <= x, and the rows with value < x."""
    lo, hi = table.agg(F.min(value), F.max(value)).first()
    below = 0
    while lo < hi:
        probes = sorted({lo + (hi - lo) * i // (PROBES + 1) for i in range(1, PROBES + 1)} | {lo})
        counts = table.agg(*[F.count_if(value <= F.lit(p)).alias(f"n{i}") for i, p in enumerate(probes)]).first()
        for p, n in zip(probes, counts):
            if n >= need:
                hi = p
                break
            lo, below = p + 1, n
    return lo, below


def highest(scores: DataFrame, need: int) -> Column:
    """The condition that holds for the ``need`` rows of a written table that come first: highest score, then least doc, then least nr."""
    if need < 1:
        return F.lit(False)
    down, doc, nr = -F.col("score"), F.coalesce(F.col("doc"), F.lit(LAST)), F.col("nr")
    x, before = least_reaching(scores, down, need)
    tied = scores.where(down == x)
    y, before_y = least_reaching(tied, doc, need - before)
    z, _ = least_reaching(tied.where(doc == y), nr, need - before - before_y)
    return (down < x) | (down == x) & ((doc < y) | (doc == y) & (nr <= z))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS,
    seed: int = SEED, keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` with n_features, weight, score and rank: 1, 2, 3, ... for drawn rows, null for others.

    ``share`` percent, rounded down, of the documents with ``least_words`` words or more are drawn. ``target``: a table
    with ``text``. A null text has no words, a null doc_id draws the number of an empty name and comes last among ties;
    rows that tie in score and doc_id are taken in any order. An empty target leaves gains to the documents' shares
    alone. ``keep``: the columns of ``docs`` that the result has, all by default; of the names above, in any case, the new ones
    stand. An empty table gives an empty one.
    """
    gain = gains(bucket_counts(docs, "text", buckets, grams), bucket_counts(target, "text", buckets, grams))
    rows = carried(docs, ["n_features", "weight", "score", "rank"], doc=F.col("doc_id").cast("long"), bytes=F.col("text").cast("binary"))
    if keep is not None:
        rows = rows.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in keep]))
    known = weighed(rows, gain, grams).withColumn("score", F.col("weight") + gumbel(F.col("doc"), seed))
    known = written(known.withColumn("nr", F.monotonically_increasing_id()), "scores")
    able = known.where(F.col("n_words") >= least_words)
    drawn = highest(able.select("score", "doc", "nr"), able.count() * share // 100) & (F.col("n_words") >= least_words)
    places = ranked(known.where(drawn), [F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("nr")], "rank")
    every = places.unionByName(known.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return every.select("row.*", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
