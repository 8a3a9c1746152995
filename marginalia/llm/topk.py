"""Exact top-k search: matrix products over tiles of queries and shards, a selection per tile, and a tree of merges.

Queries are dealt into blocks and candidates into shards of a bounded number of bytes; a tile is one block and one shard.
A tile's task holds its block of queries and their best rows so far, and lets the shard's rows stream past in batches, so
that a block can be large and few copies of a candidate are sent: one for each block of queries. The lists of a query
are then merged ``FAN_IN`` shards at a time, so no task sees all the lists of a query of many shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of a block of queries and of a shard, as doubles; rows of a shard from which a further task is worth it.
QUERY_BYTES, SHARD_BYTES, LEAST_SHARD = 32 << 20, 128 << 20, 4096
#: Queries that are multiplied at a time, and shards whose lists are merged at a time.
STRIP, FAN_IN = 128, 16

TOP = 20


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as a double; null where the vector is null or holds a null or non-finite one."""
    # from 2^53 on, doubles are whole numbers, and more than a long holds
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    x = F.transform(vector, lambda v: whole(v.cast("double") * scale))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, x)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, columns in the order that wins ties; ``own``: cells left out."""
    n = scores.shape[1]
    if n > k:
        least = np.where(own, -np.inf, scores)
        floor = np.partition(least, n - k, axis=1)[:, n - k][:, None]
        above, tied = (least > floor) & ~own, (least == floor) & ~own
        keep = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1)[:, None]))
    else:
        keep = ~own
    return np.nonzero(keep)


def padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can pass 2^53, in Python's integers beyond that."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    return whole(q) @ whole(c).T


class Tile:
    """A block of queries and the best candidates that each has seen."""

    def __init__(self, ids: np.ndarray, vectors: pd.Series, k: int) -> None:
        self.ids, self.k = ids, k
        self.q = padded(vectors, max([1, *map(len, vectors)]))
        self.score = np.full((len(ids), k), -np.inf)
        self.whole: np.ndarray | None = None  # the scores themselves, where doubles can't tell them apart
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, vectors: pd.Series) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors.iloc[order]
        width = max([1, *map(len, vectors)])
        c = padded(vectors, max(width, self.q.shape[1]))
        if c.shape[1] > self.q.shape[1]:
            self.q = np.pad(self.q, ((0, 0), (0, c.shape[1] - self.q.shape[1])))
        for at in range(0, len(self.ids), STRIP):
            mine = slice(at, at + STRIP)
            scores = product(self.q[mine], c)
            if scores.dtype == object or self.whole is not None:
                self._merge_whole(mine, scores, ids)
                continue
            r, col = best(scores, self.ids[mine][:, None] == ids[None, :], self.k)
            width = int(np.bincount(r, minlength=1).max(initial=0))
            more, theirs = np.full((len(scores), width), -np.inf), np.full((len(scores), width), np.iinfo(np.int64).max)
            place = np.arange(len(r)) - np.searchsorted(r, r)
            more[r, place], theirs[r, place] = scores[r, col], ids[col]
            score, found = np.concatenate([self.score[mine], more], axis=1), np.concatenate([self.found[mine], theirs], axis=1)
            first = np.lexsort((found, -score), axis=1)[:, : self.k]
            self.score[mine], self.found[mine] = np.take_along_axis(score, first, 1), np.take_along_axis(found, first, 1)

    def _merge_whole(self, mine: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.whole is None:
            self.whole = np.array([[None if x == -np.inf else int(x) for x in row] for row in self.score], object).reshape(self.score.shape)
        for i, row in enumerate(scores, mine.start):
            own = [(-int(x), int(y)) for x, y in zip(row, ids) if y != self.ids[i]]
            own += [(-x, int(y)) for x, y in zip(self.whole[i], self.found[i]) if x is not None]
            own = sorted(own)[: self.k]
            self.whole[i] = [-x for x, _ in own] + [None] * (self.k - len(own))
            self.found[i] = [y for _, y in own] + [np.iinfo(np.int64).max] * (self.k - len(own))

    def lists(self, shard: int) -> pd.DataFrame:
        scores = self.score if self.whole is None else self.whole
        there = scores != -np.inf if self.whole is None else np.array([[x is not None for x in row] for row in scores], bool).reshape(scores.shape)
        r, col = np.nonzero(there)
        cut = [max(-(2**63), min(2**63 - 1, int(x))) for x in scores[r, col]]
        return pd.DataFrame({"query_id": self.ids[r], "vec_id": self.found[r, col], "score": np.array(cut, dtype="int64"), "shard": np.full(len(r), shard, "int32")})


def searched(k: int):
    """Lists of the tiles that come in, one after the other, each with its queries first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, held = None, [], None
        for frame in frames:
            for (tile, shard), part in frame.groupby(["tile", "shard"], sort=False):
                if now is None or tile != now[0]:
                    if held is not None:
                        yield held.lists(now[1])
                    now, waiting, held = (tile, shard), [], None
                asked, rest = part[part["side"] == 0], part[part["side"] == 1]
                if len(asked):
                    waiting.append(asked)
                if len(rest) and waiting:
                    queries = pd.concat(waiting)
                    held, waiting = Tile(queries["vec_id"].to_numpy(), queries["q"], k), []
                if len(rest) and held is not None:
                    held.see(rest["vec_id"].to_numpy(), rest["q"])
        if held is not None:
            yield held.lists(now[1])

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES, least_shard: int = LEAST_SHARD
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query by integer inner product.

    Both tables have vec_id (long) and q (array<double> of whole numbers); other columns are ignored. Rows whose id or
    vector is null take no part; vectors of different lengths are compared over the shorter one's components. A
    candidate with the query's own id is left out, ties go to the smaller vec_id, repeated candidate rows each count,
    and a query id that stands on several rows is asked once, with its smallest vector. A query of fewer than k
    candidates gets them all; empty tables give no rows. Scores beyond 64 bits are cut to the nearest long.
    """
    spark = queries.sparkSession
    queries = queries.where(F.col("vec_id").isNotNull() & F.col("q").isNotNull()).groupBy("vec_id").agg(F.min("q").alias("q"))
    candidates = candidates.where(F.col("vec_id").isNotNull() & F.col("q").isNotNull()).select("vec_id", "q")
    widest = F.coalesce(F.max(F.array_max(F.transform("q", F.abs))), F.lit(0.0))
    size = [F.count(F.lit(1)), F.coalesce(F.sum(F.size("q") * 8 + 16), F.lit(0)), widest]
    (_, asked_bytes, a), (rows, held_bytes, b) = queries.agg(*size).first(), candidates.agg(*size).first()
    narrow = next((t for t, most in (("smallint", 2**15), ("int", 2**31)) if max(a, b) < most), "double")
    queries, candidates = (df.withColumn("q", F.col("q").cast(f"array<{narrow}>")) for df in (queries, candidates))
    # a candidate that is there more than k times fills a list no further; so rows are told apart by what they hold alone,
    # and one that a lost executor has to deal again goes to the same shard
    candidates = candidates.groupBy("vec_id", "q").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    n_blocks = max(1, math.ceil(asked_bytes / query_bytes))
    # shards of bounded bytes, and more of them while each has enough rows, until all cores have one
    n_shards = max(1, math.ceil(held_bytes / shard_bytes), min(math.ceil(rows / least_shard), math.ceil(spark.sparkContext.defaultParallelism / n_blocks)))
    place = F.pmod(F.xxhash64("vec_id", "q"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(block.alias("block"), every(n_shards).alias("shard"), F.lit(0).alias("side"), "vec_id", "q")
    copied = candidates.withColumn("shard", place).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    held = copied.select(every(n_blocks).alias("block"), "shard", F.lit(1).alias("side"), "vec_id", "q")
    tiles = asked.unionByName(held).withColumn("tile", F.col("block").cast("long") * n_shards + F.col("shard"))
    tiles = tiles.select("tile", "shard", "side", "vec_id", "q")
    dealt = tiles.repartitionById(n_blocks * n_shards, F.col("tile").cast("int")).sortWithinPartitions("tile", "side")  # a tile is a task
    lists = dealt.mapInPandas(searched(k), "query_id long, vec_id long, score long, shard int")
    order = [F.col("score").desc(), F.col("vec_id")]
    while n_shards > 1:
        n_shards = math.ceil(n_shards / FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        merged = W.partitionBy("query_id", "shard").orderBy(*order)
        lists = lists.withColumn("at", F.row_number().over(merged)).where(F.col("at") <= k).drop("at")
    ranked = W.partitionBy("query_id").orderBy(*order)
    return lists.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding"), 64.0).alias("q"))
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)
