"""Nearest items by embedding on an inverted-file index: cells around centroids, of which a search reads the nearest few.

Centroids are fitted by k-means on a bounded sample of the vectors. Every vector is then put in the cell of its nearest
centroid and written in that cell's folder. A query meets the rows of its nearest cells, as many as the neighbours within
the sample needed to be found in: few where vectors form groups, most of them where they don't. Cells of very many rows
or queries are cut into tiles, one to a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import new_path, stored
from .related import BLOCK_BYTES, compared, dealt_out, top, unit

#: Vectors that centroids are fitted on, at most: those with the least hash of their id. Cells at most; else there are as many
#: as the root of the number of vectors.
SAMPLE, MOST_CELLS = 20_000, 4096

#: Vectors of the sample that are asked for their neighbours within it, how many of these, and the share that is to be found.
ASKED, NEIGHBOURS, FOUND = 256, 50, 0.97


@dataclass
class Index:
    """rows: id, v (array<double>), published (microseconds), cell. centroids: one unit vector a cell. probes: cells to look at."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def usable(v: Column) -> Column:
    """Vectors without null or non-finite components, and not of length zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def nearest_cells(v: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` cells whose centroids have the greatest cosine with ``v``, nearest first."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        u = unit(vectors)
        wide = min(u.shape[1], centroids.shape[1])
        return pd.Series(list(np.argsort(-(u[:, :wide] @ centroids[:, :wide].T), axis=1, kind="stable")[:, :n].astype("int32")))

    return cells(v)


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Unit centroids of ``vectors`` (id, v) by k-means over cosines, on a ``sample`` of bounded size, and the cells to probe."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = stored(vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v"), name="sample")
    model = KMeans(k=cells, seed=7, maxIter=15, initSteps=2, distanceMeasure="cosine").fit(some.select(array_to_vector("v").alias("features")))
    out = np.array(model.clusterCenters())
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, probes_for(unit(some.toPandas()["v"]), out)  # the sample is of bounded size


def probes_for(sample: np.ndarray, centroids: np.ndarray) -> int:
    """How many of its nearest cells a vector has to look at to find FOUND of its neighbours within the sample."""
    asked = sample[:ASKED]
    k = min(NEIGHBOURS + 1, len(sample))
    near = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    own = np.argmax(sample @ centroids.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(len(needed) * FOUND))]) + 1


def build(items: DataFrame, path: str | None = None, sample: int = SAMPLE) -> Index:
    """The index of ``items`` (id, embedding, published_at), every usable vector in one cell, written to ``path``."""
    path = path or new_path(items.sparkSession, "ivf")
    published = F.unix_micros(F.col("published_at").cast("timestamp")).alias("published")
    held = items.select("id", F.col("embedding").cast("array<double>").alias("v"), published).where(usable(F.col("v")))
    n = held.count()
    centroids, probes = fitted(held.select("id", "v"), max(2, min(MOST_CELLS, math.isqrt(n))), sample) if n > 3 else (np.ones((1, 1)), 1)
    in_cells = held.withColumn("cell", nearest_cells(F.col("v"), centroids, 1)[0])
    stored(in_cells, f"{path}/rows", ["cell"])
    spark = items.sparkSession
    cells = spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centroids)], "cell int, v array<double>, probes int")
    cells.coalesce(1).write.parquet(f"{path}/centroids")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    rows = spark.read.schema("id long, v array<double>, published long, cell int").parquet(f"{path}/rows")
    return Index(rows, np.array([r["v"] for r in cells]), cells[0]["probes"])


def similar(seeds: DataFrame, index: Index, after: int, k: int = 50, least: float = 0.7, probes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """seed_id, id, published_at, similarity, rank: of the items in the cells that a seed (id, embedding) probes, published after
    ``after`` (microseconds), the ``k`` most similar ones above ``least``.

    ``probes``: cells that a seed looks at, the index's own number by default; all of them give the exact answer.
    """
    cells, probes = len(index.centroids), probes or index.probes
    own = seeds.select("id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))
    own = stored(own.withColumn("cell", F.explode(nearest_cells(F.col("v"), index.centroids, min(probes, cells)))), name="asked")
    looked = [r[0] for r in own.select("cell").distinct().collect()]  # MOST_CELLS numbers at most
    held = index.rows.where(F.col("cell").isin(looked) & (F.col("published") > after))
    size = F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0)).alias("bytes")
    blocks = {r["cell"]: max(1, math.ceil(r["bytes"] / block_bytes)) for r in own.groupBy("cell").agg(size).collect()}
    lots = {r["cell"]: max(1, math.ceil(r["bytes"] / (4 * block_bytes))) for r in held.groupBy("cell").agg(size).collect()}
    shape, tiles = [], 0
    for cell in sorted(set(blocks) & set(lots)):
        shape.append((cell, blocks[cell], lots[cell], tiles))
        tiles += blocks[cell] * lots[cell]
    shape = F.broadcast(own.sparkSession.createDataFrame(shape, "cell int, blocks int, lots int, first long"))  # one row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    tile = F.col("first") + F.col("block") * F.col("lots") + F.col("lot")
    mine = own.join(shape, "cell").withColumn("block", place("blocks", 1)).withColumn("lot", every("lots"))
    theirs = held.join(shape, "cell").withColumn("lot", place("lots", 2)).withColumn("block", every("blocks"))
    mine = mine.select(tile.alias("tile"), F.lit(0).alias("side"), "id", "v", F.lit(0).cast("long").alias("published"))
    theirs = theirs.select(tile.alias("tile"), F.lit(1).alias("side"), "id", "v", "published")
    pairs = dealt_out(mine.unionByName(theirs), max(1, tiles)).mapInPandas(compared(k, least), "seed_id long, id long, similarity double, published long")
    pairs = pairs.withColumn("published_at", F.timestamp_micros("published").cast("timestamp_ntz")).drop("published")
    return top(pairs, k, F.round("similarity", 9).desc(), F.col("published_at").desc(), F.col("id"))
