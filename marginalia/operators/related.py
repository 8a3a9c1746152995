"""Related items: by shared tags, by embedding, by both, and near by on the map.

Each takes a table of seeds and answers for all of them at once; the number of seeds may grow with the archive. Blocks of
seeds meet lots of items, so that no task holds a frequent tag whole; grid cells of very many items are dealt over salts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import measures as M
from ..sources.stored import new_path, stored

DAYS, LEAST_OVERLAP, LEAST_SIMILARITY, MILES = 30, 2, 0.7, 5.0
SALTS = 8

#: Items of a lot; bytes of a block of seeds, and seeds that are multiplied at a time.
ROWS_A_SALT, BLOCK_BYTES, STRIP = 100_000, 32 << 20, 256

#: Tags of a block of seeds; counts that a task holds at a time, and pairs that wait until a seed's best are settled.
BLOCK_TAGS, COUNTS, CELLS = 1 << 20, 1 << 19, 1 << 22

#: Seeds of a block whose found items' tags are counted in one task.
BLOCK_SEEDS = 256

#: Folders of the index of tags; rows that may be broadcast, which are counted first.
PARTS, BROADCAST_ROWS = 64, 50_000

#: Degrees of a cell's sides; a mile is at most 1 / 68.7 degrees of latitude.
MILES_A_DEGREE = 68.7


def recent(items: DataFrame, as_of: str, days: int) -> DataFrame:
    return items.where(F.col("published_at") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval({days})"))


def tag_index(items: DataFrame, path: str | None = None, parts: int = PARTS) -> DataFrame:
    """tag, id, published_at, n (how often the item has it), part: a written table in folders by a hash of the tag.

    What a seed needs of it lies in the folders of the seed's tags.
    """
    each = items.select("id", "published_at", F.explode("tags").alias("tag")).groupBy("tag", "id", "published_at").agg(F.count(F.lit(1)).alias("n"))
    path = path or new_path(items.sparkSession, "tags")
    stored(each.withColumn("part", tag_part(F.col("tag"), parts)), path, ["part"])
    return items.sparkSession.read.schema("tag string, id long, published_at timestamp_ntz, n long, part int").parquet(path)


def tag_part(tag: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(parts)).cast("int")


def by_tag_index(tags: Sequence[str], seed_id: int, index: DataFrame, as_of: str, k: int = 50, days: int = DAYS, least: int = LEAST_OVERLAP, parts: int = PARTS) -> DataFrame:
    """id, published_at, overlap, rank for one seed with the given ``tags``: what ``by_tags`` says of it, from its tags' folders alone."""
    asked = sorted(set(tags))
    folders = [r[0] for r in index.sparkSession.createDataFrame([(t,) for t in asked], "tag string").select(tag_part(F.col("tag"), parts)).distinct().collect()]
    held = recent(index.where(F.col("part").isin(folders) & F.col("tag").isin(asked)), as_of, days).where(F.col("id") != seed_id)
    found = held.groupBy("id", "published_at").agg(F.sum("n").alias("overlap")).where(F.col("overlap") >= least)
    ordered = found.orderBy(F.col("overlap").desc(), F.col("published_at").desc(), F.col("id")).limit(k)
    return ordered.withColumn("rank", F.row_number().over(W.orderBy(F.col("overlap").desc(), F.col("published_at").desc(), F.col("id"))))


def small(df: DataFrame) -> DataFrame:
    """``df`` (written, or soon evaluated) marked to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Tile:
    """A block of seeds, by their tags, and what they have met so far of the items that stream past.

    Postings of the block's tags tell which seeds an item's tags count for; counts of a few items by all seeds are held at a time.
    """

    def __init__(self, frames: list[pa.RecordBatch], k: int | None, least: int) -> None:
        self.k, self.least = k, least
        whole = pa.Table.from_batches(frames)
        self.ids = whole["id"].to_numpy()
        n = self.n = len(self.ids)
        tags = whole["tags"].combine_chunks()
        codes = tags.flatten().dictionary_encode()
        texts = codes.dictionary.cast(pa.string())
        order = pc.sort_indices(texts)
        self.tags = texts.take(order)  # a code is a tag's place in order
        self.code = {t: c for c, t in enumerate(self.tags.to_pylist())}
        of, code = np.repeat(np.arange(n), pc.list_value_length(tags).to_numpy(zero_copy_only=False)), np.argsort(order.to_numpy())[codes.indices.to_numpy()]
        self.posted = of[np.argsort(code, kind="stable")]
        self.sizes = np.bincount(code, minlength=len(self.code) + 1)  # of no tag: none
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.floor = np.full(n, least - 1)  # what an item has to exceed
        self.sums = np.zeros((2, n), "int64")
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def hits(self, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """rows, seeds, overlap of the pairs that count, for a few items at a time; which cells (item and seed) those are, and the tags' hits (cell, code) of all."""
        tags, other = part["tags"], part["id"].to_numpy()
        own = tags.flatten().dictionary_encode()
        known = np.array([self.code.get(t, -1) for t in own.dictionary.to_pylist()], "int64")
        code = known[own.indices.to_numpy()] if len(known) else known
        row = np.repeat(np.arange(len(other)), pc.list_value_length(tags).to_numpy(zero_copy_only=False))
        row, code = row[code >= 0], code[code >= 0]
        weight = np.bincount(row, self.sizes[code], len(other)).astype("int64")
        lot = np.cumsum(weight + self.n) // COUNTS
        cuts = np.flatnonzero(np.append(True, lot[1:] != lot[:-1])) if len(other) else []
        for a, b in zip(cuts, [*cuts[1:], len(other)]):
            at = slice(*np.searchsorted(row, [a, b]))
            c, r = code[at], row[at] - a
            size = self.sizes[c]
            place = np.arange(size.sum()) + np.repeat(self.starts[c] - (np.cumsum(size) - size), size)
            cell = np.repeat(r * self.n, size) + self.posted[place]
            counts = np.bincount(cell, minlength=(b - a) * self.n)
            told = (counts.reshape(b - a, self.n) > self.floor).ravel()
            pairs = np.flatnonzero(told)
            rows, seeds = np.divmod(pairs, self.n)
            itself = other[a:b][rows] == self.ids[seeds]
            if itself.any():
                told[pairs[itself]] = False
                rows, seeds, pairs = rows[~itself], seeds[~itself], pairs[~itself]
            yield rows + a, seeds, counts[pairs], told, cell, np.repeat(c, size)

    def summed(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, seeds, overlap, *_ in self.hits(part):
            self.sums += [np.bincount(seeds, minlength=self.n), np.bincount(seeds, overlap, self.n).astype("int64")]
        return iter(())

    def best(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Items come latest first: of equal overlaps those that came before are better."""
        other, at = part["id"].to_numpy(), part["published"].to_numpy()
        for rows, seeds, overlap, *_ in self.hits(part):
            self.held.append((seeds, overlap, other[rows], at[rows]))
            self.waiting += len(rows)
            if self.waiting > CELLS:
                self.settle()
        return iter(())

    def settle(self) -> None:
        seeds, overlap, other, at = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-overlap, seeds))  # stable
        s = seeds[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.held, self.waiting = [(seeds[order], overlap[order], other[order], at[order])], 0
        full = order[rank == self.k - 1]
        self.floor[seeds[full]] = overlap[full]

    def every(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        other, at = part["id"].to_numpy(), part["published"].to_numpy()
        for rows, seeds, overlap, *_ in self.hits(part):
            yield pa.RecordBatch.from_arrays([self.ids[seeds], other[rows], at[rows], overlap], ["seed_id", "id", "published", "overlap"])

    def shared(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The tags that a pair shares, in order, each once."""
        other, bits = part["id"].to_numpy(), len(self.tags).bit_length()
        for rows, seeds, _, told, cell, code in self.hits(part):
            if not len(rows):
                continue
            kept = told[cell]
            flat = np.sort((cell[kept] << bits) | code[kept])  # np.unique takes ten times as long
            flat = flat[np.append(True, flat[1:] != flat[:-1])]
            cell = flat >> bits  # those of the pairs, in their order
            ends = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).astype("int32")
            texts = self.tags.take(pa.array((flat & ((1 << bits) - 1)).astype("int32")))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, texts), "|")
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[seeds]), pa.array(other[rows]), joined], ["seed_id", "id", "shared"])

    def ended(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.settle()
            seeds, overlap, other, at = self.held[0]
            yield pa.RecordBatch.from_arrays([self.ids[seeds], other, at, overlap], ["seed_id", "id", "published", "overlap"])
        if self.sums[0].any():
            s = np.flatnonzero(self.sums[0])
            yield pa.RecordBatch.from_arrays([self.ids[s], self.sums[0][s], self.sums[1][s]], ["seed_id", "n", "total"])


def met_tags(what: str, k: int | None, least: int):
    """What each tile has to tell: a block of seeds comes first, then items stream past it, the latest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, tile = None, [], None
        for batch in batches:
            key = batch["tile"].to_numpy() * 2 + batch["side"].to_numpy()
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                part = batch.slice(a, b - a)
                if key[a] // 2 != now:
                    if tile:
                        yield from tile.ended()
                    now, waiting, tile = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    waiting.append(part)
                elif waiting or tile:
                    tile = tile or Tile(waiting, k, least)
                    waiting = []
                    yield from getattr(tile, what)(part)
        if tile:
            yield from tile.ended()

    return run


def tag_tiles(seeds: DataFrame, items: DataFrame, as_of: str, days: int, what: str, schema: str, least: int, k: int | None = None) -> DataFrame:
    """All seeds against all items published within ``days`` before ``as_of`` or later, tile by tile: no pair is shuffled.

    Blocks of seeds hold a bounded number of tags; items are dealt over lots, and each is sent once to each block. An item's
    tag counts as often as the item has it, a seed's once.
    """
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    own = seeds.where(F.col("id").isNotNull() & (F.size("tags") > 0)).select("id", F.array_compact(F.array_distinct("tags")).alias("tags"))
    own = stored(own, name="seeds")
    blocks = max(1, math.ceil((own.agg(F.sum(F.size("tags"))).first()[0] or 0) / BLOCK_TAGS))
    tags = F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))  # no filter by them: it would make them twice
    met = recent(items, as_of, days).where(F.col("id").isNotNull()).select("id", tags.alias("tags"), micros.alias("published"))
    lots = max(math.ceil(2 * items.sparkSession.sparkContext.defaultParallelism / blocks), math.ceil(met.select("id").count() / ROWS_A_SALT))
    block, lot = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(lots)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = own.select(block.alias("block"), every(lots).alias("lot"), F.lit(0).alias("side"), "id", "tags", F.lit(0).cast("long").alias("published"))
    met = met.select(every(blocks).alias("block"), lot.alias("lot"), F.lit(1).alias("side"), "id", "tags", "published")
    tiles = asked.unionByName(met).withColumn("tile", F.col("block").cast("long") * lots + F.col("lot")).drop("block", "lot")
    dealt = tiles.repartitionById(blocks * lots, F.col("tile").cast("int")).sortWithinPartitions("tile", "side", F.col("published").desc(), "id")
    return dealt.mapInArrow(met_tags(what, k, least), schema)


#: What a tile tells of a pair; ``dated`` makes a time of it again.
PAIR = "seed_id long, id long, published long, overlap long"


def dated(pairs: DataFrame) -> DataFrame:
    return pairs.select("seed_id", "id", F.timestamp_micros("published").cast("timestamp_ntz").alias("published_at"), "overlap")


def tag_overlaps(seeds: DataFrame, items: DataFrame, as_of: str, days: int = DAYS, least: int = LEAST_OVERLAP) -> DataFrame:
    """seed_id, id, published_at, overlap: how many of an item's tags a seed has, each as often as the item has it; a row a pair.

    There are as many pairs as seeds times items when all share tags: ``overlap_sums`` and ``by_tags`` make none of them rows.
    """
    return dated(tag_tiles(seeds, items, as_of, days, "every", PAIR, least))


def overlap_sums(seeds: DataFrame, items: DataFrame, as_of: str, days: int = DAYS, least: int = LEAST_OVERLAP) -> DataFrame:
    """seed_id, n, total: how many items share ``least`` tags or more with a seed that has any, and the sum of their overlaps."""
    tiles = tag_tiles(seeds, items, as_of, days, "summed", "seed_id long, n long, total long", least)
    return tiles.groupBy("seed_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def shared_tags(seeds: DataFrame, items: DataFrame, as_of: str, days: int = DAYS, least: int = LEAST_OVERLAP) -> DataFrame:
    """seed_id, id, shared: the tags that a pair of ``tag_overlaps`` shares, each once and in order, joined by |."""
    return tag_tiles(seeds, items, as_of, days, "shared", "seed_id long, id long, shared string", least)


def top(pairs: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each seed, with their rank."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("seed_id").orderBy(*order))).where(F.col("rank") <= k)


def by_tags(seeds: DataFrame, items: DataFrame, as_of: str, k: int = 50, days: int = DAYS, least: int = LEAST_OVERLAP) -> DataFrame:
    """The ``k`` best of ``tag_overlaps``, with their rank; a tile passes on no more of a seed than these."""
    best = dated(tag_tiles(seeds, items, as_of, days, "best", PAIR, least, k))
    return top(best, k, F.col("overlap").desc(), F.col("published_at").desc(), F.col("id"))


def told_tags(k: int):
    """The ``k`` tags that most of a seed's rows have, of each block; a block's rows hold an item's tags once, for all its seeds."""

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        tags, asked = whole["tags"].combine_chunks(), whole["seeds"].combine_chunks()
        codes = tags.flatten().dictionary_encode()
        names = codes.dictionary.cast(pa.string())
        order = pc.sort_indices(names).to_numpy()
        place = np.argsort(order)[codes.indices.to_numpy()] if len(order) else np.zeros(0, "int64")
        ends = np.append(0, np.cumsum(pc.list_value_length(tags).to_numpy(zero_copy_only=False)))
        of = np.repeat(np.arange(len(whole)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        ids, seed = np.unique(asked.flatten().to_numpy(), return_inverse=True)
        of = of[np.argsort(seed, kind="stable")]
        seeds, code, n, rank = [], [], [], []
        for i, rows in enumerate(np.split(of, np.cumsum(np.bincount(seed))[:-1])):
            each, counts = np.unique(np.concatenate([place[ends[r] : ends[r + 1]] for r in rows]), return_counts=True)
            first = np.lexsort((each, -counts))[:k]
            seeds.append(np.full(len(first), ids[i])), code.append(each[first]), n.append(counts[first]), rank.append(np.arange(1, len(first) + 1, dtype="int32"))
        texts = names.take(pa.array(order[np.concatenate(code)]))
        return pa.RecordBatch.from_arrays([np.concatenate(seeds), texts, np.concatenate(n), np.concatenate(rank)], ["seed_id", "tag", "n", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = batch["block"].to_numpy()
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                if key[a] != now and held:
                    yield best(held)
                    held = []
                now = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield best(held)

    return run


def common_tags(found: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """seed_id, tag, n, rank: the ``k`` tags that most of the items found for a seed have (``found``: seed_id, id); null tags are none.

    Seeds go by blocks of some ``BLOCK_SEEDS``. An item travels once to each block that found it, whatever the number of its
    seeds there, and tags are counted in the block's task: no row of a seed and a tag is shuffled.
    """
    found = stored(found.select("seed_id", "id"), name="found")
    blocks = max(1, math.ceil(found.select("seed_id").distinct().count() / BLOCK_SEEDS))
    asked = found.withColumn("block", F.pmod(F.xxhash64("seed_id"), F.lit(blocks)).cast("int")).groupBy("block", "id").agg(F.collect_list("seed_id").alias("seeds"))
    held = items.where(F.size("tags") > 0).select("id", F.array_compact("tags").alias("tags"))
    held = held.join(small(found.select("id").distinct()), "id", "left_semi")
    dealt = asked.join(held, "id").select("block", "seeds", "tags").repartitionById(blocks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(told_tags(k), "seed_id long, tag string, n long, rank int")


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; a vector without length, or with a null or non-finite component, becomes zeros."""
    out = np.zeros((len(vectors), max([1, *(len(v) for v in vectors)])))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(np.isfinite(size) & (size > 0), out / np.where(size > 0, size, 1), 0)


def compared(k: int, least: float):
    """seed_id, id, similarity of each block's best: the block's seeds come first, then items stream past them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, seeds, ids = None, [], None, None
        for frame in frames:
            for tile, part in frame.groupby("tile", sort=False):
                if tile != now:
                    now, waiting, seeds = tile, [], None
                asked, rest = part[part["side"] == 0], part[part["side"] == 1]
                if len(asked):
                    waiting.append(asked)
                if not len(rest) or not (waiting or seeds is not None):
                    continue
                if seeds is None:
                    whole = pd.concat(waiting)
                    seeds, ids, waiting = unit(whole["v"]), whole["id"].to_numpy(), []
                v, other, at = unit(rest["v"]), rest["id"].to_numpy(), rest["published"].to_numpy()
                width = min(seeds.shape[1], v.shape[1])
                for low in range(0, len(ids), STRIP):
                    cos = seeds[low : low + STRIP, :width] @ v[:, :width].T
                    cos[ids[low : low + STRIP][:, None] == other[None, :]] = -np.inf
                    if cos.shape[1] > k:  # of each row those that reach its k-th best, ties included
                        cos = np.round(cos, 12)
                        floor = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k][:, None]
                        r, c = np.nonzero((cos > least) & (cos >= floor - 1e-8))
                    else:
                        r, c = np.nonzero(cos > least)
                    order = np.lexsort((other[c], -at[c], -np.round(cos[r, c], 9), r))
                    r, c = r[order], c[order]
                    best = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[best], c[best]
                    yield pd.DataFrame({"seed_id": ids[low + r], "id": other[c], "similarity": cos[r, c], "published": at[c]})

    return run


def dealt_out(tiles: DataFrame, n: int) -> DataFrame:
    """Rows by their ``tile`` (0 to ``n`` - 1), each tile a partition, seeds (side 0) first."""
    return tiles.repartitionById(n, F.col("tile").cast("int")).sortWithinPartitions("tile", "side")


def by_embedding(seeds: DataFrame, items: DataFrame, as_of: str, k: int = 50, days: int = DAYS, least: float = LEAST_SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """seed_id, id, published_at, similarity, rank: every seed is compared with every recent item, block by block.

    Blocks of seeds hold a bounded number of bytes; items are dealt over tasks and each is sent once to each block. A
    task multiplies its block with batches of items and passes on each seed's best. Null vectors take no part.
    """
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    left = seeds.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"))
    right = recent(items, as_of, days).where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"), micros.alias("published"))
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size(left) / block_bytes))
    lots = max(math.ceil(seeds.sparkSession.sparkContext.defaultParallelism / blocks), math.ceil(size(right) / (4 * block_bytes)))
    block, lot = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(lots)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.select(block.alias("block"), every(lots).alias("lot"), F.lit(0).alias("side"), "id", "v", F.lit(0).cast("long").alias("published"))
    met = right.select(every(blocks).alias("block"), lot.alias("lot"), F.lit(1).alias("side"), "id", "v", "published")
    tiles = asked.unionByName(met).withColumn("tile", F.col("block").cast("long") * lots + F.col("lot")).drop("block", "lot")
    pairs = dealt_out(tiles, blocks * lots).mapInPandas(compared(k, least), "seed_id long, id long, similarity double, published long")
    pairs = pairs.withColumn("published_at", F.timestamp_micros("published").cast("timestamp_ntz")).drop("published")
    return top(pairs, k, F.round("similarity", 9).desc(), F.col("published_at").desc(), F.col("id"))


def hybrid(seeds: DataFrame, items: DataFrame, as_of: str, k: int = 50, vectors: DataFrame | None = None, **how) -> DataFrame:
    """The best by tags, twice as many as asked for, by 0.4 * overlap / 10 + 0.6 * cosine.

    ``vectors``: id, embedding of each row of ``items``, seeds among them, where ``seeds`` and ``items`` have no embeddings: a join that brings
    embeddings to items would carry their texts along, and do so each time that they are read.
    """
    found = stored(by_tags(seeds, items, as_of, 2 * k, **how).drop("rank"), name="found")  # a few rows a seed
    own = (seeds if vectors is None else vectors).select(F.col("id").alias("seed_id"), F.col("embedding").alias("seed"))
    own = own.join(small(found.select("seed_id").distinct()), "seed_id", "left_semi")
    others = (items if vectors is None else vectors).select("id", "embedding").join(small(found.select("id").distinct()), "id", "left_semi")
    found = found.join(own, "seed_id").join(others, "id")
    scored = found.withColumn("similarity", M.cosine(F.col("seed"), F.col("embedding")))
    scored = scored.withColumn("score", F.col("overlap") / 10.0 * 0.4 + F.col("similarity") * 0.6).drop("seed", "embedding")
    return top(scored, k, F.round("score", 9).desc(), F.col("published_at").desc(), F.col("id"))


def near_by(seeds: DataFrame, items: DataFrame, miles: float = MILES) -> DataFrame:
    """seed_id, id, miles: items within ``miles`` of a seed, by an equi-join on grid cells and the exact distance.

    Cells are at least ``miles`` high and, at the widest latitude of the items, as wide; a seed looks at its own and
    the eight around it. Latitude and longitude 0 are places like any others; a null one is none.
    """
    placed = items.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("id", "latitude", "longitude")
    widest = placed.agg(F.max(F.abs("latitude"))).first()[0] or 0.0
    high = miles / MILES_A_DEGREE
    wide = high / max(0.01, math.cos(math.radians(min(89.0, widest + high))))
    columns = max(1, int(360 / wide))
    y, x = F.floor(F.col("latitude") / high), F.floor((F.col("longitude") + 180) / (360.0 / columns))
    around = F.explode(F.array(*[F.struct((y + dy).alias("y"), F.pmod(x + dx, F.lit(columns)).alias("x")) for dy in (-1, 0, 1) for dx in sorted({d % columns for d in (-1, 0, 1)})]))
    left = seeds.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("id").alias("seed_id"), F.col("latitude").alias("seed_lat"), F.col("longitude").alias("seed_lon"), around.alias("cell")
    )
    left = left.select("*", "cell.*").drop("cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = placed.withColumns({"y": y, "x": F.pmod(x, F.lit(columns)), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    pairs = left.join(right, ["y", "x", "salt"]).where(F.col("id") != F.col("seed_id"))
    far = M.haversine_miles(F.col("seed_lat"), F.col("seed_lon"), F.col("latitude"), F.col("longitude"))
    return pairs.select("seed_id", "id", far.alias("miles")).where(F.col("miles") <= miles)


def threads(seeds: DataFrame, items: DataFrame, as_of: str, k: int = 5, near: int = 3) -> DataFrame:
    """seed_id, id, found_by, rank: the best by tags, then near ones that tags didn't find, ``k`` in all."""
    tags = by_tags(seeds, items, as_of, 10).select("seed_id", "id", F.lit(0).alias("way"), F.col("rank").alias("place"))
    # of items at one place only the first can be among a seed's nearest, and the seed may be one of them
    one = W.partitionBy("latitude", "longitude").orderBy("id")
    firsts = items.where(F.col("id").isNotNull()).select("id", "latitude", "longitude").withColumn("nth", F.row_number().over(one)).where(F.col("nth") <= near + 1).drop("nth")
    geo = top(near_by(seeds, firsts), near, F.round("miles", 9), F.col("id")).select("seed_id", "id", F.lit(1).alias("way"), F.col("rank").alias("place"))
    both = tags.unionByName(geo).groupBy("seed_id", "id").agg(F.min(F.struct("way", "place")).alias("first")).select("seed_id", "id", "first.*")
    return top(both, k, "way", "place").select("seed_id", "id", F.when(F.col("way") == 0, "tags").otherwise("place").alias("found_by"), "rank")
