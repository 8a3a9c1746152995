"""Near-duplicate classes: DartMinHash signatures, a banded join, and exact Jaccard within the joined buckets.

Texts with the same words are one text from the start, so copies cost no comparison. A text is the weighted set of its
five-word shingles; a shingle that it has n times weighs 1 + ln n. Each distinct text gets a signature and a key for each
band of it; texts that share a key stand in one bucket, and buckets with the same members are compared once. A large
bucket is cut into blocks of bounded size. A task compares a block with itself and with the bucket's leader, and only
what the leader isn't near to is compared with the other blocks, so that a large group of near texts is sent about once.
Tasks send on the links of a spanning forest, never the pairs. Links join texts of weighted Jaccard 0.8 or more, and
classes are the connected components of links, found by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, emptied, hot_from, joined_evenly, sifted, written
from .dart_minhash import band_keys, signature
from .quality_rules import WHITE
from .shingles import shingles

SHINGLE, SIMILARITY = 5, 0.8
#: 40 bands of 6 coordinates miss a pair of Jaccard 0.8 five times in a million; a pair of 0.3 shares a band 3 in 100.
COORDINATES, BANDS = 240, 40
#: Members and shingles of a block, on average (one text may hold more), and columns of a shingle matrix at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4096
#: Sets up to which the lesser weights are added up row by row instead of value by value.
FEW = 16


def text_key(text: Column) -> Column:
    """16 bytes that texts with the same words (case and white space aside) share."""
    return F.unhex(F.md5(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")))))


def counted(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, sorted, and how often it has each."""
    return np.unique(shingles(text, width), return_counts=True)


def weight(times: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(times)


def signed(docs: DataFrame, width: int, coordinates: int, bands: int) -> DataFrame:
    """key, doc_id, n (distinct shingles) and bands: the keys of each row's bands, none for a text without words."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [counted(t, width) for t in f["text"]]
            signs = [signature(x, coordinates, weight(n)) for x, n in sets]
            keys = [[] if s is None else band_keys(s, bands) for s in signs]
            yield pd.DataFrame({"key": f["key"], "doc_id": f["doc_id"].astype("Int64"), "n": [len(x) for x, _ in sets], "bands": keys})

    return docs.mapInPandas(sign, "key binary, doc_id long, n long, bands array<long>")


def grams(texts: DataFrame, width: int) -> DataFrame:
    """key, grams, times: as bytes, the sorted distinct shingles of each text and how often it has them (none: all once)."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [counted(t, width) for t in f["text"]]
            times = [n.astype("<u4").tobytes() if n.max(initial=1) > 1 else b"" for _, n in sets]
            yield pd.DataFrame({"key": f["key"], "grams": [x.tobytes() for x, _ in sets], "times": times})

    return texts.mapInPandas(take, "key binary, grams binary, times binary")


def common_weights(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """For each two of ``sets`` the sum of the lesser weights of the values that they share; no weight is below 1.

    The first unit of each weight is counted by products of incidence matrices; what is above it, for the few values
    that any set has more than once, value by value.
    """
    out = np.zeros((len(sets), len(sets)))
    values, row, more = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(weights) - 1
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # the others add nothing
    row, more = row[shared], more[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column, more = row[order], column[order], more[order]
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m @ m.T
    above = more > 0
    row, column, more = row[above], column[above], more[above]
    if len(sets) <= FEW:
        column = np.unique(column, return_inverse=True)[1]
        m = np.zeros((len(sets), int(column.max(initial=-1)) + 1))
        m[row, column] = more
        return out + np.stack([np.minimum(x, m).sum(axis=1) for x in m])
    ends = np.flatnonzero(np.diff(column, append=-1)) + 1
    for a, b in zip(np.append(0, ends[:-1]), ends):
        if b - a > 1:
            out[np.ix_(row[a:b], row[a:b])] += np.minimum.outer(more[a:b], more[a:b])
    return out


def forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join what the pairs before them left apart."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def tile_links(similarity: float):
    """Links of one tile: rows with side 0 (the leader of a cut bucket), 1 (compared with all) or 2 (compared with side 1).

    Beside the links (a, b) come the members of side 1 that their leader isn't near to, with b null.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "key"]).reset_index(drop=True)
        side, keys, band = frame["side"].to_numpy(), frame["key"].tolist(), int(frame["band"].iloc[0])
        sets = [np.frombuffer(x, np.uint64) for x in frame["grams"]]
        weights = [weight(np.frombuffer(n, "<u4")) if len(n) else np.ones(len(x)) for n, x in zip(frame["times"], sets)]
        size = np.array([w.sum() for w in weights])
        both = common_weights(sets, weights)
        near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
        near[np.ix_(side == 2, side == 2)] = False
        kept = forest(*np.nonzero(np.triu(near, 1)), len(sets))
        rest = np.flatnonzero((side == 1) & ~near[0]) if side[0] == 0 else []
        a, b = [keys[x] for x, _ in kept] + [keys[x] for x in rest], [keys[y] for _, y in kept] + [None for _ in rest]
        return pd.DataFrame({"a": a, "b": b, "band": band})

    return run


def hung(edges: DataFrame, least: DataFrame, hot: bool) -> tuple[DataFrame, list[DataFrame]]:
    """``edges`` (a, b) with m of ``least`` (a, m, n), and the tables written for that: a hot node is joined evenly."""
    if not hot:
        return edges.join(least.drop("n"), "a"), []
    least = written(least, "least")
    return joined_evenly(edges, least, ["a"], "n"), [least]


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for each node that has a link (a, b).

    Alternating large and small stars: in each round all of a node's larger neighbours are hung on its least one, then
    all smaller ones. Rounds end when nothing moves; their number grows with the logarithm of the longest path.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = ways.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
        if seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state, hot = seen, (seen[2] or 0) > hot_from(seen[0] or 0)
        n = F.count(F.lit(1)).alias("n")
        met, used = hung(ways, ways.groupBy("a").agg(F.min("b").alias("m"), n).select("a", F.least("a", "m").alias("m"), "n"), hot)
        large = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        if hot:
            used.append(large := written(large, "large"))
        met, more = hung(large, large.groupBy("a").agg(F.min("b").alias("m"), n), hot)
        small = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(small.select("e.*").where(F.col("a") != F.col("b")).distinct(), "links")
        emptied(edges, *used, *more)
        edges = after


def links_of(texts: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b: keys of near texts, of each two that share a bucket a link or a path of links.

    ``texts``: key, doc_id, n, bands. ``docs``: doc_id, text; of each text the rows of its least doc_id are looked at.
    """
    banded = texts.select("key", "n", F.explode("bands").alias("band"))
    # most bands have one text; only the others are looked at further
    shared = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).select("band"), "shared-bands")
    banded = sifted(banded, "band", shared).where("held").drop("held")
    # two hashes and the number of members stand for the members themselves
    sized = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("who_else"),
        F.sum("n").alias("n"), F.min("key").alias("leader"),
    ).where(F.col("members") > 1)
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    once = sized.groupBy("members", "who", "who_else").agg(F.min(F.struct("band", blocks.alias("blocks"), "leader")).alias("m"))
    once = written(once.select("m.*", "members"), "bucket-sizes")
    held = sifted(banded.select("key", "band"), "band", once.select("band")).where("held").drop("held")
    buckets = written(
        joined_evenly(held, once, ["band"], "members").withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")), "buckets"
    )
    # the texts of members, one row each, before anything is shuffled
    wanted = written(texts.select("key", "doc_id").join(buckets.select("key").distinct(), "key", "left_semi"), "wanted")
    rows = sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted.select("doc_id")).where("held")
    rows = rows.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted.select("key"), "key", "left_semi")
    sets = written(grams(chosen, width), "grams")
    found = "a binary, b binary, band long"
    own = buckets.select("band", F.col("own").alias("i"), F.lit(1).alias("side"), "key")
    # a leader meets its set once, and is copied for the blocks of its bucket after that
    led = once.where("blocks > 1").select("band", "blocks", F.col("leader").alias("key")).join(sets, "key")
    leaders = led.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0)).drop("blocks")
    first = written(own.join(sets, "key").unionByName(leaders).groupBy("band", "i").applyInPandas(tile_links(similarity), found), "tiles")
    # what the leader of a cut bucket isn't near to meets the other blocks too
    linked = first.where("b IS NOT NULL").select("a", "b")
    if first.where("b IS NULL").isEmpty():
        emptied(shared, once, buckets, wanted, sets)
        return linked
    rest = first.where("b IS NULL").select("band", F.col("a").alias("key")).distinct()
    dealt = rest.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    sizes = written(dealt.join(once, "band").select("band", F.ceil(F.col("k") / BLOCK).cast("int").alias("lots"), "blocks", "members", "k"), "rests")
    asked = joined_evenly(rest, sizes.select("band", "lots", "blocks", F.col("k").alias("rows")), ["band"], "rows").select(
        "band", F.pmod(F.xxhash64("key", F.lit(2)), F.col("lots")).cast("int").alias("lot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(1).alias("side"), "key"
    )
    met = joined_evenly(own.drop("side"), sizes.select("band", "lots", F.col("members").alias("rows")), ["band"], "rows").select(
        "band", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "i", F.lit(2).alias("side"), "key"
    )
    second = asked.unionByName(met).join(sets, "key").groupBy("band", "lot", "i").applyInPandas(tile_links(similarity), found)
    links = written(linked.unionByName(second.where("b IS NOT NULL").select("a", "b")), "near")
    emptied(shared, once, buckets, wanted, sets, first, sizes)
    return links


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, coordinates: int = COORDINATES, bands: int = BANDS
) -> tuple[DataFrame, DataFrame]:
    """Two tables: key, doc_id of each row of ``docs`` (doc_id, text); and of each distinct text key, class_id, root,
    doc_id (the least of the text's) and rows.

    class_id is the least doc_id of the class. Texts with the same words are one class at least; case and white space
    don't count. A text of fewer than ``width`` words is a single shingle; texts without words (null, empty) are copies
    of each other and near to no other. Null doc_ids don't name a class unless all its ids are null. An empty table
    gives no rows.
    """
    keyed = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(signed(keyed, width, coordinates, bands), "signed")
    texts = written(
        rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts"
    )
    roots = components(links_of(texts, docs, width, similarity)).withColumnRenamed("node", "key")
    rooted = written(texts.select("key", "doc_id", "rows").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    classes = written(joined_evenly(rooted, named, ["root"], "n"), "classes")
    emptied(texts, rooted, named)
    return rows.select("key", "doc_id"), classes


def classed(docs: DataFrame, **how: float) -> DataFrame:
    """``docs`` with class_id, as ``near_duplicates`` says; a column of that name is replaced, all others stay."""
    _, classes = near_duplicates(docs, **how)
    keyed = carried(docs, ["class_id"], key=text_key(F.col("text")))
    return joined_evenly(keyed, classes.select("key", "class_id", "rows"), ["key"], "rows").select("row.*", "class_id")


def deduplicated(docs: DataFrame, **how: float) -> DataFrame:
    """One row of ``docs`` for each class: the one with the class's least doc_id (of several such, any one of them).

    Rows that stay are told by their doc_id alone where no other row has it; only those that go, and rows whose doc_id
    isn't theirs alone, are shuffled.
    """
    rows, classes = near_duplicates(docs, **how)
    pair = ["key", "id", "none"]
    ided = lambda df: df.withColumns({"id": F.coalesce("doc_id", F.lit(0).cast("long")), "none": F.col("doc_id").isNull()})
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    chosen = written(ided(least.select("m.key", "m.doc_id")).select(*pair, F.lit(True).alias("stays")), "chosen")
    found = ided(rows).groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).join(chosen, pair, "left")
    loose = found.where(F.col("stays").isNull() | (F.col("n") > 1)).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"))
    loose = written(loose, "loose")
    sifting = sifted(carried(docs, doc_id=F.col("doc_id").cast("long")), "doc_id", loose)
    sure = sifting.where(~F.col("held")).select("row.*")
    unsure = ided(sifting.where("held").withColumn("key", text_key(F.col("row.text")))).groupBy(*pair).agg(F.first("row").alias("row"))
    return sure.union(unsure.join(chosen, pair, "left_semi").select("row.*"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return joined_evenly(rows, classes.select("key", "class_id", "rows"), ["key"], "rows").select("doc_id", "class_id")
