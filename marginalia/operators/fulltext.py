"""Full-text search on an inverted index: a written table of postings, in folders by a hash of the term.

``build`` reads all texts once. A search then reads the folders of the terms that are asked for and nothing else:
postings carry what ranking and order need of their item. Any number of queries is answered at once: postings that
queries ask for are dealt over lots of items, and a lot's task passes on each query's best alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import new_path, stored

#: A term: a run of letters and digits, in lower case.
TERM = r"[\p{L}\p{N}]+"

#: Folders that terms are dealt into; rows of queries' terms that may be broadcast, which are counted first.
PARTS, BROADCAST_ROWS = 64, 50_000

#: Items whose terms are counted at a time; postings of a lot of items that queries meet in one task.
COUNTED_ROWS, LOT_ROWS = 1000, 2_000_000

#: Okapi BM25: how soon repetition saturates, and how much length counts.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass
class Index:
    """postings: part, term, id, n (times the item has the term), length (terms of the item), created_at. totals: items, length (of all), parts."""

    postings: DataFrame
    totals: DataFrame


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of an item's distinct terms, with n: how often it has it."""
    for batch in batches:
        for at in range(0, len(batch), COUNTED_ROWS):
            part = batch.slice(at, COUNTED_ROWS)
            codes = part["terms"].flatten().dictionary_encode()
            width = max(1, len(codes.dictionary))
            row = np.repeat(np.arange(len(part)), pc.list_value_length(part["terms"]).to_numpy(zero_copy_only=False))
            both, n = np.unique(row * width + codes.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(both, width)
            own = [part[c].take(pa.array(row)) for c in ("id", "created_at", "length")]
            yield pa.RecordBatch.from_arrays([*own, codes.dictionary.take(pa.array(code)), pa.array(n)], ["id", "created_at", "length", "term", "n"])


def build(items: DataFrame, path: str | None = None, parts: int = PARTS) -> Index:
    """The index of ``items`` (id, text, created_at), written to ``path``. An item without terms counts, and nothing finds it.

    Items' terms are counted where their texts are read and written from there, so postings aren't shuffled. Rows with one id,
    time and length are one item; only rows whose ids repeat meet for that.
    """
    path = path or new_path(items.sparkSession, "fulltext")
    held = items.select("id", "created_at", terms(F.col("text")).alias("terms")).withColumn("length", F.size("terms").cast("long"))
    repeated = stored(items.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("twice")), name="repeated")
    own = ["id", "created_at", "length", "term"]
    alone, again = held, None
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("twice"))
        alone, again = held.join(repeated, same, "left_anti"), held.join(repeated, same, "left_semi")
    each = alone.mapInArrow(counted, "id long, created_at timestamp_ntz, length long, term string, n long")
    if again:
        each = each.unionByName(again.select(*own[:3], F.explode("terms").alias("term")).groupBy(*own).agg(F.count(F.lit(1)).alias("n")))
    each.withColumn("part", part(F.col("term"), parts)).write.partitionBy("part").parquet(f"{path}/postings")
    held.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.lit(parts).alias("parts")).write.parquet(f"{path}/totals")
    return opened(items.sparkSession, path)


def opened(spark: SparkSession, path: str) -> Index:
    schema = "id long, created_at timestamp_ntz, length long, term string, n long, part int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def asked(index: Index, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, term, of (distinct terms of the query), and the postings in their folders."""
    parts = index.totals.first()["parts"]
    own = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms"))
    own = own.select("query_id", F.size("terms").alias("of"), F.explode("terms").alias("term")).withColumn("part", part(F.col("term"), parts))
    folders = [r[0] for r in own.select("part").distinct().collect()]  # at most as many as there are
    return own, index.postings.where(F.col("part").isin(folders))


def small(df: DataFrame) -> DataFrame:
    """``df`` (written, or soon evaluated) marked to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first(found: DataFrame, k: int, *order: Column) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def lots_best(k: int, all_terms: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query's best of a lot: the latest items with all its terms, or those of the highest sums of weights. A tile is a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list[pa.RecordBatch], list[pa.RecordBatch]] = ([], [])
        for batch in batches:
            for side in (0, 1):
                sides[side].append(batch.filter(pc.equal(batch["side"], side)))
        asked, held = (pa.Table.from_batches(x) if x else None for x in sides)
        if not asked or not held:  # no rows are no tables either
            return
        code, created = held["code"].to_numpy(), held["created"].to_numpy()
        order = np.argsort(code, kind="stable")
        code, created, weight = code[order], created[order], held["weight"].to_numpy()[order]
        ids = held["id"].combine_chunks().take(pa.array(order)).dictionary_encode(null_encoding="encode")
        by_id = np.argsort(pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy())
        item = by_id[ids.indices.to_numpy()]  # items by the order of their ids
        if all_terms:  # rows of one id at two times are two items
            keys, item = np.unique(np.stack([item, created]), axis=1, return_inverse=True)
            named, time = keys
        else:
            named, time = np.arange(len(ids.dictionary)), np.zeros(len(ids.dictionary), "int64")
        texts = ids.dictionary.take(pa.array(np.argsort(by_id)))
        queries = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        of_query, term, idf, of = queries.indices.to_numpy(), asked["code"].to_numpy(), asked["weight"].to_numpy(), asked["of"].to_numpy()
        low, high = np.searchsorted(code, term), np.searchsorted(code, term, "right")
        for q in range(len(queries.dictionary)):
            own = np.flatnonzero((of_query == q) & (high > low))
            if not len(own):
                continue
            at = np.concatenate([np.arange(low[t], high[t]) for t in own])
            score = np.bincount(item[at], weight[at] * np.repeat(idf[own], high[own] - low[own]), len(named))
            if all_terms:
                found = np.flatnonzero(score == of[own[0]])
                best = found[np.lexsort((named[found], -time[found]))[:k]]
            else:
                found = np.flatnonzero(np.bincount(item[at], minlength=len(named)))
                told = np.round(score[found], 9)
                if len(found) > k:  # those that reach the k-th best, ties included
                    near = told >= np.partition(told, len(told) - k)[len(told) - k]
                    found, told = found[near], told[near]
                best = found[np.lexsort((named[found], -told))[:k]]
            yield pa.RecordBatch.from_arrays(
                [queries.dictionary.take(pa.array(np.full(len(best), q))), texts.take(pa.array(named[best])), pa.array(time[best]), pa.array(score[best])], ["query_id", "id", "created", "score"]
            )

    return run


def met(own: DataFrame, postings: DataFrame, weight: Column, k: int, all_terms: bool) -> DataFrame:
    """query_id, id, created, score of each lot's best. ``own``: query_id, part, term, of, idf; ``weight``: of a posting, for a term of idf 1.

    Lots hold a bounded number of postings, blocks of queries a bounded number of terms; a posting is sent once to each block.
    """
    own = stored(own, name="asked")
    wanted = stored(own.select("part", "term").distinct().withColumn("code", F.monotonically_increasing_id()), name="wanted")
    blocks = max(1, math.ceil(own.count() / BROADCAST_ROWS))
    micros = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62)))
    hits = postings.join(small(wanted), ["part", "term"]).select("code", "id", micros.alias("created"), weight.cast("double").alias("weight"))
    lots = max(1, math.ceil(hits.select("code").count() / LOT_ROWS))
    lots = max(lots, math.ceil(own.sparkSession.sparkContext.defaultParallelism / blocks))
    block, lot = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(own.dtypes)["query_id"]
    asked = own.join(small(wanted), ["part", "term"]).select(
        block.alias("block"), every(lots).alias("lot"), F.lit(0).alias("side"), "code", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("created"), F.col("idf").alias("weight"), "query_id", "of"
    )
    hits = hits.select(every(blocks).alias("block"), lot.alias("lot"), F.lit(1).alias("side"), "code", "id", "created", "weight", F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("of"))
    tiles = asked.unionByName(hits).withColumn("tile", F.col("block") * lots + F.col("lot")).drop("block", "lot")
    return tiles.repartitionById(blocks * lots, "tile").mapInArrow(lots_best(k, all_terms), f"query_id {kind}, id long, created long, score double")


def matching(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, created_at, rank: the latest ``k`` items that have all terms of a query (query_id, text).

    Terms ask for whole words, whatever their case; signs are ignored, a query without terms finds nothing.
    """
    own, postings = asked(index, queries)
    found = met(own.withColumn("idf", F.lit(1.0)), postings, F.lit(1), k, True)
    created = F.when(F.col("created") > -(1 << 62), F.timestamp_micros("created").cast("timestamp_ntz"))
    return first(found.select("query_id", "id", created.alias("created_at")), k, F.col("created_at").desc(), F.col("id"))


def idf(items: Column, having: Column) -> Column:
    return F.log(1 + (items - having + 0.5) / (having + 0.5))


def best(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank: the ``k`` items of the highest BM25 score, those with any of a query's terms."""
    own, postings = asked(index, queries)
    wanted = small(own.select("part", "term").distinct())
    having = postings.join(wanted, ["part", "term"], "left_semi").groupBy("part", "term").agg(F.count(F.lit(1)).alias("having"))
    totals = index.totals.first()
    n, mean = F.lit(float(totals["items"])), float(totals["length"]) / max(1, totals["items"])
    weighted = own.join(having, ["part", "term"]).select("query_id", "part", "term", "of", idf(n, F.col("having")).alias("idf"))
    share = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    scored = met(weighted, postings, share, k, False)
    return first(scored.select("query_id", "id", "score"), k, F.round("score", 9).desc(), F.col("id"))


def matching_by_scan(items: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """What ``matching`` finds, by reading all texts: for archives without an index, and to check one."""
    own = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("asked")).where(F.size("asked") > 0)
    held = items.select("id", "created_at", F.array_distinct(terms(F.col("text"))).alias("held"))
    each = held.select("id", "created_at", "held", F.explode("held").alias("one"))
    hits = each.join(own.withColumn("one", F.element_at("asked", 1)), "one").where(F.size(F.array_except("asked", "held")) == 0)
    return first(hits.select("query_id", "id", "created_at"), k, F.col("created_at").desc(), F.col("id"))
