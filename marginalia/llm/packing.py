"""Best-fit packing by a plan over lengths.

Only the histogram of piece lengths, at most one row for each length, comes to the driver. There best-fit decreasing
runs over counts: equal sequences are kept as runs, and a length's pieces go to the runs with the least space that
holds them. The plan says which ranks among the pieces of a length take which run of sequences at which offset; pieces
are then numbered within their length, and take their slots by a join on length and rank. Neither a length that a third
of all pieces have nor the number of documents makes a task larger.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_rank, written
from .tokenise import default_path, word_tokeniser

SIZE, END = 4096, 1

#: Ranks that share a join key with the plan; texts that a worker tokenises at once.
CHUNK, BATCH = 1024, 400


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end: int = END, with_ids: bool = False, entries: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's tokens and the id ``end``, cut every ``size``.

    ids are bytes, little-endian numbers of 2 bytes each if all of a piece fit, else of 4. ``entries``: of a worker's tables.
    """
    path = tokenizer or default_path()
    tail = end.to_bytes(4, "little")

    def narrow(x: bytes) -> bytes:
        ids = np.frombuffer(x, "<u4")
        return ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else x

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_tokeniser(path, entries).ids
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part, rows = frame.iloc[at : at + BATCH], []
                for doc_id, ids in zip(part["doc_id"], encode(part["text"].tolist())):
                    ids += tail
                    for k, b in enumerate(range(0, len(ids), 4 * size)):
                        x = ids[b : b + 4 * size]
                        rows.append((doc_id, k, b // 4, len(x) // 4, zlib.crc32(x), narrow(x) if with_ids else None))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out if with_ids else out.drop(columns="ids")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def plan(counts: Mapping[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): best-fit decreasing over ``counts`` of each length.

    The pieces of a length with ranks first, first + 1, ... go to the sequences from first sequence on, one each, at
    the same offset.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, number)
    spaces: list[int] = []  # that have runs, ascending
    placed, opened = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if not runs.get(free):
                insort(spaces, free)
            runs.setdefault(free, []).append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                free = spaces[k]
                first, n = runs[free].pop()
                if not runs[free]:
                    spaces.pop(k)
            else:
                free, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = free // length
            whole, rest = min(n, left // each), 0
            for j in range(each):
                if whole:
                    placed.append((length, rank, whole, first, size - free + j * length))
                    rank += whole
            left -= whole * each
            if whole < n and left:  # fewer are left than the next sequence could take
                rest = left
                for j in range(rest):
                    placed.append((length, rank, 1, first + whole, size - free + j * length))
                    rank += 1
                left = 0
            put(free - each * length, first, whole)
            if rest:
                put(free - rest * length, first + whole, 1)
            put(free, first + whole + bool(rest), n - whole - bool(rest))
    return placed


def widened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["ids"] = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("int32") for x, n in zip(f["ids"], f["length"])]
        yield f


def pack(
    docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end: int = END, with_ids: bool = False, with_epoch: bool = False, in_sequence: bool = False, id_bytes: bool = False, entries: int | None = None
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and epoch, and ids).

    ``tokenizer``: the place of a vocabulary file. A null or empty text is the single token ``end``; repeated rows and
    null ids are packed like any others; a text of any length is cut into as many pieces as it takes, only the last
    one shorter than ``size``. epoch: 0, 1, ... for the uses of a document, rows with one id and one text; which piece of
    which use comes first is open. ids: array<int>, or with ``id_bytes`` the bytes of ``pieces``; places are planned without, and join them at the end.
    ``in_sequence``: the pieces of a sequence stand one after the other in one partition. Other columns of ``docs`` are
    ignored; an empty table gives no rows. ``entries``: how many chunks a worker's two tables keep together, which is a
    matter of memory and time alone.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, size, tokenizer, end, with_ids, entries).withColumn("nr", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "planned long, first long, n long, sequence long, offset long"
    slots = spark.createDataFrame(plan(counts, size), schema).withColumn(
        "part", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"(first + n - 1) div {CHUNK}")))
    )
    ranked = gapless_rank(cut.drop("ids"), ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    at = F.col("rank") - F.col("first")
    on = (F.col("length") == F.col("planned")) & (F.expr(f"rank div {CHUNK}") == F.col("part")) & (at >= 0) & (at < F.col("n"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "nr"]
    placed = ranked.join(slots, on).select(*own, (F.col("sequence") + at).alias("sequence_id"), "offset")
    if with_epoch:
        # 128 bits, so that no two pieces take each other for uses of one; a row repeated very often is numbered by many tasks
        keyed = placed.withColumn("use", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "piece", "start", "length", "ids_crc32")))
        placed = gapless_rank(written(keyed, "placed"), ["use"], ["sequence_id", "offset"], "epoch").drop("use")
    if with_ids:
        placed = placed.join(cut.select("nr", "ids"), "nr")
    placed = placed.drop("nr")
    if in_sequence:
        placed = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    if not with_ids or id_bytes:
        return placed
    return placed.mapInPandas(widened, ", ".join(f"{c} {'array<int>' if c == 'ids' else t}" for c, t in placed.dtypes))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
