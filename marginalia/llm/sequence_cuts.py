"""Packing that keeps the order of documents: windows over their stream, cut by dynamic programming.

The documents of a partition, one after the other, are a stream of tokens. It may be cut after a document, after a sentence
and, where neither comes for long, after a word. The chosen cuts minimise what the sequences between them are padded with,
plus a penalty for each cut inside a document, plus a small charge for each sequence. A sequence is filled up to ``size``
unless its length is a power of two, so the least cost of a cut is the least over the cuts at most ``size`` before it of
(their cost - tokens between), which a monotone queue holds, or over the few cuts exactly a power of two before it.

A task reads its partition as a stream. It settles cuts as soon as every way on shares them, and forgets what lies before.
Sequences don't span partitions: no row is shuffled, and a lost task is repeated alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenise import WordTokeniser, default_path, word_tokeniser

SIZE, END = 4096, 2

#: Tokens of padding that a cut after a sentence, after a word and within a word, and a sequence as such, are worth.
SENTENCE, WORD, SPLIT, EACH = 16, 64, 128, 16

#: Tokens without a cut, after which a word's end is one; windows that are planned at a time, and at most while ways differ.
STRETCH, WINDOWS, MOST_WINDOWS = 256, 64, 1024

#: Texts that a worker tokenises at once.
BATCH = 400


class Marks:
    """Which tokens of a vocabulary end a sentence or a word, and which are digits."""

    def __init__(self, own: WordTokeniser) -> None:
        self.ends_word = own.ends_word
        self.ends_sentence, self.digit = np.zeros_like(own.ends_word), np.zeros_like(own.ends_word)
        for token, i in own.tokenizer.get_vocab(with_added_tokens=True).items():
            sign = token.removesuffix("</w>")
            self.ends_sentence[i] = token.endswith("</w>") and sign.strip("\"')]}") != "" and not sign.strip(".!?\"')]}")
            self.digit[i] = len(sign) == 1 and sign.isdigit()
        for sign in "…。！？":
            ids = own.tokenizer.encode(sign, add_special_tokens=False).ids
            if len(ids) == 1:
                self.ends_sentence[ids[0]] = True

    def cuts(self, ids: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """Places after which a document's ``ids`` (its end token included) may be cut, ascending, and their penalties."""
        n = len(ids)
        sentence = self.ends_sentence[ids]
        sentence[:-1] &= ~self.digit[ids[1:]]  # 3.14
        at = np.flatnonzero(sentence[: max(0, n - 2)]) + 1  # not just before the end token
        at = np.append(at, n)
        cost = np.full(len(at), SENTENCE)
        cost[-1] = 0
        gaps = np.diff(at, prepend=0)
        if gaps.max() > stretch:
            words = np.flatnonzero(self.ends_word[ids]) + 1
            more = []
            for b, gap in zip(at[gaps > stretch].tolist(), gaps[gaps > stretch].tolist()):
                a = b - gap
                for limit in range(a + stretch, b, stretch):
                    k = int(np.searchsorted(words, limit, "right")) - 1
                    more.append((int(words[k]), WORD) if k >= 0 and words[k] > limit - stretch else (limit, SPLIT))
            at, cost = np.append(at, [x for x, _ in more]), np.append(cost, [c for _, c in more])
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        return at, cost


def settled(at: np.ndarray, cost: np.ndarray, size: int = SIZE, each: int = EACH) -> tuple[list[int], list[int]]:
    """For each cut the least cost of all up to it, and the cut before it on that way.

    ``at``: ascending places, the first the start of the stream, no two neighbours more than ``size`` apart; ``cost``: their penalties.
    """
    ahead, behind = [], []
    for k in range(size.bit_length()):
        if 1 << k < size:
            i = np.searchsorted(at, at - (1 << k))
            j = np.flatnonzero(at[np.minimum(i, len(at) - 1)] == at - (1 << k))
            ahead.append(j)
            behind.append(i[j])
    ahead, behind = np.concatenate([*ahead, [len(at)]]), np.concatenate([*behind, [0]])  # the last is a guard
    order = np.argsort(ahead, kind="stable")
    exact, exact_from, e = ahead[order].tolist(), behind[order].tolist(), 0
    places, penalties = at.tolist(), cost.tolist()
    least, back = [0] * len(places), [0] * len(places)
    queue, keys, head = [0], [places[0]], 0  # cuts by rising (least + place): the monotone queue
    for j in range(1, len(places)):
        here = places[j]
        while places[queue[head]] < here - size:
            head += 1
        best, way = keys[head] + size - here, queue[head]
        while exact[e] == j:
            if least[exact_from[e]] < best:
                best, way = least[exact_from[e]], exact_from[e]
            e += 1
        least[j], back[j] = best + penalties[j] + each, way
        key = least[j] + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    return least, back


def shared(at: np.ndarray, back: list[int], size: int = SIZE) -> int:
    """The last cut that the ways to all cuts within ``size`` of the end have in common: whatever follows, it is on the way."""
    live = [-i for i in range(int(np.searchsorted(at, at[-1] - size)), len(at))]
    heapq.heapify(live)
    while live:
        top = -live[0]
        while live and -live[0] == top:
            heapq.heappop(live)
        if not live:
            return top
        heapq.heappush(live, -back[top])
    return 0


def way_to(back: list[int], end: int) -> list[int]:
    out = []
    while end:
        out.append(end)
        end = back[end]
    return out[::-1]


class Stream:
    """The tokens of a partition that aren't in sequences yet."""

    def __init__(self, first: int, size: int, windows: int, most: int) -> None:
        self.sequence, self.size, self.windows, self.most = first, size, windows, most
        self.docs: list[tuple[object, bytes, int]] = []  # id, all ids, where they begin (before 0: in part in sequences already)
        self.places, self.costs = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.end, self.due = 0, windows * size

    def add(self, doc_id: object, ids: bytes, at: np.ndarray, cost: np.ndarray) -> None:
        self.docs.append((doc_id, ids, self.end))
        self.places.append(at + self.end)
        self.costs.append(cost)
        self.end += len(ids) // 4

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Pieces of the sequences that are settled; of all that there is, if it is the last."""
        if not self.end or not last and self.end < self.due:
            return
        at, cost = np.concatenate(self.places), np.concatenate(self.costs)
        if last:  # the tail may be cut anywhere, so that it can fall into powers of two
            anywhere = np.setdiff1d(np.arange(max(1, self.end - self.size), self.end), at)
            at, cost = np.append(at, anywhere), np.append(cost, np.full(len(anywhere), SPLIT))
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        least, back = settled(at, cost, self.size)
        upto = len(at) - 1 if last else shared(at, back, self.size)
        if not upto and self.end >= self.most * self.size:  # ways that never meet: the cheapest one is taken, but for its last windows
            live = int(np.searchsorted(at, at[-1] - self.size))
            way = way_to(back, min(range(live, len(at)), key=least.__getitem__))
            upto = way[max(0, len(way) - self.windows // 2)]
        if not upto:
            self.due = 2 * self.end
            return
        yield from self._cut(at[way_to(back, upto)].tolist())
        gone = int(at[upto])
        self.places, self.costs = [at[upto:] - gone], [cost[upto:]]
        self.docs = [(d, ids, start - gone) for d, ids, start in self.docs if start + len(ids) // 4 > gone]
        self.end -= gone
        self.due = max(self.windows * self.size, self.end + self.windows * self.size // 2)

    def _cut(self, ends: list[int]) -> Iterator[tuple]:
        """Rows of the sequences that end at ``ends``, the first of which begins at 0."""
        window, begin = 0, 0
        for doc_id, ids, start in self.docs:
            a, stop = max(start, 0), start + len(ids) // 4
            while a < stop and window < len(ends):
                b = min(stop, ends[window])
                part = ids[4 * (a - start) : 4 * (b - start)]
                yield doc_id, a - start, b - a, zlib.crc32(part), len(ids) // 4, self.sequence, a - begin, part
                a = b
                if b == ends[window]:
                    window, begin = window + 1, b
                    self.sequence += 1


@lru_cache(maxsize=2)
def marks(path: str) -> Marks:
    return Marks(word_tokeniser(path))


def pack_in_order(
    docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end: int = END, order: Sequence[str] = (), with_ids: bool = False,
    windows: int = WINDOWS, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian bytes of 4 each).

    A document is the ids of its text and the id ``end``. Sequences hold at most ``size`` ids and keep the order of the
    table: sequence_id and offset ascend with it. ``order``: columns to sort the table by first, by ranges. ``size`` is a
    power of two. Cuts are the best ones for a partition as long as ways meet within ``most_windows`` windows (``settled``). A null or empty text is the
    token ``end`` alone; repeated rows and null ids are documents like any others; a text of any length is cut. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = tokenizer or default_path()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    tail = end.to_bytes(4, "little")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([r[: len(columns)] for r in rows], columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, where = word_tokeniser(path).ids, marks(path)
        stream = Stream(TaskContext.get().partitionId() << 40, size, windows, most_windows)
        for f in frames:
            for at in range(0, len(f), BATCH):
                part, rows = f.iloc[at : at + BATCH], []
                for doc_id, ids in zip(part["doc_id"], encode(part["text"].tolist())):
                    ids += tail
                    stream.add(doc_id, ids, *where.cuts(np.frombuffer(ids, "<u4"), min(STRETCH, size)))
                    rows.extend(stream.flush())
                if rows:
                    yield frame(rows)
        if rows := list(stream.flush(last=True)):
            yield frame(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def op11_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_in_order(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
