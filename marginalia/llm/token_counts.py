"""Edit-aware token counts: a segment tree over the pre-tokens of each document, and recounts of what edits touch.

Leaves are stretches of whole pre-tokens. A text is cut where the tokenizer's pre-tokens part whatever stands further
left or right: before a single space between two other characters, and between letters, digits and other signs (not
after an apostrophe, which a few letters may follow in one pre-token). So the counts of leaves add up to the count of the
text, inner nodes hold the sums of their leaves, and an edit changes the count only of leaves that it touches and of
neighbours that it joins to them, where the characters around a cut are changed. Those are encoded again, and the sums
above them updated; all others stay.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, written
from .secrets import found
from .tokenise import default_path

#: Characters of a leaf, at least (the last one may be shorter).
LEAF = 256

#: What the registered query masks: long numbers and addresses of electronic mail.
MASKED, MASK = r"[0-9]{5,}|[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[masked]"

_CUT = regex.compile(
    r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
)

Count = Callable[[list[str]], list[int]]


@lru_cache(maxsize=2)
def byte_counter(path: str) -> Count:
    """Numbers of tokens of texts under a byte-level vocabulary of ranks; the signs of special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [len(encode(t)) for t in texts]


def cut(text: str, leaf: int = LEAF) -> list[int]:
    """Where the leaves of ``text`` begin; an empty text has none."""
    starts, at = [0] if text else [], 0
    while (m := _CUT.search(text, at + leaf)) is not None:
        starts.append(at := m.start())
    return starts


def tree(counts: Sequence[int]) -> list[int]:
    """Node 1 is the root, nodes 2 i and 2 i + 1 are below node i, and leaves begin at half the length; node 0 is unused."""
    m = 1 << max(0, (len(counts) - 1).bit_length())
    level = np.zeros(m, np.int64)
    level[: len(counts)] = counts
    out = np.zeros(2 * m, np.int64)
    while True:
        out[len(level) : 2 * len(level)] = level
        if len(level) == 1:
            return out.tolist()
        level = level[0::2] + level[1::2]


def ordered(edits: Sequence[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Edits by place, within the text; one that begins before the end of an earlier one is left out."""
    out: list[tuple[int, int, str]] = []
    for a, b, new in sorted((min(max(a, 0), n), min(max(a, b, 0), n), new or "") for a, b, new in edits):
        if not out or a >= out[-1][1]:
            out.append((a, b, new))
    return out


def edited(text: str, edits: Sequence[tuple[int, int, str]], low: int = 0, high: int | None = None) -> str:
    """text[low:high] with those of the ordered ``edits`` that lie there."""
    parts, at, high = [], low, len(text) if high is None else high
    for a, b, new in edits:
        parts += [text[at:a], new]
        at = b
    return "".join(parts) + text[at:high]


def touched(text: str, starts: list[int], edits: Sequence[tuple[int, int, str]]) -> list[tuple[int, int, deque[str]]]:
    """First leaf, last leaf and new text (in parts) of each stretch of leaves to be cut anew, none next to a false cut.

    A stretch takes in a neighbour while the characters at its end no longer make a cut; every leaf is taken in once.
    """
    ends, last = [*starts[1:], len(text)], len(starts) - 1
    base: list[list] = []
    for e in edits:
        i, j = bisect_right(starts, e[0]) - 1, bisect_right(starts, max(e[0], e[1] - 1)) - 1
        if base and i <= base[-1][1]:
            base[-1][1] = max(j, base[-1][1])
            base[-1][2].append(e)
        else:
            base.append([i, j, [e]])
    out: list[tuple[int, int, deque[str]]] = []
    for n, (i, j, own) in enumerate(base):
        parts = deque(filter(None, [edited(text, own, starts[i], ends[j])]))
        after = base[n + 1][0] if n + 1 < len(base) else len(starts)
        while True:
            if i > 0:
                met = bool(out) and out[-1][1] == i - 1
                before = (out[-1][2][-1][-1:] if out[-1][2] else "") if met else text[starts[i] - 1]
                if not before or not _CUT.match(before + "".join(islice(parts, 2))[:2], 1):
                    if met:
                        i, _, left = out.pop()
                        left.extend(parts)
                        parts = left
                    else:
                        i -= 1
                        parts.appendleft(text[starts[i] : ends[i]])
                    continue
            if j < last and j + 1 < after and (not parts or not _CUT.match(parts[-1][-1] + text[starts[j + 1] : starts[j + 1] + 2], 1)):
                j += 1
                parts.append(text[starts[j] : ends[j]])
                continue
            break
        out.append((i, j, parts))
    return out


def recount(
    text: str, starts: list[int], sums: list[int], edits: Sequence[tuple[int, int, str]], count: Count, leaf: int = LEAF
) -> tuple[str, list[int], list[int], int]:
    """The edited text, its leaves' starts, its tree, and how many leaves were encoded for that."""
    edits = ordered(edits, len(text))
    if not edits:
        return text, starts, sums, 0
    if not text:
        new = edited(text, edits)
        at = cut(new, leaf)
        return new, at, tree(count([new[a:b] for a, b in zip(at, [*at[1:], len(new)])])), len(at)
    last = len(starts) - 1
    done = [(i, j, "".join(parts)) for i, j, parts in touched(text, starts, edits)]
    m = len(sums) // 2
    old, parts, leaves, counts = sums[m : m + len(starts)], [], [], []
    at = length = encoded = 0
    in_place, changes = True, []
    for i, j, part in done:
        for k in range(at, i):
            leaves.append(length + starts[k] - starts[at])
        parts.append(text[starts[at] : starts[i]] if i > at else "")
        length += len(parts[-1])
        counts += old[at:i]
        inner = cut(part, leaf)
        fresh = count([part[a:b] for a, b in zip(inner, [*inner[1:], len(part)])])
        in_place &= len(inner) == j - i + 1
        changes += [(k, c) for k, c in zip(range(i, j + 1), fresh)]
        leaves += [length + a for a in inner]
        counts += fresh
        parts.append(part)
        length, encoded, at = length + len(part), encoded + len(inner), j + 1
    if at <= last:
        leaves += [length + starts[k] - starts[at] for k in range(at, last + 1)]
        parts.append(text[starts[at] :])
        counts += old[at:]
    if not in_place:
        return "".join(parts), leaves, tree(counts), encoded
    sums = list(sums)
    for k, c in changes:
        node, more = m + k, c - sums[m + k]
        while node:
            sums[node] += more
            node //= 2
    return "".join(parts), leaves, sums, encoded


def with_trees(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` with token_leaves (array<int>: where leaves begin) and token_tree (array<long>) of each whole text.

    A null text counts as an empty one: no leaves, a tree of the sum 0. Columns of these names, in any case, are
    replaced, all others stay.
    """
    path = path or default_path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("leaves array<int>, tree array<long>")
    def build(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = byte_counter(path)
        for texts in frames:
            rows = []
            for text in texts:
                at = cut(text or "", leaf)
                rows.append((at, tree(count([text[a:b] for a, b in zip(at, [*at[1:], len(text)])] if at else []))))
            yield pd.DataFrame(rows, columns=["leaves", "tree"])

    rows = carried(docs, ["token_leaves", "token_tree"], made=build("text"))
    return rows.select("row.*", F.col("made.leaves").alias("token_leaves"), F.col("made.tree").alias("token_tree"))


def with_edits(docs: DataFrame, edits: Column, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` of ``with_trees`` after ``edits``: text, token_leaves and token_tree brought up to date, and n_encoded.

    ``edits``: array<struct<start, end, text>> in code points of the old text, each putting text in place of [start,
    end); they may come in any order. Ends outside the text are moved to it, an edit that begins before an earlier one
    ends is left out, and a null array or replacement is an empty one. n_encoded: leaves that were encoded again. Rows
    without an edit stay as they are, and their texts stay in the JVM. A column named n_encoded is replaced, all others
    stay.
    """
    path = path or default_path("byte_bpe_50k.tiktoken")

    @F.pandas_udf("text string, leaves array<int>, tree array<long>, n_encoded int")
    def update(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        count = byte_counter(path)
        for columns in frames:
            rows = []
            for text, leaves, sums, a, b, new in zip(*columns):
                if a is None or not len(a):
                    rows.append((None, None, None, 0))
                else:
                    rows.append(recount(text or "", [int(x) for x in leaves], [int(x) for x in sums], list(zip(map(int, a), map(int, b), new)), count, leaf))
            yield pd.DataFrame(rows, columns=["text", "leaves", "tree", "n_encoded"])

    own = {"text": "text", "token_leaves": "leaves", "token_tree": "tree"}
    rows = carried(docs, [*own, "n_encoded"], edits=edits, **{c: F.col(c) for c in own})
    any_ = F.coalesce(F.size("edits") > 0, F.lit(False))
    changed = rows.withColumn("u", update(*[F.when(any_, F.col(c)) for c in own], *[F.col("edits")[x] for x in ("start", "end", "text")]))
    return changed.select("row.*", *[F.when(any_, F.col(f"u.{x}")).otherwise(F.col(c)).alias(c) for c, x in own.items()], "u.n_encoded")


def masking(text: Column) -> Column:
    """The edits of the registered query."""
    return F.transform(found(F.coalesce(text, F.lit("")), MASKED, 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(MASK).alias("text")))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # trees are kept in a table, as they would be from one edit of the corpus to the next
    stored = written(with_trees(docs.withColumn("edits", masking(F.col("text")))), "token-trees")
    total = lambda: F.get("token_tree", 1)
    before = stored.withColumns({"n_tokens": total(), "n_leaves": F.size("token_leaves"), "n_edits": F.size("edits")})
    return with_edits(before, F.col("edits")).select(
        "doc_id", "n_tokens", "n_leaves", "n_edits", F.col("n_encoded").alias("n_leaves_encoded"), total().alias("n_tokens_edited"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("edited_crc32"),
    )
