"""A manifest of a dataset as a Merkle tree, with persistent versions made by path copying.

Rows are leaves; each group (a language) has its own tree, and the groups' roots are the leaves of the last one. A tree is
cut into aligned blocks of FANOUT ** DEPTH leaves. Each block is built by one task, which knows its leaves alone; the roots
of blocks are the leaves of the next round of blocks, until one is left. What lies above a block, the siblings on its
way to the root, then comes down to its task. A changed leaf makes a version of the tree: its ancestors are copied, first
within the block and then along the siblings above it, and every other node is shared with the original.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, named, written

#: Children of a node, and levels of a block.
FANOUT, DEPTH = 8, 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """Bytes, a colon and the value; a hyphen for null: no two rows of values run together to the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The nodes of a block, level by level, and versions of it that share them."""

    def __init__(self, leaves: list[str], levels: int) -> None:
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
        self.root = self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """The other nodes of each run on the way up from leaf ``i``, those before and those after it."""
        out = []
        for nodes in self.levels[:-1]:
            start = i - i % FANOUT
            out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + FANOUT])))
            i //= FANOUT
        return out


def copied(leaf: str, siblings: Sequence[tuple[str, str]]) -> list[str]:
    """The nodes that a version with this leaf has of its own: the leaf, and a copy of each ancestor up to the root."""
    path = [leaf]
    for left, right in siblings:
        path.append(digest(left, path[-1], right))
    return path


def levels_of(n: int, most: int) -> int:
    """Levels above ``n`` leaves of one tree, as far as a block reaches."""
    out = 0
    while n > 1 and out < most:
        n, out = -(-n // FANOUT), out + 1
    return out


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (tree, n and others) in the order of (tree, ord, leaf) with ``first``, the place of a row's first leaf in its tree, and ``held``, the tree's leaves.

    A row stands for ``n`` equal leaves. Rows are dealt by ranges; only sums of each range and tree meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            first = []
            for tree, n in zip(batch.column("tree").to_pylist(), batch.column("n").to_pylist()):
                if tree != last:
                    last, total = tree, 0
                first.append(total)
                total += n
            more = [pa.array([part] * len(first), pa.int32()), pa.array(first, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "in_part"])

    order = ["tree", "ord", "leaf"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = rows.schema
    table = written(dealt.mapInArrow(run, type(schema)(list(schema)).add("part", "integer").add("in_part", "long")), name)
    sums = table.groupBy("tree", "part").agg(F.sum("n").alias("n"))
    trees = W.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(trees.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = written(sums.select("tree", "part", before.alias("before"), F.sum("n").over(trees).alias("held")), "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return table.join(starts, ["tree", "part"]).withColumn("first", F.col("before") + F.col("in_part")).drop("part", "in_part", "before")


def in_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (tree, first, n and others) by block, with lo and hi: which places of the block they take."""
    size = FANOUT**depth
    cut = nodes.withColumn("block", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"(first + n - 1) div {size}"))))
    return cut.withColumns({
        "lo": F.greatest(F.col("first") - F.col("block") * size, F.lit(0)).cast("int"),
        "hi": F.least(F.col("first") + F.col("n") - F.col("block") * size, F.lit(size)).cast("int"),
    }).drop("first", "n")


def block_wise(rows: DataFrame, each, out: Sequence[str], schema: str) -> DataFrame:
    """``each(key, rows of the block)`` for each (tree, block): blocks stream past, one is held at a time.

    ``rows`` have tree, block, lo and others; ``each`` yields tuples of ``out``.
    """
    types = [f.dataType for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]

        def batch_of(results: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in results], t) for i, t in enumerate(arrow)], list(out))

        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["block"]) != key:
                    if held and (results := list(each(held))):
                        yield batch_of(results)
                    key, held = (row["tree"], row["block"]), []
                held.append(row)
        if held and (results := list(each(held))):
            yield batch_of(results)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("lo").asc_nulls_first()).mapInArrow(run, schema)


def block_of(rows: list[dict], depth: int) -> Block:
    """The block whose rows (leaf, lo, hi, held: leaves of the tree) are given in order."""
    return Block([r["leaf"] for r in rows for _ in range(r["hi"] - r["lo"])], levels_of(rows[0]["held"], depth))


def risen(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a forest above ``nodes`` (tree, leaf, first, n, held), and tree, root of each tree.

    A round is a written table (tree, block, place, path): the siblings, within the next round's block, of each root of a
    block of the round before.
    """

    def roots(rows: list[dict]):
        yield rows[0]["tree"], rows[0]["block"], block_of(rows, depth).root, -(-rows[0]["held"] // FANOUT**depth)

    def paths(rows: list[dict]):
        block = block_of(rows, depth)
        for r in rows:
            yield r["tree"], r["block"], r["place"], [{"left": a, "right": b} for a, b in block.siblings(r["lo"])]

    rounds, names = [], ["tree", "block", "leaf", "held"]
    here = written(block_wise(in_blocks(nodes.select("tree", "leaf", "first", "n", "held"), depth), roots, names, "tree string, block long, leaf string, held long"), "nodes")
    while here.agg(F.coalesce(F.max("held"), F.lit(0))).first()[0] > 1:
        above = in_blocks(here.select("tree", "leaf", F.col("block").alias("first"), F.lit(1).alias("n"), "held", F.col("block").alias("place")), depth)
        rounds.append(written(block_wise(above, paths, ["tree", "block", "place", "path"], f"tree string, block long, place long, path {_PATH}"), "paths"))
        here = written(block_wise(above, roots, names, "tree string, block long, leaf string, held long"), "nodes")
    return rounds, here.select("tree", F.col("leaf").alias("root"))


def led_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, block, path (and the other columns of ``tops``: tree, path, ...): siblings from each block of leaves up to the last root."""
    rest = [c for c in tops.columns if c not in ("tree", "path")]
    down = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", *rest)
    for table in reversed(rounds):
        upper = down.select("tree", "block", F.col("path").alias("upper"), *rest)
        down = table.join(upper, ["tree", "block"]).select("tree", F.col("place").alias("block"), F.concat("path", "upper").alias("path"), *rest)
    return down


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None,
    when: Column | None = None, with_versions: bool = False, depth: int = DEPTH,
) -> DataFrame:
    """A row for each row of ``docs``: its key and group, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of ``fields``; within a group they ascend by ``key`` (nulls first), then by digest. ``changed``:
    columns as they are after tampering; ``when``: which rows are tampered with (null: not). folded_root is the root of
    the version with the changed leaf, by the original's siblings. proof_sha256: digest of all siblings, from the leaf's to
    the groups' roots. ``with_versions``: also version, the nodes that a changed leaf's version doesn't share (its leaf and
    the copied ancestors), an empty list for other rows. ``depth``: levels of a block. A null group is one of its own and the first; a null or empty
    text is a value; equal rows are leaves of their own, whose places are given in any order; however many there are, they are
    dealt to tasks by blocks. Columns other than ``fields``, ``group`` and ``key`` are ignored, whatever their names. An empty table gives no rows.
    """
    at = {c: named(c) for c in fields}
    leaf = leaf_digest(list(at.values()))
    hit = F.coalesce(F.lit(False) if when is None else when, F.lit(False))
    after = F.when(hit, leaf_digest([(changed or {}).get(c, x) for c, x in at.items()]))
    tree = F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit(""))  # the order of bytes, null first
    read = docs.select(tree.alias("tree"), named(key).alias("ord"), leaf.alias("leaf"), after.alias("changed"))
    # equal rows travel as one with their number
    rows = numbered(read.groupBy("tree", "ord", "leaf", "changed").agg(F.count(F.lit(1)).alias("n")), "leaves")
    rounds, roots = risen(rows, depth)
    roots = written(roots, "subroots")
    # the groups' roots are the leaves of the last tree
    upper = written(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), F.col("root").alias("leaf"), F.lit(1).cast("long").alias("n")), "groups"), "upper")
    upper_rounds, top = risen(upper, depth)

    def up(held: list[dict]):
        block = block_of(held[1:], depth)
        for r in held[1:]:
            yield r["ord"], r["leaf"], held[0]["root"], [{"left": a, "right": b} for a, b in block.siblings(r["lo"])] + held[0]["path"]

    def beside(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows of blocks, each block led by what stands above it."""
        return in_blocks(nodes, depth).unionByName(blocks, allowMissingColumns=True)

    above = led_down(upper_rounds, top.withColumn("path", F.array().cast(_PATH)))
    schema = f"tree string, subroot string, root string, path {_PATH}"
    tops = written(block_wise(beside(upper, above), up, ["tree", "subroot", "root", "path"], schema), "tops")

    def down(held: list[dict]):
        head, block = held[0], block_of(held[1:], depth)
        for r in held[1:]:
            for i in range(r["lo"], r["hi"]):
                way = block.siblings(i) + [(x["left"], x["right"]) for x in head["path"]]
                path = copied(r["changed"] or r["leaf"], way)
                out = (r["ord"], r["tree"], r["leaf"], head["subroot"], head["root"], digest(*[x for pair in way for x in pair]), path[-1])
                yield (*out, path if r["changed"] else []) if with_versions else out

    names = ["ord", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["version"] * with_versions
    kind = docs.select(named(key)).schema[0].dataType.simpleString()
    schema = f"ord {kind}, " + ", ".join(f"{c} string" for c in names[1:7]) + ", version array<string>" * with_versions
    done = block_wise(beside(rows, led_down(rounds, tops)), down, names, schema)
    return done.select(
        F.col("ord").alias(key), F.expr("if(tree = '', null, substring(tree, 2))").alias(group), *names[2:], (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = manifest(
        docs, changed={"text": F.translate("text", letters, letters.lower())}, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    )
    return tampered.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
