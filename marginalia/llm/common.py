"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Sub-groups that a key is dealt into before its rows are numbered.
RANK_BUCKETS = 1024

#: Rows of a table, of a few numbers and names each, that may be broadcast; they are counted first.
BROADCAST_ROWS = 50_000

#: A key with more than HOT_ROWS rows and more than 1/HEAVY of all rows is hot; so there are at most HEAVY of them.
HEAVY, HOT_ROWS = 1000, 1000

#: Bits of a sieve, at least and at most: 4 to 64 MB. A table of more than MOST_SIEVED rows gets none.
SIEVE_BITS, MOST_SIEVE_BITS = 1 << 25, 1 << 29
MOST_SIEVED = MOST_SIEVE_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def carried(df: DataFrame, replaced: Sequence[str] = (), **work: Column) -> DataFrame:
    """``row``, a struct of the columns of ``df`` but ``replaced`` ones, beside the ``work`` columns.

    While a caller's columns travel inside ``row``, no name that an operator adds can clash with theirs. As for Spark
    itself, names that differ in case alone are one name: columns whose names match ``replaced`` so are left out.
    Expressions with lambdas belong in a select of their own before the one that unpacks ``row.*``: inside a lambda, Spark
    would take the unpacked columns for aliases of that select.
    """
    gone = {x.lower() for x in replaced}
    kept = [named(c) for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*kept).alias("row") if kept else F.lit(None).cast("struct<>").alias("row"), *[c.alias(x) for x, c in work.items()])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A local one stands in on a local master alone."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "marginalia-checkpoints")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Drops the rows of ``written`` tables that nothing reads any more: an empty table takes each one's place."""
    for table in tables:
        path = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None
        if path:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs that run inside; afterwards the session has its own again."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def hot_from(total: int) -> int:
    """A key with more rows than this, of ``total`` ones, is hot."""
    return max(total // HEAVY, HOT_ROWS)


def joined_evenly(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str) -> DataFrame:
    """The inner join of ``left`` with ``right``, a written table of one row a key, without a task for a hot key.

    ``rows``: a column of ``right`` with the number of rows that ``left`` has of the key; the result lacks it. Hot keys
    are broadcast, and their rows stay where they are; all others are shuffled. ``on`` hold no nulls.
    """
    on = list(on)
    total, most = right.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    if most <= hot_from(total):
        return left.join(right.drop(rows), on)
    heavy = F.col(rows) > hot_from(total)
    hot, rest = right.where(heavy).drop(rows), right.where(~heavy).drop(rows)
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def sieve_bits(rows: int) -> int:
    """Bits for a sieve of ``rows`` keys: eight or more a key, so that it holds an eighth of the others or fewer; 0 for too many keys."""
    bits = SIEVE_BITS
    while bits < 8 * rows and bits < MOST_SIEVE_BITS:
        bits *= 2
    return bits if rows <= MOST_SIEVED else 0


def sifted(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``held``: false for rows whose ``key`` is surely not among ``keys``, a written table of one long column.

    A row whose key is there is always held; others are held by chance only, the more often the fuller the sieve that is
    made of the hashes of ``keys`` and broadcast. Its size follows their counted number, up to a bound, beyond which all
    rows are held. So it saves shuffles and decides nothing: an exact join has to follow for the rows that it holds.
    """
    bits = sieve_bits(keys.count())
    if not bits:
        return df.withColumn("held", F.lit(True))
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    placed = keys.select(slot_of(keys.columns[0]).alias("slot"))
    table = placed.groupBy(F.bitmap_bucket_number("slot").alias("sieve_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("sieve_bits"))
    slot = slot_of(key)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("sieve_bits"), F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    joined = df.join(F.broadcast(table), F.bitmap_bucket_number(slot) == F.col("sieve_part"), "left")
    return joined.withColumn("held", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("sieve_part", "sieve_bits")


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each ``keys`` group, without a task that holds a whole group.

    The rows of a key are dealt into ``buckets`` by a hash of ``order``; the sizes of the buckets, one small array a
    key, give each bucket's first number, and rows are numbered within their bucket by ``order``. Rows that agree in
    all of ``order`` get neighbouring numbers in any order. ``keys`` hold no nulls.
    """
    b, n, first, sizes = (fresh(df, x) for x in ("rank_bucket", "rank_rows", "rank_first", "rank_sizes"))
    keyed = df.withColumn(b, (F.conv(F.substring(F.md5(F.concat_ws("|", *order)), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counted = keyed.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    per_key = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(b, n))).alias(sizes))
    running = let(
        F.aggregate(
            sizes,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
            lambda acc, x: F.struct((acc["at"] + x[n]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        )["all"],
        lambda at: F.zip_with(sizes, at, lambda x, y: F.struct(x[b].alias(b), y.alias(first))),
    )
    twin = {k: fresh(keyed, f"{k}_twin") for k in [*keys, b]}
    firsts = per_key.select(*[F.col(k).alias(twin[k]) for k in keys], F.inline(running)).withColumnRenamed(b, twin[b])
    on = reduce(and_, [F.col(k) == F.col(twin[k]) for k in [*keys, b]])
    joined = keyed.join(firsts, on, "left").drop(*twin.values())
    within = F.row_number().over(W.partitionBy(*keys, b).orderBy(*order))
    return joined.withColumn(name, F.col(first) + within - 1).drop(b, first)

