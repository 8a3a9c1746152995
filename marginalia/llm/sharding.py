"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard depends on its key and on the number of shards alone, so no ring or table is kept, and a further shard
takes its fair share of rows from all others while no row moves between old shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, gapless_rank, let, named

#: Fixed values of the published algorithm: the multiplier of its generator, and the powers of two that it divides by.
MULTIPLIER = 2862933555777941757
TWO_31, TWO_33, TWO_64 = 2**31, 2**33, 2**64

SHARDS = 24


def _whole(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def jump_key(column: Column, dtype: str) -> Column:
    """The unsigned 64-bit key of a row: integers are their own key, other types a hash of theirs; null is key 0."""
    signed = column.cast("long") if dtype in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(column.cast("string"))
    wide = F.coalesce(F.when(column.isNotNull(), signed), F.lit(0).cast("long")).cast("decimal(20,0)")
    return F.when(wide < 0, wide + _whole(TWO_64)).otherwise(wide).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the bucket of an unsigned 64-bit ``key`` among ``shards`` and among ``shards + 1``.

    The jumps of a key form one rising sequence whatever the number of shards; a key's bucket among n is its last jump
    below n. A jump moves at least by one, so ``shards + 1`` steps always suffice.
    """
    start = F.struct(
        key.cast("decimal(20,0)").alias("key"), F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown")
    )

    def step(s: Column, _: Column) -> Column:
        key = ((s["key"].cast("decimal(38,0)") * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + _whole(1)) % _whole(TWO_64)).cast("decimal(20,0)")
        high = F.floor(key.cast("decimal(38,0)") / F.lit(str(TWO_33)).cast("decimal(11,0)")).cast("double")
        leap = F.floor((s["next"] + 1).cast("double") * (F.lit(float(TWO_31)) / (high + 1.0))).cast("long")
        moved = F.struct(
            key.alias("key"), leap.alias("next"), F.when(s["next"] < shards, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown")
        )
        return F.when(s["next"] <= shards, moved).otherwise(s)

    return let(
        F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step),
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown_shard")),
    )


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with shard, slot (gapless from 0 within the shard) and grown_shard (the shard if there were one more).

    Rows with equal keys share a shard, and all rows with a null key. ``order`` names columns that tell apart rows of
    one key; rows alike in those too get neighbouring slots. Columns of these names, in any case, are replaced, all others
    stay. An empty table gives an empty one.
    """
    dtype = dict(df.dtypes)[key]
    names = [f"order_{i}" for i in range(1 + len(order))]
    keyed = carried(df, ["shard", "slot", "grown_shard"], jumped=jump(jump_key(named(key), dtype), shards), **{x: named(c) for x, c in zip(names, [key, *order])})
    placed = keyed.select("row", *names, "jumped.*")
    return gapless_rank(placed, ["shard"], names, "slot").select("row.*", "shard", "grown_shard", "slot")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard(docs, "doc_id", SHARDS, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
