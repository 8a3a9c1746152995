"""Totals and states that follow an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_totals(df: DataFrame, block: Column, order: list[str], value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the running total of ``value`` over all rows (of each ``within``), without one task for all of them.

    ``block``: a column that rises with ``order`` (an hour, say). Rows are totalled within their block, and the sums of
    the blocks before, one row a block, are added. ``within`` hold no nulls.
    """
    rows = df.withColumn("__block", block)
    sums = rows.groupBy(*within, "__block").agg(F.sum(value).alias("__sum"))
    blocks = W.partitionBy(*within).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(blocks), F.lit(0)))
    own = F.sum(value).over(W.partitionBy(*within, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(before.drop("__sum"), [*within, "__block"]).withColumn(name, F.col("__before") + own).drop("__block", "__before")
