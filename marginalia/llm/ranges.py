"""Global numbers of rows by ranges: no task holds more than its range, and no window spans a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, written

#: ``monotonically_increasing_id`` of a row is its partition times this, plus its place there.
PER_PARTITION = 1 << 33


def in_ranges(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` as a written table, dealt by ranges of ``order`` and sorted, with ``range_part`` and ``range_at`` (from 0)."""
    nr, part, at = fresh(df, "range_nr"), "range_part", "range_at"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(nr, F.monotonically_increasing_id())
    return written(dealt.withColumns({part: F.expr(f"{nr} div {PER_PARTITION}"), at: F.col(nr) % PER_PARTITION}).drop(nr), name)


def ranked(df: DataFrame, order: Sequence[Column | str], rank: str, name: str = "ranks") -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3, ... by ``order``, which has no ties. Only one row for each range is summed up."""
    table = in_ranges(df, order, name)
    sizes = table.groupBy("range_part").agg(F.count(F.lit(1)).alias("range_rows"))
    before = F.coalesce(F.sum("range_rows").over(W.orderBy("range_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    firsts = written(sizes.select("range_part", before.alias("range_before")), "ranges")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    return table.join(firsts, "range_part").withColumn(rank, F.col("range_before") + F.col("range_at") + 1).drop("range_part", "range_at", "range_before")
