"""Events a least time apart, and counts since the last of them: in batch by composed blocks, as a stream by timers.

Which events of a key are chosen depends on the one chosen before. In batch a key's time is cut into blocks. A task
reduces a block to a map, from the time of the last event chosen before it to that of the last one chosen in it. The
maps of a key, a row a block, are applied one after the other, and then every block knows where it begins. So a key of very many events is
many tasks. In a stream a key's events wait in its state until the watermark has passed them, and are then taken in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import running_totals

#: The state of a key that nothing has been chosen of; microseconds of a block, at least.
NEVER, DAY = -(2**62), 86_400_000_000


def runs(frames: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The stretches of rows with equal ``keys`` of a sorted partition, each whole: their keys and ``columns``."""
    now, held = None, []
    whole = lambda: [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held)]
    for frame in frames:
        if not len(frame):
            continue
        own, rest = [frame[k].to_numpy() for k in keys], [frame[c].to_numpy() for c in columns]
        starts = np.flatnonzero(np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in own]))
        for a, b in zip(starts, np.append(starts[1:], len(frame))):
            key = tuple(c[a] for c in own)
            if key != now and held:
                yield now, whole()
                held = []
            now = key
            held.append([c[a:b] for c in rest])
    if held:
        yield now, whole()


def in_frames(rows: Iterator[dict[str, list]], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    """Lists of columns put together into frames of ``size`` rows or more, but for the last: a frame for each would cost more than its rows."""
    held: dict[str, list] = {c: [] for c in columns}
    for row in rows:
        for c in columns:
            held[c].extend(row[c])
        if len(held[columns[0]]) >= size:
            yield pd.DataFrame(held)
            held = {c: [] for c in columns}
    if held[columns[0]]:
        yield pd.DataFrame(held)


def walked(times: np.ndarray, least: int, gap: int) -> list[int]:
    """Places of the chosen ones of ascending ``times``: the first from ``least`` on, then always the first ``gap`` later or more."""
    out, i = [], int(np.searchsorted(times, least))
    while i < len(times):
        out.append(i)
        i = int(np.searchsorted(times, times[i] + gap))
    return out


def block_map(times: np.ndarray, begins: int, gap: int) -> list[dict[str, int]]:
    """The last time chosen in a block, by the least time that may be chosen: that of the first step whose ``upto`` isn't below it.

    A time before the block bars at most the block's first ``gap``, so only the times there, and one more, can be the
    first that is chosen; neighbours from which the same last one is reached are one step.
    """
    after = np.searchsorted(times, times + gap)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            last[i] = last[after[i]]
    firsts = min(len(times), int(np.searchsorted(times, begins + gap)) + 1)
    ends = np.flatnonzero(np.append(last[1:firsts] != last[: firsts - 1], True)) if firsts else []
    return [{"upto": int(times[i]), "last": int(times[last[i]])} for i in ends]


def chosen(df: DataFrame, key: str, time: str, tie: str, minutes: float, beyond: bool = False, since: DataFrame | None = None) -> DataFrame:
    """key, tie: of each key's events, by ``time`` and ``tie``, those that come ``minutes`` or more (``beyond``: more) after the last one chosen.

    The first event of a key is chosen, or the first that comes so long after ``since`` (key, start: microseconds, no later than
    any event of the key). Null keys and times take no part; repeated rows are events at the same time, of which one at most is chosen. ``tie`` is a long.
    """
    return timed(df, key, time, tie, minutes, beyond, since).select(F.col("k").alias(key), F.col("tie").alias(tie))


def timed(df: DataFrame, key: str, time: str, tie: str, minutes: float, beyond: bool = False, since: DataFrame | None = None) -> DataFrame:
    """k, t (microseconds), tie of what ``chosen`` chooses."""
    gap = int(minutes * 60_000_000) + beyond
    size = max(DAY, gap)
    kind = df.select(key).schema[0].dataType.simpleString()
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), micros.alias("t"), F.col(tie).cast("long").alias("tie"), F.lit(2).alias("side"))
    if since is not None:  # an event that none comes before: the first chosen, whichever block it lies in
        starts = since.select(F.col(key).alias("k"), F.col("start").cast("long").alias("t"), F.lit(0).cast("long").alias("tie"), F.lit(1).alias("side"))
        rows = rows.unionByName(starts.where(F.col("k").isNotNull() & F.col("t").isNotNull()))
    rows = rows.withColumn("block", F.expr(f"floor(t / {size})").cast("long"))
    order = ["k", "block", "t", "tie"]

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = ({"k": [k], "block": [block], "steps": [block_map(t, block * size, gap)]} for (k, block), (t,) in runs(frames, ["k", "block"], ["t"]))
        yield from in_frames(made, ["k", "block", "steps"], 1000)

    dealt = rows.repartition("k", "block").sortWithinPartitions(*order)
    made = dealt.select("k", "block", "t").mapInPandas(maps, f"k {kind}, block long, steps array<struct<upto:long,last:long>>")
    blocks = made.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "steps"))).alias("blocks"))
    state = lambda last, entries: F.struct(last.alias("last"), entries.alias("entries"))

    def step(s: Column, b: Column) -> Column:
        hit = F.get(F.filter(b["steps"], lambda x: x["upto"] >= s["last"] + gap), 0)
        return state(F.coalesce(hit["last"], s["last"]), F.concat(s["entries"], F.array(F.struct(b["block"].alias("block"), s["last"].alias("entry")))))

    entries = F.aggregate("blocks", state(F.lit(NEVER).cast("long"), F.array().cast("array<struct<block:long,entry:long>>")), step)["entries"]
    begun = blocks.select("k", F.inline(entries)).select("k", "block", F.col("entry").alias("t"), F.lit(0).cast("long").alias("tie"), F.lit(0).alias("side"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[dict[str, list]]:
            for (k, _), (t, ties, sides) in runs(frames, ["k", "block"], ["t", "tie", "side"]):
                at = [i + 1 for i in walked(t[1:], int(t[0]) + gap, gap) if sides[i + 1] == 2]
                yield {"k": [k] * len(at), "t": t[at].tolist(), "tie": ties[at].tolist()}

        yield from in_frames(found(), ["k", "t", "tie"])

    led = rows.unionByName(begun).repartition("k", "block").sortWithinPartitions("k", "block", "side", "t", "tie")
    return led.select("k", "block", "t", "tie", "side").mapInPandas(walk, f"k {kind}, t long, tie long")


def error_windows(df: DataFrame, key: str, time: str, tie: str, ok: str, minutes: float = 5) -> DataFrame:
    """key, tie, attempts, failures after each event: since the start of the window in which it falls.

    A window begins with a key's first event, and anew with the first success that comes more than ``minutes`` after it
    began; that success counts for neither. Repeated rows are events one after the other. ``tie`` is a long.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    since = df.groupBy(key).agg(F.min(micros).alias("start"))
    resets = timed(df.where(F.col(ok)), key, time, tie, minutes, beyond=True, since=since)
    told = df.select(F.col(key).alias("k"), micros.alias("t"), F.col(tie).cast("long").alias("tie"), (~F.col(ok)).cast("long").alias("failed"), F.date_trunc("hour", F.col(time)).alias("hour"))
    # a place of its own for every row of an hour, repeats too: all totals follow the same order
    told = told.withColumn("place", F.row_number().over(W.partitionBy("k", "hour").orderBy("t", "tie", "failed")))
    first = F.coalesce(F.lag(F.struct("t", "tie")).over(W.partitionBy("k", "hour").orderBy("place")) != F.struct("t", "tie"), F.lit(True))
    told = told.withColumn("first", first & (F.col("failed") == 0)).join(resets.withColumn("found", F.lit(True)), ["k", "t", "tie"], "left")
    told = told.withColumn("reset", (F.col("first") & F.coalesce("found", F.lit(False))).cast("long")).drop("first", "found")
    hour, order = F.col("hour"), ["place"]
    windows = running_totals(told.withColumn("tried", 1 - F.col("reset")), hour, order, "reset", "window", ["k"])
    tried = running_totals(windows, hour, order, "tried", "attempts", ["k", "window"])
    return running_totals(tried, hour, order, "failed", "failures", ["k", "window"]).select(F.col("k").alias(key), F.col("tie").alias(tie), "attempts", "failures")


class InOrder(StatefulProcessor):
    """A fold over a key's events in the order of their time, each taken when the watermark has passed it.

    ``step(state, event)`` gives the next state and a row or None; events are (microseconds, tie, ok). One that is delivered
    again before it was taken is taken once; one that comes after the watermark is left out.
    """

    def __init__(self, start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple | None]], state: str) -> None:
        self.start, self.step, self.schema = start, step, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.waiting = handle.getMapState("waiting", "t long, tie long", "ok boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for f in rows:
            for t, tie, ok in zip(f["t"], f["tie"], f["ok"]):
                if t >= mark * 1000:
                    self.waiting.updateValue((int(t), int(tie)), (bool(ok),))
                    self.handle.registerTimer(int(t) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((tuple(k), bool(v[0])) for k, v in self.waiting.iterator() if k[0] < mark)
        state, out = tuple(self.state.get() or self.start) if self.state.exists() else self.start, []
        for (t, tie), ok in due:
            state, made = self.step(state, (t, tie, ok))
            self.waiting.removeKey((t, tie))
            if made is not None:
                out.append((*key, *made))
        if due:
            self.state.update(state)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, time: str, tie: str, ok: Column, late: str, processor: InOrder, schema: str) -> DataFrame:
    processor.columns = [x.split()[0] for x in schema.split(", ")]
    seen = stream.withWatermark(time, late).select(F.col(key), F.col(time), F.unix_micros(F.col(time)).alias("t"), F.col(tie).cast("long").alias("tie"), ok.alias("ok"))
    return seen.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def cooled_stream(stream: DataFrame, key: str, time: str, tie: str, minutes: float, late: str = "1 hour") -> DataFrame:
    """key, tie: what ``chosen`` chooses, of events that aren't later than ``late``, as the watermark passes them."""
    gap = int(minutes * 60_000_000)

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple | None]:
        t, tie, _ = event
        return ((t,), (tie,)) if t >= state[0] + gap else (state, None)

    return folded(stream, key, time, tie, F.lit(True), late, InOrder((NEVER,), step, "last long"), f"{key} long, {tie} long")


def error_stream(stream: DataFrame, key: str, time: str, tie: str, ok: Column, minutes: float = 5, late: str = "1 hour") -> DataFrame:
    """key, tie, attempts, failures: what ``error_windows`` says, as the watermark passes the events."""
    gap = int(minutes * 60_000_000)

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
        (start, attempts, failures), (t, tie, good) = state, event
        start = t if start == NEVER else start
        attempts, failures = attempts + 1, failures + (not good)
        if good and t - start > gap:
            start, attempts, failures = t, 0, 0
        return (start, attempts, failures), (tie, attempts, failures)

    return folded(stream, key, time, tie, ok, late, InOrder((NEVER, 0, 0), step, "start long, attempts long, failures long"), f"{key} long, {tie} long, attempts long, failures long")
