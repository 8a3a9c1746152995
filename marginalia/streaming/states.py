"""State machines over ordered events of a key, in batch and as a stream.

A key's events are folded in the order of their time; keys are dealt over tasks, and a key's fold holds its state
alone, not its events, beyond the batch that the task reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict | None]]) -> DataFrame:
    """The rows that ``step(state, row)`` gives back over each key's rows by ``order``.

    Rows of a key are brought together and sorted on disk by Spark, then read as a stream of batches in which keys
    follow one another, so that a key of very many rows needs no more memory than one of few.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    cols = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                row = dict(zip(cols, row))
                if row[key] != last:
                    last, state = row[key], start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def breaker_states(df: DataFrame, key: str, time: str, tie: str, failures: int = 3, successes: int = 2, minutes: int = 60) -> DataFrame:
    """key, event and state after it: closed, open after ``failures`` failures in a row, half-open ``minutes`` later,
    closed again after ``successes`` successes. Events that meet an open breaker don't count."""
    wait = pd.Timedelta(minutes=minutes)

    def step(s, row):
        state, bad, good, since = s
        if state == "open" and row[time] >= since + wait:
            state, good = "half-open", 0
        if state == "closed":
            bad = 0 if row["ok"] else bad + 1
            if bad >= failures:
                state, since = "open", row[time]
        elif state == "half-open":
            good = good + 1 if row["ok"] else 0
            if not row["ok"]:
                state, since = "open", row[time]
            elif good >= successes:
                state, bad = "closed", 0
        return (state, bad, good, since), {key: row[key], tie: row[tie], "state": state}

    return folded(df.select(key, time, tie, "ok"), key, [time, tie], f"{key} long, {tie} long, state string", lambda: ("closed", 0, 0, None), step)


def limiter_levels(df: DataFrame, key: str, time: str, tie: str, levels: int = 6, refused: int = 3, calm: int = 10) -> DataFrame:
    """key, event and level after it: one up at each refusal from the third in a row on, one down for ten successes."""

    def step(s, row):
        level, bad, good = s
        if row["ok"]:
            bad, good = 0, good + 1
            if good >= calm:
                level, good = max(0, level - 1), 0
        else:
            bad, good = bad + 1, 0
            if bad >= refused:
                level = min(levels - 1, level + 1)
        return (level, bad, good), {key: row[key], tie: row[tie], "level": level}

    return folded(df.select(key, time, tie, "ok"), key, [time, tie], f"{key} long, {tie} long, level int", lambda: (0, 0, 0), step)
