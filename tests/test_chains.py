"""Chosen events and windows that reset: composed blocks and streams against a walk over each key's events."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.streaming import chains as C
from marginalia.streaming import feeds

T0 = datetime(2024, 1, 1)


def cooled(rows, minutes):
    out, last = [], {}
    for key, t, tie, _ in sorted(rows, key=lambda r: r[:3]):
        if key not in last or t - last[key] >= timedelta(minutes=minutes):
            last[key] = t
            out.append((key, tie))
    return sorted(out)


def counted(rows, minutes=5):
    out, state = [], {}
    for key, t, tie, ok in sorted(rows, key=lambda r: r[:3]):
        start, n, bad = state.get(key, (t, 0, 0))
        n, bad = n + 1, bad + (not ok)
        if ok and t - start > timedelta(minutes=minutes):
            start, n, bad = t, 0, 0
        state[key] = (start, n, bad)
        out.append((key, tie, n, bad))
    return sorted(out)


def made(seed, n=600, days=5):
    rng = random.Random(seed)
    at = [T0 + timedelta(seconds=rng.choice([rng.randrange(days * 86400), rng.randrange(7200)])) for _ in range(n)]
    return [(rng.choice([1, 1, 1, 2, 3]), t, i, rng.random() < 0.6) for i, t in enumerate(at)]


def table(spark, rows):
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize(("seed", "minutes"), [(1, 30), (2, 7.5), (3, 2000)])
def test_blocks_compose(spark, seed, minutes):
    rows = made(seed) + [(None, T0, 9001, True), (4, None, 9002, True)]
    df = table(spark, rows)
    whole = [r for r in rows if r[0] is not None and r[1] is not None]
    assert sorted(map(tuple, C.chosen(df, "user_id", "ts", "event_id", minutes).collect())) == cooled(whole, minutes)
    assert C.chosen(df.limit(0), "user_id", "ts", "event_id", minutes).count() == 0


def test_windows_of_repeated_rows_and_ids(spark):
    rows = [r for r in made(7, 60, 1) for _ in range(3)] + [(key, t + timedelta(hours=30), tie, ok) for key, t, tie, ok in made(7, 60, 1)]
    assert sorted(map(tuple, C.error_windows(table(spark, rows), "user_id", "ts", "event_id", "ok").collect())) == counted(rows)


def test_equal_times_and_repeats(spark):
    rows = [(1, T0, 5, True), (1, T0, 4, True), (1, T0 + timedelta(minutes=30), 6, True), (1, T0 + timedelta(minutes=30), 6, True), (1, T0 + timedelta(hours=24), 7, True)]
    assert sorted(map(tuple, C.chosen(table(spark, rows), "user_id", "ts", "event_id", 30).collect())) == [(1, 4), (1, 6), (1, 7)]


def test_windows_reset_on_a_success_alone(spark):
    rows = made(4)
    assert sorted(map(tuple, C.error_windows(table(spark, rows), "user_id", "ts", "event_id", "ok").collect())) == counted(rows)


def test_windows_over_the_midnight_after_the_first_event(spark):
    """What the first day of a key chose holds on the next one, whether its first event is an error or not."""
    first = [(key, T0 + timedelta(hours=10), 10 * key, key == 2) for key in (1, 2)]
    rest = [(key, T0 + timedelta(hours=hours), 10 * key + i, True) for key in (1, 2) for i, hours in enumerate((10.05, 23.95, 24.01, 24.02), 1)]
    rng = random.Random(11)
    dense = [(key, T0 + timedelta(seconds=rng.randrange(2 * 86400)), i, rng.random() < 0.7) for i, key in enumerate(rng.choices(range(3, 23), k=6000))]
    for rows in (first + rest, dense):
        assert sorted(map(tuple, C.error_windows(table(spark, rows), "user_id", "ts", "event_id", "ok").collect())) == counted(rows)


def test_a_hot_key_is_many_tasks(spark):
    rows = [(1, T0 + timedelta(minutes=7 * i), i, True) for i in range(3000)]
    df = table(spark, rows)
    assert sorted(map(tuple, C.chosen(df, "user_id", "ts", "event_id", 30).collect())) == cooled(rows, 30)
    blocks = df.select(F.expr(f"floor(unix_micros(ts) / {C.DAY})").alias("b")).distinct().count()
    assert blocks == 15  # the units that the key's rows are dealt by


@pytest.mark.parametrize("seed", range(20))
def test_a_block_is_its_map(seed):
    rng = random.Random(seed)
    times, gap = np.array(sorted(rng.randrange(1000, 2000) for _ in range(rng.randint(1, 40)))), rng.choice([1, 30, 200, 999])
    steps = C.block_map(times, 1000, gap)
    for least in range(0, 1000 + gap + 1):
        way = C.walked(times, least, gap)
        hit = next((s["last"] for s in steps if s["upto"] >= least), None)
        assert hit == (int(times[way[-1]]) if way else None) or least > 1000 + gap


def test_streams_equal_batch(spark, tmp_path):
    """Files land out of order within the watermark's delay, one twice, and one row far too late."""
    rows = sorted(made(5, 300, 2), key=lambda r: r[1])
    lots = [rows[i : i + 60] for i in range(0, 300, 60)]
    for a, b in zip(lots, lots[1:]):
        a[-5:], b[:5] = b[:5], a[-5:]
    done = [(9, T0 + timedelta(days=400), 10_000, True)]
    late = [(1, T0, 10_001, True)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate([*lots, lots[2][:0], done, late, [(9, T0 + timedelta(days=401), 10_002, True)]]):
            table(spark, [*part, *part[:3]] if i < 5 else part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = "user_id long, ts timestamp, event_id long, ok boolean"
        for name, make, want in (
            ("cooled", lambda s: C.cooled_stream(s, "user_id", "ts", "event_id", 30, "10 days"), cooled(rows, 30)),
            ("errors", lambda s: C.error_stream(s, "user_id", "ts", "event_id", F.col("ok"), 5, "10 days"), counted(rows)),
        ):
            out = []
            feed = feeds.changes(spark, str(tmp_path / "in"), schema, 1)
            feeds.run(make(feed), lambda df, n: out.extend(map(tuple, df.collect())), str(tmp_path / name)).awaitTermination()
            assert sorted(r for r in out if r[0] != 9) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
