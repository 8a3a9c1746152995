"""Queries of change: the events table as a feed of changes, by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..sources.items import greatest, newest
from .registry import registry

Q, SQL, query = registry()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))



def _newest() -> list:
    return [newest("ts"), greatest("event_id")]


@query(
    "upsert_K2",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    return C.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", *_newest()).select("user_id", "event_id", "event_type")


@query(
    "insert_if_absent_K4",
    """WITH old AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup'), fresh AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
    SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE user_id NOT IN (SELECT user_id FROM old)""",
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return C.insert_missing(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id").select("user_id", "event_id")


@query("delete_K7", "SELECT event_id FROM events WHERE NOT coalesce(event_type = 'error' AND value > 50, false) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value < 1)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kept = C.delete_where(e, (F.col("event_type") == "error") & (F.col("value") > 50))
    return C.delete_keys(kept, e.where("event_type = 'signup' AND value < 1"), "user_id").select("event_id")


@query(
    "latest_feed_O10",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def latest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest_feed(events(spark, sf_dir), "user_id", 50, *_newest()).select("user_id", "event_id")


@query(
    "feed_stats_T5",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM events)
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE is_first) AS inserts, count(*) FILTER (WHERE NOT is_first) AS updates, count(*) FILTER (WHERE event_type = 'error') AS errors FROM f GROUP BY 1""",
)
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first event is an insert, the others are updates. Firsts are a least value, so no task holds a user's events."""
    e, day = events(spark, sf_dir), lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    days = e.groupBy(day("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    firsts = e.groupBy("user_id").agg(F.min("ts").alias("ts")).groupBy(day("ts")).agg(F.count(F.lit(1)).alias("inserts"))
    inserts = F.coalesce("inserts", F.lit(0).cast("long"))
    return days.join(firsts, "day", "left").select("day", inserts.alias("inserts"), (F.col("n") - inserts).alias("updates"), "errors")


@query(
    "sessions_X1",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, n""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("w.start").alias("started"), "events")


@query(
    "sliding_X2",
    """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS started, value FROM events, range(2) t(k))
    SELECT started, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY started""",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return s.select(F.col("w.start").alias("started"), "events", "total")


@query(
    "changed_fields_F40",
    """SELECT a.event_id, concat_ws('|', CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'event_type' END, CASE WHEN a.user_id IS DISTINCT FROM b.user_id THEN 'user_id' END) AS changed
    FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type IS DISTINCT FROM b.event_type OR a.user_id IS DISTINCT FROM b.user_id""",
)
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "event_type", "user_id")
    found = C.changed_fields(e, e.withColumn("event_id", F.col("event_id") - 1), "event_id", ["event_type", "user_id"])
    return found.select("event_id", F.array_join("changed", "|").alias("changed"))


@query(
    "alert_cooldown_T11",
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    walk AS (SELECT user_id, n, ts AS last_sent, event_id, true AS sent FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ts >= w.last_sent + INTERVAL 30 MINUTE THEN e.ts ELSE w.last_sent END, e.event_id, e.ts >= w.last_sent + INTERVAL 30 MINUTE FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT user_id, event_id FROM walk WHERE sent""",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.chains import chosen

    return chosen(events(spark, sf_dir).where("event_type = 'error'"), "user_id", "ts", "event_id", 30)


@query(
    "error_rate_T10",
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (SELECT user_id, n, event_id, ts AS since, 1::BIGINT AS attempts, (NOT ok)::BIGINT AS failures FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN ok AND ts - since > INTERVAL 5 MINUTE THEN ts ELSE since END,
            CASE WHEN ok AND ts - since > INTERVAL 5 MINUTE THEN 0 ELSE attempts + 1 END, CASE WHEN ok AND ts - since > INTERVAL 5 MINUTE THEN 0 ELSE failures + (NOT ok)::BIGINT END
            FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT user_id, event_id, attempts, failures FROM walk""",
)
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.chains import error_windows

    return error_windows(events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error"), "user_id", "ts", "event_id", "ok")


_ORDERED = "e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    "breaker_T8",
    f"""WITH RECURSIVE {_ORDERED},
    walk AS (
        SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS bad, 0 AS good, NULL::TIMESTAMP AS since FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, n, event_id,
            CASE WHEN was = 'closed' AND NOT ok AND bad + 1 >= 3 THEN 'open' WHEN was = 'half-open' AND NOT ok THEN 'open' WHEN was = 'half-open' AND good + 1 >= 2 THEN 'closed' ELSE was END,
            CASE WHEN was = 'closed' THEN CASE WHEN ok THEN 0 ELSE bad + 1 END WHEN was = 'half-open' AND ok AND good + 1 >= 2 THEN 0 ELSE bad END,
            CASE WHEN was = 'half-open' THEN CASE WHEN ok THEN good + 1 ELSE 0 END ELSE good END,
            CASE WHEN was = 'closed' AND NOT ok AND bad + 1 >= 3 OR was = 'half-open' AND NOT ok THEN ts ELSE since END
        FROM (SELECT e.user_id, e.n, e.event_id, e.ts, e.ok, w.bad, w.since, CASE WHEN w.state = 'open' AND e.ts >= w.since + INTERVAL 60 MINUTE THEN 'half-open' ELSE w.state END AS was,
            CASE WHEN w.state = 'open' AND e.ts >= w.since + INTERVAL 60 MINUTE THEN 0 ELSE w.good END AS good FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT user_id, event_id, state FROM walk WHERE n > 0""",
)
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.states import breaker_states

    e = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return breaker_states(e, "user_id", "ts", "event_id")


@query(
    "rate_level_T9",
    f"""WITH RECURSIVE {_ORDERED},
    walk AS (
        SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS level, 0 AS bad, 0 AS good FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.n, e.event_id,
            CASE WHEN ok AND good + 1 >= 10 THEN greatest(0, level - 1) WHEN NOT ok AND bad + 1 >= 3 THEN least(5, level + 1) ELSE level END,
            CASE WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN ok AND good + 1 < 10 THEN good + 1 ELSE 0 END
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT user_id, event_id, level FROM walk WHERE n > 0""",
)
def rate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.states import limiter_levels

    e = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return limiter_levels(e, "user_id", "ts", "event_id")
