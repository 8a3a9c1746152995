"""Structured Streaming: the change feed, its counters and running costs, from files as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import upsert
from ..sources.items import greatest, newest

#: Parts that keys are dealt into; a batch rewrites those it touches.
PARTS = 64

COST_SCHEMA = "message string, timestamp timestamp, modelId string, taskType string, source string, cost double, promptTokens long, completionTokens long, totalTokens long"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def changes(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 16) -> DataFrame:
    """A stream of the Parquet files that land in ``path``, ``files`` a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counters(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and errors of each window of event time; rows later than ``late`` are left out."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("started"), "events", "errors", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    s = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("w.start").alias("started"), "events")


def once_each(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def snapshot(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows that ``materialised`` keeps in ``target``: of each part its last version (below ``before``); None without any."""
    try:
        found = spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing has been written yet
    found = found if before is None else found.where(F.col("version") < before)
    last = found.groupBy("part").agg(F.max("version").alias("version"))  # a row for each of PARTS parts at most
    return found.join(F.broadcast(last), ["part", "version"]).drop("version")


def materialised(stream: DataFrame, target: str, checkpoint: str, key: str = "user_id", parts: int = PARTS) -> StreamingQuery:
    """The latest row of each key. Keys are dealt into ``parts``; a batch writes the parts that it touches, and only these,
    to ``target``/version=N, and a batch that runs again writes the same. ``snapshot`` reads the last version of each."""

    def merge(batch: DataFrame, n: int) -> None:
        new = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        old = snapshot(batch.sparkSession, target, n)
        if old is not None:
            touched = F.broadcast(new.select("part").distinct())
            new = new.unionByName(old.join(touched, "part", "left_semi").select(*new.columns))
        merged = upsert(new, new.limit(0), key, newest("ts"), greatest("event_id"))
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{target}/version={n}")

    return run(stream, merge, checkpoint)


def by_operation(stream: DataFrame, insert: Callable[[DataFrame, int], None], update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch's inserts, then its updates (column op), to a writer of their own; their order in the batch is lost."""

    def split(batch: DataFrame, n: int) -> None:
        insert(batch.where(F.col("op") == "INSERT"), n)
        update(batch.where(F.col("op") == "UPDATE"), n)

    return run(stream, split, checkpoint)


def cost_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Cost events of logs of one JSON object a line; other lines, and such as are no JSON, are left out."""
    reader = (spark.readStream if stream else spark.read).schema(COST_SCHEMA).option("mode", "DROPMALFORMED")
    return reader.json(path).where(F.col("message") == "Cost tracked").drop("message")


def running_costs(costs: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each model so far; over a stream, in complete or update mode."""
    return costs.groupBy("modelId").agg(F.count(F.lit(1)).alias("calls"), F.sum("totalTokens").alias("tokens"), F.sum("cost").alias("cost"))


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that has landed, in batches, and then stop; the next run goes on from there."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
