"""Streams over landed files give what a batch over the same files gives."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as S

from marginalia.streaming import feeds, states


def landed(spark, sf_dir, path, parts=3):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    for i in range(parts):
        e.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return e


def test_materialised_is_the_latest_of_each_key(spark, sf_dir, tmp_path):
    e = landed(spark, sf_dir, str(tmp_path / "in"))
    q = feeds.materialised(feeds.changes(spark, str(tmp_path / "in"), files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["user_id"]: r["event_id"] for r in feeds.snapshot(spark, str(tmp_path / "out")).collect()}
    want = {r["user_id"]: r["e"] for r in e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want


def test_only_touched_parts_are_written_again(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    row = lambda e, u, day: (e, dt.datetime(2024, 1, day), u, "view", 1.0, None)
    for rows in ([row(i, i, 1) for i in range(50)], [row(100, 7, 2), row(101, 7, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.materialised(feeds.changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), parts=8).awaitTermination()
    written = [sum(1 for p in (tmp_path / "out" / f"version={n}").iterdir() if p.name.startswith("part=")) for n in (0, 1)]
    got = {r["user_id"]: r["event_id"] for r in feeds.snapshot(spark, str(tmp_path / "out")).collect()}
    assert got == {i: i for i in range(50)} | {7: 100} and written[0] > 1 and written[1] == 1


def test_operations_are_split(spark, sf_dir, tmp_path):
    e = landed(spark, sf_dir, str(tmp_path / "in"), 2)
    out = {"insert": [], "update": []}
    stream = feeds.changes(spark, str(tmp_path / "in")).withColumn("op", F.when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE"))
    add = lambda name: lambda df, n: out[name].extend(r["event_id"] for r in df.collect())
    feeds.by_operation(stream, add("insert"), add("update"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(out["insert"]) == sorted(r["event_id"] for r in e.where("event_type = 'signup'").collect())
    assert len(out["insert"]) + len(out["update"]) == e.count()


def test_cost_logs(spark, tmp_path):
    lines = [{"message": "Cost tracked", "modelId": f"m{i % 2}", "cost": 0.5, "totalTokens": 10} for i in range(6)] + [{"message": "other", "modelId": "m0", "cost": 9}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json {\n")
    want = {"m0": (3, 30, 1.5), "m1": (3, 30, 1.5)}
    of = lambda rows: {r["modelId"]: (r["calls"], r["tokens"], r["cost"]) for r in rows}
    assert of(feeds.running_costs(feeds.cost_log(spark, str(tmp_path / "log"))).collect()) == want
    out = []
    stream = feeds.running_costs(feeds.cost_log(spark, str(tmp_path / "log"), stream=True)).writeStream.outputMode("complete")
    stream.foreachBatch(lambda df, n: out.append(of(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert out[-1] == want


def test_exports_can_be_read_again(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, 'a "b", \n c', None), (-2, "", "x")], "doc_id long, text string, lang string"))
    rows = sorted(map(tuple, docs.collect()))
    docs.write.json(str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(docs.schema).json(str(tmp_path / "json")).collect())) == rows
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "\\N"}
    docs.write.options(**options).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.schema(docs.schema).options(**options).csv(str(tmp_path / "csv")).collect())) == rows
    (tmp_path / "one.json").write_text(json.dumps([{"ids": [1, 2], "name": "x"}, {"ids": [], "name": None}], indent=2))
    assert [r["ids"] for r in spark.read.option("multiLine", True).json(str(tmp_path / "one.json")).orderBy("name", ascending=False).collect()] == [[1, 2], []]


def test_counters_equal_batch(spark, sf_dir, tmp_path):
    e = landed(spark, sf_dir, str(tmp_path / "in"), 1)
    out = []
    stream = feeds.counters(feeds.changes(spark, str(tmp_path / "in")), late="400 days")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["started"]: (r["events"], r["errors"]) for r in out}
    batch = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("x"))
    assert got == {r["w"]["start"]: (r["n"], r["x"]) for r in batch.collect()}


def test_breaker(spark):
    rows = [(1, i, f"2024-01-01 00:{i:02d}:00", ok) for i, ok in enumerate([False, False, False, True])] + [(1, 9, "2024-01-01 01:30:00", True), (1, 10, "2024-01-01 01:31:00", True), (1, 11, "2024-01-01 01:32:00", False)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, ok boolean").withColumn("ts", F.col("ts").cast(S.TimestampNTZType()))
    got = [r["state"] for r in states.breaker_states(df, "user_id", "ts", "event_id").orderBy("event_id").collect()]
    assert got == ["closed", "closed", "open", "open", "half-open", "closed", "closed"]


def test_limiter(spark):
    df = spark.range(30).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") >= 5).alias("ok"))
    got = [r["level"] for r in states.limiter_levels(df, "user_id", "ts", "event_id").orderBy("event_id").collect()]
    assert got[:6] == [0, 0, 1, 2, 3, 3] and got[14] == 2 and got[24] == 1
