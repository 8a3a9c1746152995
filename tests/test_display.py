"""What readers and prompts see, by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.functions import display as D


def plain_chunks(text, most):
    out, now = [], ""

    def close():
        nonlocal now
        if now.strip(" "):
            out.append(now.strip(" "))
            now = ""

    for p in text.split("\n"):
        if len(now) + len(p) <= most:
            now += ("\n" if now else "") + p
            continue
        close()
        if len(p) <= most:
            now = p
            continue
        for w in p.split(" "):
            if len(now) + len(w) > most:
                close()
            now += (" " if now else "") + w
        close()
    close()
    return out


def test_chunks_of_characters(spark, sf_dir):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab \n") * rng.randint(1, 4) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "x" * 50, "one two\n" * 9]
    df = spark.createDataFrame([(x,) for x in [*made, None]], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", D.text_chunks(F.col("t"), 12).alias("c")).collect()}
    assert got.pop(None) == [] and all(got[x] == plain_chunks(x, 12) for x in made)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", D.text_chunks(F.col("text"), 300).alias("c")).collect()
    assert all(r["c"] == plain_chunks(r["text"], 300) for r in docs)


def test_context_block(spark):
    rows = [(1, "T", "https://a.example/" + "x" * 60, "- first\nsecond", "Ghent", "repo", 1.25, None), (2, "", "https://a.example/" + "x" * 60, None, None, None, None, ["a", "b"]), (3, None, None, "\n \n* " + "y" * 300, "", "", None, [])]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 2)) for r in rows], "n int, title string, url string, summary string, location string, kind string, miles double, shared array<string>, at timestamp_ntz")
    got = [r[0] for r in df.orderBy("n").select(D.context_block(*[F.col(c) for c in ("n", "at", "title", "url", "summary", "location", "kind", "miles", "shared")])).collect()]
    assert got[0] == '1. [2024-01-02] "T"\n   Location: Ghent | Type: repo | Distance: 1.3 mi\n   Summary: first'
    assert got[1] == f'2. [2024-01-02] "{("https://a.example/" + "x" * 60)[:50]}"\n   Location: Unknown location | Type: bookmark\n   Shared tags: a, b\n   Summary: No summary available'
    assert got[2].endswith(f'Shared tags: \n   Summary: {"y" * 200}...') and '"Untitled"' in got[2]


def test_dates_run_over(spark):
    df = spark.createDataFrame([(dt.date(2024, 8, 31),), (dt.date(2024, 3, 15),), (None,)], "d date")
    assert [r[0] for r in df.select(D.months_before(F.col("d"), 6)).collect()] == [dt.date(2024, 3, 2), dt.date(2023, 9, 15), None]


def test_shown_and_merged(spark):
    rels = '[{"source": {"name": "A"}, "type": "X", "target": "B"}, 7, null, {}, {"target": "C"}, {"source": "", "target": ""}]'
    df = spark.createDataFrame([(rels, '[{"target": "C"}, {"b": 1, "a": 2}]'), ("broken", None)], "r string, s string")
    got = df.select(D.shown(F.col("r"), 1).alias("s"), D.merged(F.col("r"), F.col("s")).alias("m")).collect()
    assert got[0]["s"]["lines"] == ["A →[X]→ B"] and got[0]["s"]["more"] == 1
    assert len(got[0]["m"]) == 7 and got[1]["m"] == []
