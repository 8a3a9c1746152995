"""Staged extraction by hand-made replies: every stage settles some, and what is observed are the sums."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import document_rules as R
from marginalia.operators import extraction as X
from marginalia.plans import extraction as P

LONG = "Ada Lovelace made Note G and Sketch One. " * 40


def rel(subject, target, kind="CREATED", source_type="Person", target_type="Artwork", **more):
    return {"source": {"name": subject, "type": source_type}, "target": {"name": target, "type": target_type}, "type": kind, **more}


def run(spark, docs, replies, seen=None):
    d = spark.createDataFrame([(i, "x", None, "T", None, *c) if isinstance(c, tuple) else (i, "x", None, "T", None, c) for i, c in docs], "id long, source string, url string, title string, summary string, content string")
    r = spark.createDataFrame([(i, s, None if x is None else json.dumps(x)) for i, s, x in replies], "id long, stage string, reply string")
    return X.settled(spark, d, r, seen)


def found(rows):
    return {(r["id"], r["place"], r["subject"], r["object"], r["settled_by"]) for r in X.relationships(rows).collect()}


def test_each_stage(spark):
    good, other, unfit = rel("Ada Lovelace", "Note G"), rel("Ada Lovelace", "Sketch One"), rel("Ada Lovelace", "Note G", kind="ADMIRES")
    weak = rel("Ada Lovelace", "Note G", evidence="these words were never said in it")
    docs = [(i, LONG) for i in range(1, 10)] + [(10, ""), (11, None), (12, LONG)]
    replies = [
        (1, X.FIRST, [good, other, good]),  # strict, the repeated one once
        (2, X.FIRST, [weak]), (2, X.REVIEW, [good]),  # fits, and the review mends its evidence
        (3, X.FIRST, [unfit, other]), (3, X.REMAP, [good, other]),  # the remapped one is new, the other isn't
        (4, X.FIRST, [good]), (4, X.REVIEW, [other]),  # a review may bring its own
        (5, X.FIRST, [weak]), (5, X.RECOVERY, [good | {"evidence": "Ada Lovelace made Note G"}]),  # too short an article without a summary
        (6, X.FIRST, [good]), (6, X.REVIEW, None),  # an empty review leaves nothing
        (7, X.FIRST, [1, None, {}, rel("", "Note G")]), (8, X.REMAP, [good]), (9, X.FIRST, []),
        (10, X.FIRST, [good]), (11, X.FIRST, [good]),
    ]
    got = run(spark, docs, replies)
    assert found(got) == {
        (1, 0, "Ada Lovelace", "Note G", "strict"), (1, 1, "Ada Lovelace", "Sketch One", "strict"), (2, 0, "Ada Lovelace", "Note G", "permissive"),
        (3, 0, "Ada Lovelace", "Sketch One", "strict"), (3, 1, "Ada Lovelace", "Note G", X.REMAP), (4, 0, "Ada Lovelace", "Sketch One", X.REVIEW),
    }
    by_id = {r["id"]: r for r in got.collect()}
    assert {i: r["skipped"] for i, r in by_id.items() if r["skipped"]} == {8: "no_llm_response", 10: "empty_content", 11: "empty_content", 12: "no_llm_response"}
    assert by_id[1]["raw"] == 3 and by_id[1]["final"] == 2 and by_id[3]["remapped"] == 1 and not any(r["used_recovery"] for r in by_id.values())


def test_recovery(spark):
    quoted = rel("Ada Lovelace", "Note G", evidence="Ada Lovelace made Note G and")
    bare = rel("Ada Lovelace", "Note G")
    docs = [(i, LONG * 2) for i in range(1, 6)]
    replies = [(i, X.FIRST, []) for i in range(1, 6)] + [
        (1, X.RECOVERY, [quoted]), (2, X.RECOVERY, [bare]), (2, X.RECOVERY_REVIEW, [quoted]), (3, X.RECOVERY, [bare]), (4, X.RECOVERY_REVIEW, [quoted]), (5, X.RECOVERY, None),
    ]
    seen = Observation("extraction")
    got = run(spark, docs, replies, seen)
    assert {(r[0], r[4]) for r in found(got)} == {(1, X.RECOVERY), (2, "recovery permissive"), (4, X.RECOVERY_REVIEW)}


def test_counters_are_observed_without_a_second_pass(spark, sf_dir):
    seen = Observation("counters")
    rows = P.settled(spark, sf_dir, seen).collect()
    assert seen.get == {c: sum(r[c] for r in rows) for c in X.COUNTERS} and seen.get["final"] > 0
    assert run(spark, [], []).count() == 0


def test_a_text_is_read_once_for_all_its_candidates(spark, sf_dir):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = P.documents(spark, sf_dir)
    made = P.replies(docs.select("doc_id", docs["content"].alias("text")))
    assert plan(made).count("Relation") == 1
    judged = plan(X.judged(spark, docs.withColumnRenamed("doc_id", "id"), made))
    assert judged.count("lower(content#") + judged.count("lower(text#") == 1


def test_forms_are_those_of_names_put_right(spark):
    texts = ["", " “Don’t”  go`s  on ", "'İstanbul' K﻿Σ", "a ' b", None, "``", "O'Neil's \"x\"y", "\t12\n3 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    named = T.entity_name(F.col("t"))
    rows = df.select(R.name_form(F.col("t")), T.match_form(named), R.evidence_form(F.col("t")), T.match_form(F.regexp_replace(named, "[\"'`]+", ""))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows) and rows[1][2] == "dont gos on"
