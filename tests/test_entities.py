"""Blocking finds what a comparison of all pairs does, hot words included; every tier is taken."""

import random
import re

import pytest

from marginalia.operators import entities as E
from marginalia.plans import entities as P


def tokens(x):
    return frozenset(re.findall(r"\w+", (x or "").lower()))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_within_one_another_are_found(spark, seed, monkeypatch):
    monkeypatch.setattr(E, "ROWS_A_SALT", 5)
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "the", "the", "city", "city", "blue", "lake", "ox", "elm", "fen", "ivy", "oak"])
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 4)))
    names = [(i, text(), "Tool") for i in range(80)] + [(100, None, "Tool"), (101, "The  CITY!", "Tool"), (101, "The  CITY!", "Tool")]
    known = [(f"Q{i}", text(), [text() for _ in range(rng.randint(0, 2))]) for i in range(90)] + [("Q900", None, None)]
    got = E.candidates(spark.createDataFrame(names, "entity long, name string, kind string"), spark.createDataFrame(known, "qid string, label string, aliases array<string>"))
    want = {(e, q) for e, n, _ in names for q, label, aliases in known for t in [label, *(aliases or [])] if tokens(n) and tokens(t) and (tokens(n) <= tokens(t) or tokens(t) <= tokens(n))}
    assert {(r["entity"], r["qid"]) for r in got.collect()} == want and want


def test_tiers(spark):
    known = [
        ("Q1", "Blue Lake", "a lake in the north", [], ["Q7397"], 60), ("Q2", "Blue Lake", None, ["Lake Blue"], ["Q5"], 60), ("Q3", "Elm Fen", "a fen, and a name", ["Elm Fen"], ["Q7397"], 3), ("Q4", None, None, None, None, None),
    ]
    names = [(1, "blue lake", "Tool"), (2, "Blue Lake", "Person"), (3, "Elm Fen", "Tool"), (4, "nothing known", "Tool"), (5, "Menu", "Tool"), (6, "Company", "Tool"), (7, None, "Tool"), (8, "Blue Lake", "Person"), (9, "Blue Lake", "Person"), (10, "Blue Lake", "Person")]
    answers = [(2, "Q2", 0.9), (8, "Q2", 0.3), (9, None, None), (5, "Q1", 1.0)]
    got = E.resolved(
        spark.createDataFrame(names, "entity long, name string, kind string"),
        spark.createDataFrame(known, "qid string, label string, description string, aliases array<string>, instance_of array<string>, sitelinks long"),
        spark.createDataFrame(answers, "entity long, qid string, confidence double"),
    )
    assert {r["entity"]: (r["method"], r["qid"], r["label"]) for r in got.collect()} == {
        1: ("heuristic", "Q1", "Blue Lake"), 2: ("llm", "Q2", "Blue Lake"), 3: ("below_threshold", None, None), 4: ("no_candidates", None, None), 5: ("skipped_junk", None, None),
        6: ("skipped_blocklist", None, None), 7: ("skipped_junk", None, None), 8: ("llm_low_confidence", None, None), 9: ("llm_rejected", None, None), 10: ("below_threshold", None, None),
    }


def test_query_takes_most_tiers(spark, sf_dir):
    methods = {r["method"] for r in P.resolve(spark, sf_dir).select("method").distinct().collect()}
    assert {"skipped_junk", "skipped_blocklist", "llm", "llm_low_confidence", "llm_rejected", "below_threshold"} <= methods


def test_copies_of_a_name_make_no_pairs_of_rows(spark):
    n = 3000
    names = spark.range(n).selectExpr("id AS entity", "'Blue Lake' AS name", "'Tool' AS kind")
    known = spark.range(n).selectExpr("concat('Q', id) AS qid", "'blue lake' AS label", "CAST(NULL AS string) AS description", "array('Lake', 'the blue lake that all of a long name holds') AS aliases", "array('Q7397') AS instance_of", "60L AS sitelinks")
    counts = E.candidate_counts(names, known)
    assert {(r["n"], r["first"]) for r in counts.collect()} == {(n, "Q0")} and counts.count() == n
    answers = spark.createDataFrame([], "entity long, qid string, confidence double")
    before = written(spark)
    got = E.resolved(names, known, answers)
    assert {(r["method"], r["qid"]) for r in got.select("method", "qid").distinct().collect()} == {("below_threshold", None)}
    assert written(spark) - before < 50 * n  # n * n pairs before


def written(spark):
    """Bytes that shuffles of this session have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    total = 0
    while found.hasNext():
        total += found.next().totalShuffleWrite()
    return total
