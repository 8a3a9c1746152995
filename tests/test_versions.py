"""Runs by version: writing twice changes nothing, and what never ended is never read."""

import pytest

from marginalia.operators import versions as V

SCHEMA = "id long, value string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def read(spark, path, **how):
    return sorted((r["id"], r["value"], r["run"]) for r in V.read(spark, path, SCHEMA, **how).collect())


def test_a_second_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert read(spark, path) == [] and V.manifest(spark, path).count() == 0
    first = rows(spark, (1, "a"), (1, "b"), (2, None), (3, "c"))
    V.written(first, path, "one", "v1", "o1", "2024-01-01")
    before = read(spark, path)
    V.written(first, path, "one", "v1", "o1", "2024-01-01")
    assert read(spark, path) == before and len(before) == 4 and V.manifest(spark, path).count() == 1
    V.written(rows(spark, (1, "a"), (4, "d")), path, "one", "v1", "o1", "2024-01-01")  # the run's rows are those of its last attempt
    assert read(spark, path) == [(1, "a", "one"), (4, "d", "one")]


def test_an_aborted_run_is_never_read(spark, tmp_path):
    path = str(tmp_path)
    V.written(rows(spark, (1, "a"), (2, "b")), path, "one", "v1", "o1", "2024-01-01")
    V.begun(rows(spark, (1, "x"), (9, "x")), path, "one", "v1", "o1")
    V.begun(rows(spark, (1, "y")), path, "two", "v2", "o1")
    with pytest.raises(Exception):
        V.written(rows(spark, (1, "z")).selectExpr("id", "raise_error('lost') AS value"), path, "two", "v2", "o1", "2024-01-02")
    assert read(spark, path) == [(1, "a", "one"), (2, "b", "one")] == read(spark, path, include_partial=True)
    V.written(rows(spark, (1, "late")), path, "two", "v2", "o1", "2024-01-02", complete=False)
    assert read(spark, path) == [(1, "a", "one"), (2, "b", "one")]
    assert read(spark, path, include_partial=True) == [(1, "late", "two"), (2, "b", "one")]
    assert read(spark, path, extractor="v2", include_partial=True) == [(1, "late", "two")] and read(spark, path, ontology="o9") == []


def test_changes(spark):
    a, b = rows(spark, (1, "a"), (2, None), (3, "c")), rows(spark, (1, "a"), (2, ""), (4, "d"))
    assert {tuple(r) for r in V.changed(spark, a, b, "id", ["value"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
