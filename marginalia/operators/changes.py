"""Snapshots under change: upserts, inserts of what is missing, deletions, merges and the latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.items import first_by


def upsert(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """The new snapshot: of each key the first row by ``order`` (ascending) over both tables; a second run changes nothing."""
    return first_by(old.unionByName(new, allowMissingColumns=True), [key], *order)


def upsert_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``new`` (one row a key), and the rows that it lacks."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    both = old.join(fresh, key, "full_outer")
    return both.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key])


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of several such with one key all are inserted."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` isn't true; a null condition keeps its row."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def latest_feed(changes: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` keys by ``order``, each with its first row."""
    return first_by(changes, [key], *order).orderBy(*order).limit(n)


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the names of ``fields`` whose values differ, for keys of both tables where any does."""
    both = old.select(key, *fields).join(new.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields]))
    return both.select(key, names.alias("changed")).where(F.size("changed") > 0)
