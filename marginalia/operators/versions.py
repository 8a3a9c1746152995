"""Runs of an extractor, kept by version: a run that is repeated replaces its own rows, and only complete runs are read.

Each attempt at a run writes its rows to a folder of its own and then an entry in the manifest, in the place of the run's
earlier one. What no entry names isn't there for readers, so an attempt that fails changes nothing, and neither does a
run that is repeated over the same documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that documents are dealt into.
PARTS = 64

VERSIONS = ("extractor", "ontology")
MANIFEST = "attempt string, at timestamp_ntz, complete boolean, extractor string, ontology string, run string"


def digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of a row's ``columns``, for telling whether it changed; nulls and kinds count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def written(rows: DataFrame, path: str, run: str, extractor: str, ontology: str, at: str, complete: bool = True, key: str = "id", parts: int = PARTS) -> str:
    """Writes the rows of a run over some or all documents, then its entry in the manifest; returns the attempt's name.

    ``rows``: ``key`` and any other columns but versions, run, attempt and part; every document that the run has read needs a
    row, so that one without results replaces what earlier runs found in it. ``at``: the time by which runs follow one another.
    """
    attempt = begun(rows, path, run, extractor, ontology, key, parts)
    entry = rows.sparkSession.createDataFrame([(attempt, at, complete, extractor, ontology, run)], MANIFEST.replace("at timestamp_ntz", "at string"))
    entry = entry.withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1)
    entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*VERSIONS, "run").parquet(f"{path}/manifest")
    return attempt


def begun(rows: DataFrame, path: str, run: str, extractor: str, ontology: str, key: str = "id", parts: int = PARTS) -> str:
    """The first half of ``written``: rows that nothing reads until the manifest names them."""
    attempt = uuid.uuid4().hex
    names = {"extractor": extractor, "ontology": ontology, "run": run, "attempt": attempt}
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumns({c: F.lit(v) for c, v in names.items()})
    dealt.hint("rebalance", "part").write.mode("append").partitionBy(*names, "part").parquet(f"{path}/rows")
    return attempt


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of runs that ended; none where nothing has been written yet."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select(*names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, path: str, schema: str, extractor: str | None = None, ontology: str | None = None, include_partial: bool = False, key: str = "id") -> DataFrame:
    """The rows of each document by the last run that is read: of the given versions (any), complete ones unless ``include_partial``.

    ``schema``: of the rows' own columns, key among them.
    """
    runs = manifest(spark, path)
    if not include_partial:
        runs = runs.where("complete")
    for name, value in zip(VERSIONS, (extractor, ontology)):
        if value is not None:
            runs = runs.where(F.col(name) == value)
    if runs.isEmpty():
        return spark.createDataFrame([], f"{schema}, run string, extractor string, ontology string")
    entries = runs.select("attempt", "run", *VERSIONS, "at")
    folders = "extractor string, ontology string, run string, attempt string, part int"
    rows = spark.read.schema(f"{schema}, {folders}").parquet(f"{path}/rows").join(F.broadcast(entries), ["attempt", "run", *VERSIONS])  # a row a run
    # a document's last run: the greatest of a value, so that no task holds a document's history
    last = rows.groupBy(key).agg(F.max(F.struct("at", "run")).alias("last"))
    columns = [f.split()[0] for f in schema.split(", ")]
    return rows.join(last, key).where(F.struct("at", "run") == F.col("last")).select(*columns, "run", *VERSIONS)


def changed(spark: SparkSession, before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed) of rows that differ in ``columns`` between two readings; keys are unique in each."""
    both = before.select(key, digest(before, columns).alias("old")).join(after.select(key, digest(after, columns).alias("new")), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())
