"""Tables that an operator writes and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master a folder of the machine may stand in."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "marginalia-checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, by: Sequence[str] = (), name: str = "stored") -> DataFrame:
    """``df`` as a Parquet table with folders ``by``; without a path a new one under ``name``. What reads it starts there.

    Rows of a folder are brought together, and folders of very many rows are split over tasks again by the session's
    adaptive execution.
    """
    path = path or new_path(df.sparkSession, name)
    if by:
        df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # folders of no rows leave no file to tell it
