"""Queries of pages as trees; SQL has no stack, so they are compared with a plain parser in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..sources.items import table
from .registry import registry

Q, SQL, query = registry()


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", H.nodes(F.col("html")).alias("nodes"))


@query("page_text_S22")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page as its readers get it: title, address, and the text of its text elements."""
    parts = trees(spark, sf_dir).select("page_id", "url", H.page_title(F.col("nodes")).alias("title"), H.page_text(F.col("nodes")).alias("text"))
    return parts.select("page_id", F.concat(F.lit("#"), F.coalesce("title", F.lit("")), F.lit("\n##"), F.coalesce("url", F.lit("")), F.lit("\n"), "text").alias("content"))


@query("page_measures_F41")
def page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, links, images and bold texts of each page."""
    m = trees(spark, sf_dir).select("page_id", H.measures(F.col("nodes")).alias("m"))
    return m.select("page_id", "m.words", "m.links", "m.photos", F.array_join("m.strong", "|").alias("strong"))
