"""Quality rules: in-document counts, and the frequency of lines across the documents of a host.

A line that stands in many documents of one host (menus, notices, licence lines) says nothing about any of them. Lines
are normalised and hashed, the documents that hold each line are counted per host, lines above the limit are removed,
whatever the size of the host, and documents that lose too much are rejected. A document is an id with its text: rows
that repeat both count once, documents that copy a text count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, emptied, joined_evenly, let, written

#: White space: space, and the characters 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: A document of fewer words, or with a larger share of repeated ones, fails at once.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: A line is removed that stands in more documents of its host than this.
LINE_TEXTS = 20
#: A document is depleted with a larger share of its words removed, or with fewer words left.
MOST_REMOVED, LEAST_LEFT = 0.5, 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words stand in a three-word window that the text has at least twice."""

    def covered(windows: Column) -> Column:
        same = lambda e, i: F.when(F.size(windows) > i, e["h"] == F.get(windows, i)["h"])
        twice = F.filter(windows, lambda e, i: F.coalesce(same(e, i + 1), F.lit(False)) | F.coalesce((i > 0) & same(e, i - 1), F.lit(False)))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda e: e["at"])),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        )["n"]

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at"))
    )
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(hashed), covered))


def counts(text: Column) -> Column:
    """struct of the in-document counts of a text (null: as if empty), all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        words(text),
        lambda w: F.struct(
            long(F.size(w), "n_words"),
            long(F.length(F.translate(text, " \t\n\x0b\f\r", "")), "word_chars"),
            long(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
            long(repeated_words(w), "n_repeat_words"),
        ),
    )


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, WHITE, " ")))


def line_hashes(text: Column) -> Column:
    """array<struct<h, n>>: hash and number of words of each line that has a word, in order."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def line_quality(
    docs: DataFrame, host: str = "source", line_texts: int = LINE_TEXTS, doc: str = "doc_id",
    most_removed: float = MOST_REMOVED, least_left: int = LEAST_LEFT,
) -> DataFrame:
    """``docs`` with the counts, base_failed, n_removed_lines, n_removed_words, clean_text and kept.

    A null text counts as an empty one and gets an empty clean_text; null hosts are one host, and null ids one id. Equal
    rows get equal results. Columns of ``docs`` that bear one of these names, in any case, are replaced; all others stay.
    Lines without a word are neither counted nor removed. An empty table gives an empty one.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "clean_text", "kept"]
    of_text, line = ["host", "key"], ["host", "line"]
    rows = carried(
        docs, own, host=F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")), key=F.unhex(F.md5(F.coalesce("text", F.lit("")))), doc=F.col(doc),
        text=F.coalesce("text", F.lit("")),
    )
    documents = rows.select(*of_text, "doc").distinct().groupBy(*of_text).agg(F.count(F.lit(1)).alias("docs"))
    texts = written(
        rows.select(*of_text, counts(F.col("text")).alias("c"), line_hashes(F.col("text")).alias("lines"))
        .groupBy(*of_text).agg(F.first("c").alias("c"), F.first("lines").alias("lines"), F.count(F.lit(1)).alias("rows"))
        .join(documents, of_text),
        "line-quality",
    )
    frequent = written(
        texts.select("host", "docs", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line"))
        .groupBy(*line).agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("texts"))
        .where(F.col("docs") > line_texts).select(*line, "texts"),
        "frequent-lines",
    )
    each = texts.select(*of_text, F.inline("lines")).withColumnRenamed("h", "line")
    removed = joined_evenly(each, frequent, line, "texts").groupBy(*of_text).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_words"), F.collect_set("line").alias("gone")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    judged = texts.select(*of_text, "c", "rows").join(removed, of_text, "left").select(
        *of_text, "rows", F.struct("c.*", zero("n_lines").alias("n_removed_lines"), zero("n_words").alias("n_removed_words"), "gone").alias("v")
    )
    judged = written(judged, "line-verdicts")
    emptied(texts, frequent)
    n, gone = F.col("v.n_words"), F.col("v.n_removed_words")
    failed = (n < LEAST_WORDS) | (F.col("v.n_repeat_words") * 100 > n * int(100 * MOST_REPEATED))
    clean = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains("v.gone", F.xxhash64(normalised(x))), F.lit(False))), "\n")
    found = joined_evenly(rows, judged, of_text, "rows").select(
        "row", *[F.col(f"v.{x}").alias(x) for x in own[:5]], failed.alias("base_failed"), F.col("v.n_removed_lines").alias("n_removed_lines"),
        gone.alias("n_removed_words"), clean.alias("clean_text"), (~failed & (gone <= n * most_removed) & (n - gone >= least_left)).alias("kept"),
    )
    return found.select("row.*", *own)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words"
    )
