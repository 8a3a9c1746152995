"""From raw documents to packed training sequences, in five stages that each write what they keep.

quality:  documents that the classifier scores below its threshold go.
copies:   one document of each class of near-copies stays.
secrets:  secrets in the texts that stay are masked; no document goes.
mixing:   documents are used, once or more often or not at all, to meet the weights of domains, languages and sources.
packing:  the uses are cut and packed into sequences.

Each stage takes a table with the columns of documents (doc_id, text, lang, source, n_chars) and maybe others, and all but
the last return its columns, in its order. Null, empty and very long texts and repeated rows are documents like any
others; columns whose names an operator uses for itself keep their values; an empty table gives an empty one. What ties
and nulls mean to a stage stands in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import carried, emptied, setting, shared_dir
from marginalia.llm.mixing import mix
from marginalia.llm.near_dedup import deduplicated
from marginalia.llm.packing import pack
from marginalia.llm.quality_classifier import THRESHOLD, scorer, train
from marginalia.llm.secrets import redacted, scan

#: Entries of each of a worker's tables of token ids, fewer than where packing runs alone: workers come with the memory of other stages.
ENTRIES = 100_000

#: Rows of whole texts that a Python worker takes at a time; workers go from stage to stage and keep their tables.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def bounded(spark: SparkSession):
    """Arrow batches of at most ROWS rows for the jobs inside; a smaller setting of the session stands."""
    own = int(spark.conf.get(BATCH))
    return setting(spark, BATCH, str(own if 0 < own <= ROWS else ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of THRESHOLD or more, learnt from the labels of ``sf_dir``.

    A null or empty text has the score of a bag of one empty passage. Without labels all score 0.5 and stay.
    """
    with bounded(spark):
        model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return docs.where(scorer(model)(F.col("text")) >= THRESHOLD)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-copies the row with the least doc_id (of several such, any one of them).

    Texts without words are copies of each other; a null doc_id stays only if its class has no other.
    """
    with bounded(spark):
        return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each span; n_chars, where there is one, follows the text.

    A null text stays null.
    """
    found = scan(carried(docs, given=F.struct(*docs.columns), text=F.col("text")).select("given", "text"))
    masked = found.select("given", (F.size("spans") > 0).alias("changed"), redacted(F.col("text"), F.col("spans")).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("changed"), F.length("masked").cast("long")).otherwise(F.col("given.n_chars"))}
    return masked.select(*[new[c].alias(c) if c in new else F.col(f"given.`{c}`").alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses of documents that meet the weights: a document used twice stands there twice.

    A null language or source is a name of its own, a null text has no tokens. Rows alike in hash, doc_id and tokens are
    taken in any order.
    """
    return mix(carried(docs, given=F.struct(*docs.columns), doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang"), source=F.col("source")).drop("row")).select("given.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its ids, its place in a sequence, and epoch: which use of its document it is, from 0.

    ids are bytes: little-endian numbers of 2 bytes each, or of 4 in a piece that has greater ones.

    The pieces of a sequence stand in one file, one after the other, so that a trainer reads whole sequences as they
    come. A null or empty text is a piece of the end token alone.
    """
    with bounded(spark):
        return pack(docs, with_ids=True, with_epoch=True, in_sequence=True, id_bytes=True, entries=ENTRIES)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL can express neither the classifier nor the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if i:
            emptied(before)
    return docs
