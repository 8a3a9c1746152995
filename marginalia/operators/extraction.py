"""Staged extraction: which of the relationships that models replied with are settled, and by which stage.

Replies are tables: a first reading of a document, rewritten candidates for those that the ontology turned away, reviews,
and a second reading of documents that the first left with nothing. Every candidate is judged once, by the ontology and by
its document; what a stage then takes, passes on or brings back is decided within one row a document, which holds its
candidates' verdicts but not its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import document_rules as R
from . import graph as G

#: What a reply answers.
FIRST, REMAP, REVIEW, RECOVERY, RECOVERY_REVIEW = STAGES = ("first", "remap", "review", "recovery", "recovery review")

#: Characters of an article from which a second reading is worth it without a summary.
WORTH_RECOVERY = 2500

#: Counters of a document, summed up over all of them as the rows go by.
COUNTERS = ("raw", "remap_targets", "remapped", "before_review", "after_review", "recovered", "final", "asserted", "reported")


def judged(spark: SparkSession, docs: DataFrame, replies: DataFrame) -> DataFrame:
    """id and candidates: for each document with a reply its candidates by stage and place, each with what is known of it.

    rejected: the ontology turns it away; fits: it stands in its document; strict: it is also worth keeping (after a
    second reading only with evidence from the document).
    """
    raw = G.exploded(replies.select("id", "stage", F.col("reply").alias("relationships")), "id", "stage")
    r = G.in_ontology(spark, raw, "id", "stage", "n")
    candidate = ("stage", "n", "subject", "subject_type", "predicate", "object", "object_type", "claim_mode", "evidence", "reject")
    # a document meets all its candidates in one row, so what its text tells is made once and not for each of them
    met = docs.select("id", "url", "title", "summary", "content").join(r.groupBy("id").agg(F.collect_list(F.struct(*candidate)).alias("held")), "id")
    r = R.rewritten(R.known(met).select("id", *R.FACTS, F.inline("held")))
    r = R.low_value(r, F.col("stage").isin(RECOVERY, RECOVERY_REVIEW))
    fits = F.col("reject").isNull() & F.col("drop").isNull()
    named = F.struct(
        "stage", "n", "subject", "subject_type", "predicate", "object", "object_type", "claim_mode", F.col("reject").isNotNull().alias("rejected"),
        fits.alias("fits"), (fits & F.col("reason").isNull()).alias("strict"),
    )
    return r.groupBy("id").agg(F.array_sort(F.collect_list(named)).alias("candidates"))


def key(c: Column) -> Column:
    return F.concat_ws("|", c["subject"], c["predicate"], c["object"])


def whole_key(c: Column) -> Column:
    return F.concat_ws("|", c["subject"], c["subject_type"], c["predicate"], c["object"], c["object_type"])


def of(stage: str, candidates: str = "candidates", which: str | None = None) -> Column:
    return F.filter(candidates, lambda c: (c["stage"] == stage) & (c[which] if which else F.lit(True)))


def by(rows: Column, stage: str) -> Column:
    return F.transform(rows, lambda c: c.withField("settled_by", F.lit(stage)))


def reviewed(before: str, review: str) -> Column:
    """The strict ones of a review's rows, each settled by the stage that its key came from, or of ``before`` without a review."""
    source = lambda c: F.get(F.filter(before, lambda b: key(b) == key(c)), 0)["settled_by"]
    new = F.transform(of(review, which="strict"), lambda c: c.withField("settled_by", F.coalesce(source(c), F.lit(review))))
    return F.when(F.array_contains("replied", review), new).otherwise(F.filter(before, lambda c: c["strict"]))


def settled(spark: SparkSession, docs: DataFrame, replies: DataFrame, seen: Observation | None = None) -> DataFrame:
    """A row a document: id, skipped (why it wasn't read: empty_content, thin_video_shell, no_llm_response; else null), used_recovery,
    COUNTERS, and relationships: what is left, each with settled_by.

    ``docs``: id, source, url, title, summary, content. ``replies``: id, stage (of STAGES), reply: a JSON array of candidates (null
    or no array: a reply without any). Strict candidates of the first reading are taken; where there is none, but some fit, those
    that fit in an article or a block. Rejected ones come back as the remap reply has them, if strict and new. A review replaces
    what came before it. Without any left, articles of some length or with a summary are taken from the second reading in the same way,
    except for remapping. Of equal relationships the first is kept. ``seen`` observes the sums of COUNTERS as the result is computed.
    """
    replied = replies.groupBy("id").agg(F.collect_set("stage").alias("replied"))
    kinds = R.kinds(docs).select(
        "id", F.coalesce(F.length("content"), F.lit(0)).alias("length"), (F.coalesce("summary", F.lit("")) != "").alias("summed"), "article",
        F.coalesce(F.col("source") == "arena", F.lit(False)).alias("block"), F.col("thin").alias("shell"),
    )
    # texts and the rules that read them end here: a narrow row a document goes on
    d = stored(kinds.join(replied, "id", "left").join(judged(spark, docs, replies), "id", "left"), name="candidates")
    none = F.filter("candidates", lambda c: F.lit(False))
    skipped = F.when(F.col("length") == 0, "empty_content").when(F.col("shell"), "thin_video_shell").when(~F.coalesce(F.array_contains("replied", FIRST), F.lit(False)), "no_llm_response")
    d = d.withColumn("skipped", skipped)
    read = F.col("skipped").isNull() & F.col("candidates").isNotNull()
    empty = "array<struct<stage:string,n:int,subject:string,subject_type:string,predicate:string,object:string,object_type:string,claim_mode:string,rejected:boolean,fits:boolean,strict:boolean>>"
    d = d.withColumn("candidates", F.when(read, F.col("candidates")).otherwise(F.array().cast(empty))).withColumn("replied", F.coalesce("replied", F.array().cast("array<string>")))
    takes = lambda stage, name, where: F.when(F.size(of(stage, which="strict")) > 0, by(of(stage, which="strict"), stage if stage != FIRST else "strict")).when(where, by(of(stage, which="fits"), name)).otherwise(by(none, ""))
    d = d.withColumn("taken", takes(FIRST, "permissive", F.col("article") | F.col("block")))
    remap = F.when(F.size(of(FIRST, which="rejected")) > 0, of(REMAP, which="strict")).otherwise(none)
    fresh = F.filter(remap, lambda c, i: ~F.exists("taken", lambda t: key(t) == key(c)) & ~F.exists(F.slice(remap, 1, i), lambda t: key(t) == key(c)))
    d = d.withColumn("remapped", fresh).withColumn("before", F.concat("taken", by(F.col("remapped"), REMAP)))
    d = d.withColumn("after", reviewed("before", REVIEW))
    again = F.col("skipped").isNull() & (F.size("after") == 0) & F.col("article") & ((F.col("length") >= WORTH_RECOVERY) | F.col("summed"))
    d = d.withColumn("used_recovery", again)
    d = d.withColumn("recovered", F.when(F.col("used_recovery"), takes(RECOVERY, "recovery permissive", F.col("article"))).otherwise(by(none, "")))
    d = d.withColumn("last", F.when(F.col("used_recovery"), reviewed("recovered", RECOVERY_REVIEW)).otherwise(F.col("after")))
    once = F.filter("last", lambda c, i: ~F.exists(F.slice("last", 1, i), lambda b: whole_key(b) == whole_key(c)))
    d = d.withColumn("final", once)
    n = lambda c: F.size(c).cast("long")
    mode = lambda m: n(F.filter("final", lambda c: c["claim_mode"] == m))
    counts = [n(of(FIRST)), n(of(FIRST, which="rejected")), n("remapped"), n("before"), n("after"), n("recovered"), n("final"), mode("asserted"), mode("reported")]
    out = d.select("id", "skipped", "used_recovery", *[c.alias(x) for c, x in zip(counts, COUNTERS)], F.col("final").alias("relationships"))
    return out if seen is None else out.observe(seen, *[F.sum(x).alias(x) for x in COUNTERS])


def relationships(rows: DataFrame) -> DataFrame:
    """id, place, the fields and settled_by of each relationship of ``settled``."""
    names = ("subject", "subject_type", "predicate", "object", "object_type", "claim_mode", "settled_by")
    return rows.select("id", F.inline(F.transform("relationships", lambda r, i: F.struct(i.alias("place"), *[r[c].alias(c) for c in names]))))
