"""Which entity of a knowledge base a name stands for: candidates by blocking, scores, tiers, and the details of the choice.

Names and labels meet as sets of words, each set once: a set lies within another of few words if it equals one of the other's
subsets, and within one of many words if its rarest word is there. So every candidate that shares all its words, or has all of
a name's, is found without comparing all with all. Names alike in what a score reads are scored once, against labels alike in
it, of which the least id stands for the others: copies make no pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..sources.stored import stored
from .related import small
from .resolve import candidate_points

#: Kinds of the knowledge base that entity types are expected to be of, and names that are too common to bind.
TYPE_HINTS = {
    "Person": ("Q5",), "Organization": ("Q43229", "Q4830453"), "Location": ("Q515", "Q6256", "Q3624078"), "Tool": ("Q7397", "Q166142"), "Model": ("Q11660", "Q7397"),
    "Dataset": ("Q1172284",), "Artwork": ("Q838948", "Q3305213"), "Project": ("Q170584",),
}
BLOCKED = (
    "company", "product designer", "staff writer", "animated series", "play now", "audio effects", "user guide", "expert help", "technical skills", "privacy policy", "getting started guide",
)

#: Names that are none: signs alone, amounts, numbers, words of pages and of grammar.
JUNK = (
    r"^[^a-zA-Z0-9]+$", r"(?i)^\$[\d,.]+\s*(million|billion|m|b|k)?$", r"^\d+$", r"(?i)^(click|submit|cancel|ok|yes|no|close|menu|nav|footer|header|sidebar)$",
    r"(?i)^(the|a|an|this|that|it|they|we|he|she|is|are|was|were|be|been)$",
)

#: Scores from which a candidate is taken unseen, from which it is worth asking, and the confidence of an answer that is taken; links that a little known entity lacks.
SURE, WORTH_ASKING, LEAST_CONFIDENCE, KNOWN = 0.75, 0.1, 0.6, 5

#: Sets of a word that share a salt; words of a set whose subsets are made.
ROWS_A_SALT, SUBSETS = 10_000, 6


def junk(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    out = F.length(n) < 2
    for pattern in JUNK:
        out = out | n.rlike(pattern)
    return out


def words(c: Column) -> Column:
    """The distinct words of a name, in order: letters and digits, in lower case."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def right_kind(kind: Column, instance_of: Column) -> Column:
    """Whether a candidate is of a kind that the type expects; null for a type that expects none."""
    out = None
    for name, expected in TYPE_HINTS.items():
        hit = F.coalesce(F.arrays_overlap(instance_of, F.array(*[F.lit(q) for q in expected])), F.lit(False))
        out = F.when(kind == name, hit) if out is None else out.when(kind == name, hit)
    return out


def score(name: Column, kind: Column, c: str = "c") -> Column:
    """The score of candidate struct ``c`` (label, aliases, instance_of, sitelinks, described) for a name, within 0 and 1; copes with missing members."""
    get = lambda x: F.col(f"{c}.{x}")
    fits = right_kind(kind, get("instance_of"))
    same = F.lower(F.trim(name))
    aliased = F.coalesce(F.exists(get("aliases"), lambda a: F.lower(F.trim(a)) == same), F.lit(False))
    points = candidate_points(name, get("label"), kind, F.coalesce(fits, F.lit(False)), get("sitelinks"), F.lower(F.trim(get("label"))) == same)
    more = F.when(fits.isNull(), 0.1).otherwise(0.0) + F.when(aliased, 0.1).otherwise(0.0) + F.when(get("described"), 0.05).otherwise(0.0)
    return M.clamped(points + more, 0.0, 1.0)


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: which sets of words lie within which. Both are written tables of distinct sets, as ``words`` makes them."""
    few = F.size("outer") <= SUBSETS
    each = F.expr("transform(sequence(1, shiftleft(1, size(outer)) - 1), m -> filter(outer, (w, i) -> (shiftright(m, i) & 1) = 1))")
    by_subset = inner.join(outer.where(few).select("outer", F.explode(each).alias("inner")), "inner").select("inner", "outer")
    many = outer.where(~few)
    counts = stored(many.select(F.explode("outer").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), name="counts")
    # a set's word that the fewest of the others have; one that none has comes before all
    asked = inner.select("inner", F.explode("inner").alias("word")).join(small(counts), "word", "left").fillna(0, ["n"])
    rarest = asked.groupBy("inner").agg(F.min(F.struct("n", "word")).alias("r")).select("inner", "r.*").where(F.col("n") > 0)
    salts = F.ceil(F.col("n") / ROWS_A_SALT).cast("int")
    rarest = rarest.select("inner", "word", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    held = many.select("outer", F.explode("outer").alias("word")).join(small(counts), "word")
    held = held.select("outer", "word", F.pmod(F.xxhash64("outer"), salts).cast("int").alias("salt"))
    by_word = rarest.join(held, ["word", "salt"]).where(F.size(F.array_except("inner", "outer")) == 0)
    return by_subset.unionByName(by_word.select("inner", "outer"))


def met(names: DataFrame, texts: DataFrame) -> DataFrame:
    """asked, held: the distinct sets of words of names (asked) and labels (held) of which one lies within the other; a written table."""
    asked = stored(names.select("asked").where(F.size("asked") > 0).distinct(), name="names")
    held = stored(texts.select("held").where(F.size("held") > 0).distinct(), name="labels")
    narrow = within(asked.select(F.col("asked").alias("inner")), held.select(F.col("held").alias("outer"))).toDF("asked", "held")
    wide = within(held.select(F.col("held").alias("inner")), asked.select(F.col("asked").alias("outer"))).toDF("held", "asked")
    return stored(narrow.unionByName(wide.where(F.col("asked") != F.col("held"))), name="met")


def texts_of(label: Column, aliases: Column) -> Column:
    """The distinct sets of words of a known entity's label and aliases."""
    names = F.array_compact(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.transform(names, words), lambda s: F.size(s) > 0))


def candidates(entities: DataFrame, known: DataFrame) -> DataFrame:
    """entity, name, kind, qid: known entities of which a label or alias holds all words of a name, or the other way round.

    ``entities``: entity, name, kind. ``known``: qid, label, aliases. A row a pair: ``candidate_counts`` counts without them.
    """
    named = entities.select("entity", "name", "kind", words(F.col("name")).alias("asked"))
    texts = stored(known.select("qid", F.explode(texts_of(F.col("label"), F.col("aliases"))).alias("held")).distinct(), name="texts")
    pairs = met(named, texts).join(texts, "held").select("asked", "qid").distinct()
    return named.join(pairs, "asked").drop("asked")


def candidate_counts(entities: DataFrame, known: DataFrame) -> DataFrame:
    """entity, n, first for each row of ``entities`` that has ``candidates``: how many, and the least qid. Copies are counted, not paired."""
    named = entities.select("entity", words(F.col("name")).alias("asked"))
    held = known.select("qid", F.explode(texts_of(F.col("label"), F.col("aliases"))).alias("held"))
    # known entities with the same sets of words are found by the same names
    alike = held.groupBy("qid").agg(F.sort_array(F.collect_set("held")).alias("sets")).groupBy("sets").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("first"))
    alike = stored(alike.select("*", F.monotonically_increasing_id().alias("nr")), name="alike")
    texts = alike.select("nr", "n", "first", F.explode("sets").alias("held"))
    pairs = met(named, texts).join(texts, "held").select("asked", "nr", "n", "first").distinct()
    return named.join(pairs.groupBy("asked").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "asked").select("entity", "n", "first")


def best_candidates(names: DataFrame, known: DataFrame) -> DataFrame:
    """low, kind, b (score, sitelinks, qid): of each name (low: trimmed, in lower case; kind) the best candidate.

    Known entities that are alike in all that a score reads are one, by the least qid of theirs.
    """
    text, lower = F.col("label"), F.lower(F.trim("label"))
    described = F.length(F.coalesce("description", F.lit(""))) > 10
    rows = known.where(F.col("qid").isNotNull()).select("qid", lower.alias("label"), "aliases", "instance_of", "sitelinks", described.alias("described"), texts_of(text, F.col("aliases")).alias("sets"))
    alike = rows.groupBy("label", "aliases", "instance_of", "sitelinks", "described", "sets").agg(F.min("qid").alias("qid"))
    texts = stored(alike.select("qid", F.struct("label", "aliases", "instance_of", "sitelinks", "described").alias("c"), F.explode("sets").alias("held")), name="texts")
    asked = stored(names.select("low", "kind", words(F.col("low")).alias("asked")).distinct(), name="asked")
    scored = asked.join(met(asked, texts), "asked").join(texts, "held").withColumn("score", F.round(score(F.col("low"), F.col("kind")), 9))
    return scored.groupBy("low", "kind").agg(F.min(F.struct(-F.col("score"), -F.col("c.sitelinks"), "qid", "score", F.col("c.sitelinks").alias("sitelinks"))).alias("b"))


def resolved(entities: DataFrame, known: DataFrame, answers: DataFrame) -> DataFrame:
    """entity, qid, label, description, confidence, method, and best (the highest score) for each entity.

    ``entities``: entity, name, kind. ``known``: qid, label, description, aliases, instance_of, sitelinks. ``answers``: entity, qid,
    confidence of a model that was asked. method: skipped_junk, skipped_blocklist, no_candidates, heuristic (sure, no person, and
    known well), llm (an answer that is sure enough), llm_low_confidence, llm_rejected (it answered: none), below_threshold.
    """
    low = F.lower(F.trim("name"))
    skip = F.when(junk(F.col("name")), "skipped_junk").when(low.isin(*BLOCKED), "skipped_blocklist")
    # kind as a key of joins: null and empty are scored alike
    e = stored(entities.select("entity", "name", "kind", low.alias("low"), F.coalesce("kind", F.lit("")).alias("of"), skip.alias("skip")), name="entities")
    best = best_candidates(e.where("skip IS NULL").select("low", F.col("of").alias("kind")), known).withColumnRenamed("kind", "of")
    d = e.join(best, ["low", "of"], "left").join(answers.select("entity", F.col("qid").alias("answer"), F.col("confidence").alias("sure"), F.lit(True).alias("asked")), "entity", "left")
    unseen = (F.col("b.score") >= SURE) & (F.col("kind") != "Person") & (F.coalesce("b.sitelinks", F.lit(0)) >= KNOWN)
    heard = F.coalesce("asked", F.lit(False)) & (F.col("b.score") > WORTH_ASKING)
    accepted = heard & F.col("answer").isNotNull() & F.coalesce(F.col("sure") >= LEAST_CONFIDENCE, F.lit(False))
    method = (
        F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("b").isNull(), "no_candidates").when(unseen, "heuristic").when(accepted, "llm")
        .when(heard, F.when(F.col("answer").isNotNull(), "llm_low_confidence").otherwise("llm_rejected")).otherwise("below_threshold")
    )
    d = d.withColumn("method", method)
    qid = F.when(F.col("method") == "heuristic", F.col("b.qid")).when(F.col("method") == "llm", F.col("answer"))
    confidence = F.when(F.col("method") == "heuristic", F.col("b.score")).when(F.col("method") == "llm", F.col("sure")).otherwise(0.0)
    d = d.select("entity", "low", qid.alias("qid"), confidence.alias("confidence"), "method", F.col("b.score").alias("best"))
    # an answer's details only if it is one of the candidates
    detail = known.select(F.col("qid").alias("known"), "label", "description", texts_of(F.col("label"), F.col("aliases")).alias("sets"))
    own = words(F.col("low"))
    inside = F.exists("sets", lambda s: (F.size(F.array_except(own, s)) == 0) | (F.size(F.array_except(s, own)) == 0)) & (F.size(own) > 0)
    return d.join(detail, (F.col("qid") == F.col("known")) & inside, "left").select("entity", "qid", "label", "description", "confidence", "method", "best")
