"""Relationships of items: normalisation against the ontology, and their projection to entities, claims and evidence."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: The ontology. Types of entities, and names that stand for them.
ENTITY_TYPES = ("Person", "Organization", "Project", "Movement", "Artwork", "Tool", "Model", "Dataset", "Location")
TYPE_ALIASES = {
    "person": "Person", "organization": "Organization", "org": "Organization", "project": "Project", "movement": "Movement", "artwork": "Artwork", "art": "Artwork",
    "tool": "Tool", "technology": "Tool", "product": "Tool", "software": "Tool", "model": "Model", "dataset": "Dataset", "data": "Dataset", "location": "Location",
    "place": "Location",
}
#: predicate: types of the subject, types of the object, aliases, aliases of the reverse. Of an alias of two, the later one counts.
PREDICATES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "WORKS_FOR": (("Person",), ("Organization",), ("EMPLOYED_BY", "EMPLOYEE_OF", "STAFF_AT"), ()),
    "LEADS": (("Person",), ("Organization", "Project", "Movement"), ("HEADS", "DIRECTS", "CHAIRS", "RUNS"), ()),
    "FOUNDED": (("Person",), ("Organization", "Project", "Movement", "Tool", "Model", "Artwork"), ("FOUNDER_OF", "CO_FOUNDED", "COFOUNDED"), ()),
    "MEMBER_OF": (("Person",), ("Organization", "Project", "Movement"), ("BELONGS_TO",), ()),
    "ADVISES": (("Person",), ("Organization", "Project", "Movement"), ("ADVISOR_TO", "CONSULTS_FOR"), ()),
    "FUNDS": (("Person", "Organization"), ("Organization", "Project", "Movement", "Artwork", "Dataset", "Tool", "Model"), (), ("FUNDED_BY", "BACKED_BY", "SUPPORTED_BY", "SPONSORED_BY")),
    "DONATES_TO": (("Person", "Organization"), ("Organization", "Project", "Movement", "Artwork"), ("CONTRIBUTES_TO", "GIVES_TO"), ("RECEIVED_DONATION_FROM",)),
    "INVESTS_IN": (("Person", "Organization"), ("Organization", "Project", "Tool", "Model", "Dataset"), ("INVESTED_INTO",), ("INVESTMENT_FROM", "RAISED_FROM")),
    "CONTRACTS_WITH": (("Organization", "Project"), ("Organization", "Project"), ("SIGNED_CONTRACT_WITH", "IN_CONTRACT_WITH"), ()),
    "PARTNERS_WITH": (("Organization", "Project", "Movement"), ("Organization", "Project", "Movement"), ("COLLABORATES_WITH",), ()),
    "OWNS": (("Person", "Organization"), ("Organization", "Tool", "Model", "Dataset", "Artwork", "Project"), ("ACQUIRED", "PURCHASED"), ("OWNED_BY", "ACQUIRED_BY")),
    "CONTROLS": (("Person", "Organization"), ("Organization", "Project", "Tool", "Model", "Dataset"), ("OVERSEES", "MANAGES"), ("CONTROLLED_BY",)),
    "OPERATES": (("Person", "Organization"), ("Project", "Tool", "Dataset", "Location"), ("RUNS", "MAINTAINS"), ("OPERATED_BY",)),
    "DEVELOPS": (("Person", "Organization"), ("Tool", "Model", "Dataset", "Project"), ("BUILDS",), ("DEVELOPED_BY", "BUILT_BY")),
    "CREATED": (("Person", "Organization"), ("Artwork",), ("CREATES", "AUTHORED", "MADE"), ("CREATED_BY", "AUTHORED_BY")),
    "USES": (("Person", "Organization", "Project", "Tool", "Model"), ("Tool", "Model", "Dataset"), ("USED",), ("USED_BY",)),
    "INTEGRATES_WITH": (("Tool", "Model"), ("Tool", "Model"), ("CONNECTS_TO",), ()),
    "HOSTED_ON": (("Tool", "Model", "Dataset"), ("Organization", "Tool"), (), ()),
    "LOCATED_IN": (ENTITY_TYPES, ("Location",), ("BASED_IN", "HEADQUARTERED_IN", "OPERATES_IN", "REGISTERED_IN"), ()),
    "INVESTIGATES": (("Person", "Organization", "Project"), ("Person", "Organization", "Project", "Movement", "Dataset", "Tool", "Model", "Location"), ("PROBES",), ()),
    "SUES": (("Person", "Organization"), ("Person", "Organization"), ("FILES_SUIT_AGAINST",), ("SUED_BY",)),
    "TARGETS": (("Person", "Organization", "Project"), ("Person", "Organization", "Project", "Movement", "Location"), (), ()),
    "APPROVES": (("Organization",), ("Organization", "Project", "Tool", "Model", "Dataset"), ("AUTHORIZED",), ("APPROVED_BY",)),
    "BANS": (("Organization",), ("Organization", "Tool", "Model", "Project", "Movement"), ("RESTRICTS",), ("BANNED_BY",)),
    "QUOTES": (("Organization", "Project"), ("Person", "Organization"), (), ()),
}


def predicate_tokens() -> list[tuple[str, str, bool]]:
    """(token, predicate, reversed) for each predicate, alias and reverse alias, the first of these that has a token."""
    out: dict[str, tuple[str, bool]] = {}
    for reverse in (True, False):
        out |= {a: (p, reverse) for p, x in PREDICATES.items() for a in x[3 if reverse else 2]}
    out |= {p: (p, False) for p in PREDICATES}
    return [(t, p, r) for t, (p, r) in sorted(out.items())]


def type_pairs() -> list[tuple[str, str, str]]:
    return [(p, s, o) for p, x in PREDICATES.items() for s in x[0] for o in x[1]]


def canonical_type(c: Column) -> Column:
    """The ontology's type that a name stands for, or null."""
    low = F.lower(F.regexp_replace(F.trim(c), r"[\s_-]+", " "))
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, low), F.when(F.trim(c).isin(*ENTITY_TYPES), F.trim(c)))


def exploded(items: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` (id, updated_at, published_at by default), n (place in the item's list), and the fields of each raw relationship of either shape.

    ``relationships``: a JSON array of objects, nested ({source: {name, type}, type, target}) or flat ({source, target,
    relationship, sourceType, targetType}). Of other elements and of missing names the fields are null or empty.
    """
    keep = keep or ("id", "updated_at", "published_at")
    raw = items.select(*keep, F.posexplode(F.from_json("relationships", "array<string>")).alias("n", "raw"))
    # each path is read once: the steps are columns, and not one expression; their names, $. first, are none of ``keep``
    paths = ("source.name", "target.name", "type", "source", "target", "relationship", "source.type", "sourceType", "target.type", "targetType", "confidence", "claim_mode", "evidence")
    raw = raw.select(*keep, "n", *[F.get_json_object("raw", f"$.{path}").alias(f"$.{path}") for path in paths])
    get = lambda path: F.col(f"`{path}`")
    whole = lambda *of: reduce(and_, [get(f"$.{path}").isNotNull() for path in of])
    raw = raw.withColumns({"is_nested": whole("source.name", "target.name", "type"), "is_flat": whole("source", "target", "relationship")})
    nested, flat = F.col("is_nested"), F.col("is_flat")
    either = lambda a, b: F.trim(F.when(nested, get(a)).when(flat, get(b)))
    return raw.select(
        *keep, "n", either("$.source.name", "$.source").alias("subject"), either("$.source.type", "$.sourceType").alias("subject_type"),
        either("$.target.name", "$.target").alias("object"), either("$.target.type", "$.targetType").alias("object_type"), either("$.type", "$.relationship").alias("label"),
        get("$.confidence").try_cast("double").alias("confidence"), F.coalesce(get("$.claim_mode"), F.lit("asserted")).alias("claim_mode"), get("$.evidence").alias("evidence"),
    )


def normalised(spark: SparkSession, items: DataFrame) -> DataFrame:
    """The raw relationships of ``items`` ``in_ontology``."""
    return in_ontology(spark, exploded(items), "id", "n").drop("evidence")


def in_ontology(spark: SparkSession, r: DataFrame, *keep: str) -> DataFrame:
    """Each ``exploded`` relationship in the ontology's terms, turned round if its label is a reverse one, with what is wrong in
    ``reject`` (null: kept): missing, self, junk or types, whichever comes first. ``keep``: other columns that stay."""
    tokens = F.broadcast(spark.createDataFrame(predicate_tokens(), "token string, predicate string, reverse boolean"))
    pairs = F.broadcast(spark.createDataFrame(type_pairs(), "predicate string, s string, o string").withColumn("allowed", F.lit(True)))
    r = r.withColumn("token", T.predicate_token(F.col("label"))).join(tokens, "token", "left")
    ends = ("subject", "object")
    r = r.withColumns({f"{k}_name": T.entity_name(F.col(k)) for k in ends} | {f"{k}_kind": canonical_type(F.col(f"{k}_type")) for k in ends})
    names, types = ({k: F.col(f"{k}_{what}") for k in ends} for what in ("name", "kind"))
    back = F.coalesce("reverse", F.lit(False))
    turned = r.select(
        *keep, "predicate", "claim_mode", "evidence", F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).alias("confidence"),
        F.when(back, names["object"]).otherwise(names["subject"]).alias("subject"), F.when(back, types["object"]).otherwise(types["subject"]).alias("s"),
        F.when(back, names["subject"]).otherwise(names["object"]).alias("object"), F.when(back, types["subject"]).otherwise(types["object"]).alias("o"),
    )
    judged = turned.join(pairs, ["predicate", "s", "o"], "left")
    missing = F.col("predicate").isNull() | F.col("s").isNull() | F.col("o").isNull() | (F.col("subject") == "") | (F.col("object") == "")
    reject = (
        F.when(missing, "missing").when(F.lower("subject") == F.lower("object"), "self")
        .when(T.junk_name(F.col("subject")) | T.junk_name(F.col("object")), "junk").when(F.col("allowed").isNull(), "types")
    )
    return judged.select(*keep, "subject", F.col("s").alias("subject_type"), "predicate", "object", F.col("o").alias("object_type"), "confidence", "claim_mode", "evidence", reject.alias("reject"))


#: Names that make a technology or a product a model.
MODEL_NAMES = "(?i)(gpt|claude|llama|gemini|mistral|qwen|bert|t5|whisper|embedding)"


def projected_type(raw: Column, name: Column) -> Column:
    """struct<kind, provisional> of an entity by the type that came with it."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    model = F.when(name.rlike(MODEL_NAMES), "Model").otherwise("Tool")
    kind = F.when(low.isin("technology", "product"), model).when(low.isin("person", "organization", "location", "tool", "project", "dataset", "model", "artwork"), F.initcap(low)).otherwise("Unknown")
    return F.struct(kind.alias("kind"), (~low.isin("person", "organization", "location", "technology", "tool", "project", "dataset", "model", "artwork")).alias("provisional"))


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), F.coalesce(F.nullif(T.slug(name), F.lit("")), F.substring(F.sha1(name), 1, 12)))


def projection(items: DataFrame) -> DataFrame:
    """The relationships that can be projected, with the keys of their entities and claims."""
    r = exploded(items).withColumn("predicate", T.predicate_token(F.col("label")))
    r = r.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("predicate") != ""))
    r = r.withColumns({"s": projected_type(F.col("subject_type"), F.col("subject")), "o": projected_type(F.col("object_type"), F.col("object"))})
    r = r.withColumns({"subject_key": entity_key(F.col("s.kind"), F.col("subject")), "object_key": entity_key(F.col("o.kind"), F.col("object"))})
    return r.withColumn("claim_key", F.concat(F.lit("claim:"), F.sha1(F.concat_ws("|", "subject_key", "predicate", "object_key"))))


def entities(items: DataFrame) -> DataFrame:
    """entity_key, name, kind, provisional: of an entity's mentions the first in the newest item counts.

    Found by an aggregate over ordered structs, so that a name that very many items mention needs no window.
    """
    p = projection(items)
    sides = p.select("updated_at", "id", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("subject_key").alias("key"), F.col("subject").alias("name"), F.col("s").alias("t")),
        F.struct(F.lit(1).alias("side"), F.col("object_key").alias("key"), F.col("object").alias("name"), F.col("o").alias("t")),
    )).alias("e"))
    newest = F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("u"), (-F.col("id")).alias("i"), "n", F.col("e.side"))
    first = sides.groupBy(F.col("e.key").alias("entity_key")).agg(F.min_by(F.struct("e.name", "e.t"), newest).alias("f"), F.count(F.lit(1)).alias("mentions"))
    return first.select("entity_key", F.col("f.name").alias("name"), F.col("f.t.kind").alias("kind"), F.col("f.t.provisional").alias("provisional"), "mentions")


def claims(items: DataFrame) -> DataFrame:
    """claim_key, its parts, claim_mode and first_item of the newest item that makes the claim, and how often it is made."""
    p = projection(items)
    newest = F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("u"), (-F.col("id")).alias("i"), "n")
    first = p.groupBy("claim_key", "subject_key", "predicate", "object_key").agg(F.min_by(F.struct("claim_mode", "id"), newest).alias("f"), F.count(F.lit(1)).alias("support"))
    return first.select("claim_key", "subject_key", "predicate", "object_key", F.col("f.claim_mode").alias("claim_mode"), F.col("f.id").alias("first_item"), "support")


def evidence(items: DataFrame) -> DataFrame:
    """Three rows for each projected relationship: it asserts its claim and mentions its two entities."""
    p = projection(items).withColumn("document_key", F.concat(F.lit("item:"), "id"))
    edge = lambda kind, target, key, extra: F.struct(F.lit(kind).alias("edge"), F.lit(target).alias("target"), F.col(key).alias("key"), extra.alias("extra"))
    n = F.col("n").cast("string")
    edges = p.select("document_key", F.explode(F.array(
        edge("ASSERTS", "claim", "claim_key", n), edge("MENTIONS", "entity", "subject_key", F.concat(F.lit("source:"), n)), edge("MENTIONS", "entity", "object_key", F.concat(F.lit("target:"), n)),
    )).alias("e"))
    key = F.concat(F.lit("evidence:"), F.sha1(F.concat_ws("|", "document_key", "e.edge", "e.target", "e.key", "e.extra")))
    return edges.select(key.alias("evidence_key"), "document_key", F.col("e.edge").alias("edge_kind"), F.col("e.target").alias("target_kind"), F.col("e.key").alias("target_key"))


def nodes(items: DataFrame) -> DataFrame:
    """node, degree, ins, outs, items: ends of relationships by type and lower-case name."""
    r = exploded(items).where((F.col("subject") != "") & (F.col("object") != ""))
    name = lambda t, c: F.concat(F.coalesce(F.nullif(F.col(t), F.lit("")), F.lit("Unknown")), F.lit("::"), F.lower(c))
    ends = r.select("id", F.explode(F.array(F.struct(name("subject_type", "subject").alias("node"), F.lit(1).alias("out")), F.struct(name("object_type", "object").alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum(1 - F.col("e.out")).alias("ins"), F.sum("e.out").alias("outs"), F.count_distinct("id").alias("items")
    )


def edges(items: DataFrame, examples: int = 5) -> DataFrame:
    """subject, predicate, object, weight, items and the first ``examples`` items of each edge, by id."""
    r = exploded(items).where((F.col("subject") != "") & (F.col("object") != ""))
    r = r.select("id", F.lower("subject").alias("subject"), T.predicate_token(F.col("label")).alias("predicate"), F.lower("object").alias("object"))
    each = r.groupBy("subject", "predicate", "object", "id").agg(F.count(F.lit(1)).alias("n"))
    key = ["subject", "predicate", "object"]
    totals = each.groupBy(*key).agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("items"))
    from pyspark.sql import Window as W

    first = each.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("id"))).where(F.col("k") <= examples)
    shown = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), "|").alias("examples"))
    return totals.join(shown, key)


def contexts(items: DataFrame, most: int = 10) -> DataFrame:
    """entity_key, side, predicate, neighbour: the ``most`` best supported claims of each entity as subject and as object."""
    c = claims(items)
    way = lambda side, own, other: c.select(F.col(own).alias("entity_key"), F.lit(side).alias("side"), "predicate", F.col(other).alias("neighbour"), "support", "claim_key")
    both = way("subject", "subject_key", "object_key").unionByName(way("object", "object_key", "subject_key"))
    from pyspark.sql import Window as W

    ranked = both.withColumn("k", F.row_number().over(W.partitionBy("entity_key", "side").orderBy(F.col("support").desc(), "claim_key")))
    return ranked.where(F.col("k") <= most).drop("k", "claim_key")


def co_occurring(items: DataFrame, most: int = 10) -> DataFrame:
    """entity_key, names: of an entity's ``most`` best supported claims as subject, then as object, the other ends' names, each once, in that order."""
    from pyspark.sql import Window as W

    c, named = claims(items), entities(items).select(F.col("entity_key").alias("neighbour"), "name")
    way = lambda side, own, other: c.select(F.col(own).alias("entity_key"), F.lit(side).alias("side"), F.col(other).alias("neighbour"), "support", "claim_key")
    both = way(0, "subject_key", "object_key").unionByName(way(1, "object_key", "subject_key"))
    ranked = both.withColumn("k", F.row_number().over(W.partitionBy("entity_key", "side").orderBy(F.col("support").desc(), "claim_key"))).where(F.col("k") <= most)
    told = ranked.join(named, "neighbour").groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct("side", "k", "name"))).alias("all"))  # 2 * most at the most
    return told.select("entity_key", F.array_distinct(F.transform("all", lambda x: x["name"])).alias("names"))


def node_sources(items: DataFrame) -> DataFrame:
    """node, sources: the sources, sorted, of the items that name each node of ``nodes``."""
    r = exploded(items, "id", "source").where((F.col("subject") != "") & (F.col("object") != ""))
    name = lambda t, c: F.concat(F.coalesce(F.nullif(F.col(t), F.lit("")), F.lit("Unknown")), F.lit("::"), F.lower(c))
    ends = r.select("source", F.explode(F.array(name("subject_type", "subject"), name("object_type", "object"))).alias("node"))
    return ends.groupBy("node").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def documents(items: DataFrame) -> DataFrame:
    """A row for each item with relationships that can be projected: its key and what is known of it (``items`` with url)."""
    used = projection(items).select(F.col("id").alias("used")).distinct()
    return items.join(used, F.col("id") == F.col("used"), "left_semi").select(
        F.concat(F.lit("item:"), "id").alias("document_key"), "id", "item_id", F.nullif("url", F.lit("")).alias("url"), F.nullif("title", F.lit("")).alias("title"),
        F.lit("item").alias("document_kind"), "source", "published_at", F.col("created_at").alias("captured_at"), "updated_at",
    )


def unresolved(evidence: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence whose entity or claim isn't in a graph; empty for the graph that was made with it."""
    known = entities.select(F.col("entity_key").alias("target_key")).unionByName(claims.select(F.col("claim_key").alias("target_key")))
    return evidence.join(known, "target_key", "left_anti")


def targets(evidence: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """``evidence`` with what it points to: name and kind of an entity or predicate of a claim, by target_kind."""
    key = F.col("target_key")
    named = entities.select(F.col("entity_key"), "name", "kind")
    made = claims.select(F.col("claim_key"), "predicate")
    to_entity = (key == F.col("entity_key")) & (F.col("target_kind") == "entity")
    to_claim = (key == F.col("claim_key")) & (F.col("target_kind") == "claim")
    return evidence.join(named, to_entity, "left").join(made, to_claim, "left").drop("entity_key", "claim_key")
