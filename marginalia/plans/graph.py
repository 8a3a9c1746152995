"""Queries of relationships and of the graph that they project to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import graph as G
from ..sources.items import ITEMS_SQL, items
from .registry import registry
from .text import _JUNK, _NAME, SLUG, TOKEN

Q, SQL, query = registry()


def _either(a: str, b: str) -> str:
    return f"trim(CASE WHEN nested THEN json_extract_string(raw, '{a}') WHEN flat THEN json_extract_string(raw, '{b}') END)"


RAW = f"""{ITEMS_SQL},
raw AS (
    SELECT id, updated_at, x[1] AS raw, x[2]::INTEGER AS n FROM (
        SELECT id, updated_at, unnest(list_zip(j, range(len(j)))) AS x FROM (SELECT id, updated_at, json_extract(relationships, '$[*]') AS j FROM items))
),
shaped AS (
    SELECT *, json_extract_string(raw, '$.source.name') IS NOT NULL AND json_extract_string(raw, '$.target.name') IS NOT NULL AND json_extract_string(raw, '$.type') IS NOT NULL AS nested,
        json_extract_string(raw, '$.source') IS NOT NULL AND json_extract_string(raw, '$.target') IS NOT NULL AND json_extract_string(raw, '$.relationship') IS NOT NULL AS flat FROM raw
),
rels AS (
    SELECT id, updated_at, n, {_either("$.source.name", "$.source")} AS subject, {_either("$.source.type", "$.sourceType")} AS subject_type,
        {_either("$.target.name", "$.target")} AS object, {_either("$.target.type", "$.targetType")} AS object_type, {_either("$.type", "$.relationship")} AS label,
        try_cast(json_extract_string(raw, '$.confidence') AS DOUBLE) AS confidence, coalesce(json_extract_string(raw, '$.claim_mode'), 'asserted') AS claim_mode
    FROM shaped
)"""

_VALUES = ", ".join(f"('{t}', '{p}', {str(r).lower()})" for t, p, r in G.predicate_tokens())
_PAIRS = ", ".join(f"('{p}', '{s}', '{o}')" for p, s, o in G.type_pairs())
_ALIAS = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in G.TYPE_ALIASES.items())
_TYPE = r"CASE lower(regexp_replace(trim({0}), '[\s_-]+', ' ', 'g')) " + _ALIAS + " ELSE CASE WHEN trim({0}) IN (" + ", ".join(f"'{x}'" for x in G.ENTITY_TYPES) + ") THEN trim({0}) END END"

NORMAL = f"""WITH {RAW},
tokens(token, predicate, reverse) AS (VALUES {_VALUES}), pairs(predicate, s, o) AS (VALUES {_PAIRS}),
named AS (
    SELECT r.id, r.n, t.predicate, claim_mode, greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) AS confidence0, confidence, coalesce(t.reverse, false) AS back,
        {_NAME.format("r.subject")} AS a, {_NAME.format("r.object")} AS b, {_TYPE.format("r.subject_type")} AS ta, {_TYPE.format("r.object_type")} AS tb
    FROM rels r LEFT JOIN tokens t ON t.token = {TOKEN.format("r.label")}
),
turned AS (
    SELECT id, n, predicate, claim_mode, CASE WHEN confidence IS NOT NULL THEN confidence0 END AS confidence, CASE WHEN back THEN b ELSE a END AS subject,
        CASE WHEN back THEN tb ELSE ta END AS s, CASE WHEN back THEN a ELSE b END AS object, CASE WHEN back THEN ta ELSE tb END AS o FROM named
),
judged AS (
    SELECT t.*, CASE WHEN t.predicate IS NULL OR t.s IS NULL OR t.o IS NULL OR subject = '' OR object = '' THEN 'missing' WHEN lower(subject) = lower(object) THEN 'self'
        WHEN {{junk_s}} OR {{junk_o}} THEN 'junk' WHEN p.predicate IS NULL THEN 'types' END AS reject
    FROM turned t LEFT JOIN pairs p ON p.predicate = t.predicate AND p.s = t.s AND p.o = t.o
)"""
_junk = lambda c: "(length({0}) < 2 OR lower({0}) IN ({1}) OR {2})".format(c, ", ".join(f"'{x}'" for x in T.JUNK_NAMES), _JUNK.replace("regexp_matches(n,", f"regexp_matches({c},"))
NORMAL = NORMAL.replace("{junk_s}", _junk("subject")).replace("{junk_o}", _junk("object"))


@query("rel_normalise_G1", f"{NORMAL} SELECT id, n, subject, s AS subject_type, predicate, object, o AS object_type, confidence, claim_mode, reject FROM judged")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalised(spark, items(spark, sf_dir))


@query("type_pair_J13", f"{NORMAL} SELECT predicate, s AS subject_type, o AS object_type, count(*) AS n FROM judged WHERE reject IS NULL GROUP BY ALL")
def type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.normalised(spark, items(spark, sf_dir)).where(F.col("reject").isNull())
    return kept.groupBy("predicate", "subject_type", "object_type").agg(F.count(F.lit(1)).alias("n"))


@query("rel_modes_A13", f"{NORMAL} SELECT coalesce(reject, 'kept') AS verdict, claim_mode, count(*) AS n FROM judged GROUP BY ALL")
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.normalised(spark, items(spark, sf_dir)).groupBy(F.coalesce("reject", F.lit("kept")).alias("verdict"), "claim_mode").agg(F.count(F.lit(1)).alias("n"))


_KIND = """CASE WHEN lower(coalesce({1}, '')) IN ('technology', 'product') THEN CASE WHEN regexp_matches({0}, '(?i)(gpt|claude|llama|gemini|mistral|qwen|bert|t5|whisper|embedding)') THEN 'Model' ELSE 'Tool' END
    WHEN lower(coalesce({1}, '')) IN ('person', 'organization', 'location', 'tool', 'project', 'dataset', 'model', 'artwork') THEN upper(substring({1}, 1, 1)) || lower(substring({1}, 2)) ELSE 'Unknown' END"""
_PROV = "lower(coalesce({0}, '')) NOT IN ('person', 'organization', 'location', 'technology', 'tool', 'project', 'dataset', 'model', 'artwork')"
_KEY = "lower({0}) || ':' || coalesce(nullif(" + SLUG.replace("{0}", "{1}") + ", ''), substring(sha1({1}), 1, 12))"
PROJECTED = f"""WITH {RAW},
kinds AS (
    SELECT *, {TOKEN.format("label")} AS predicate, {_KIND.format("subject", "subject_type")} AS sk, {_KIND.format("object", "object_type")} AS ok,
        {_PROV.format("subject_type")} AS sp, {_PROV.format("object_type")} AS op FROM rels
),
keyed AS (SELECT *, {_KEY.format("sk", "subject")} AS subject_key, {_KEY.format("ok", "object")} AS object_key FROM kinds WHERE subject <> '' AND object <> '' AND predicate <> ''),
projected AS (SELECT *, 'claim:' || sha1(concat_ws('|', subject_key, predicate, object_key)) AS claim_key FROM keyed)"""


@query(
    "graph_entities_G5",
    f"""{PROJECTED}, sides AS (
        SELECT subject_key AS entity_key, subject AS name, sk AS kind, sp AS provisional, updated_at, id, n, 0 AS side FROM projected
        UNION ALL SELECT object_key, object, ok, op, updated_at, id, n, 1 FROM projected)
    SELECT entity_key, name, kind, provisional, mentions FROM (
        SELECT *, count(*) OVER (PARTITION BY entity_key) AS mentions, row_number() OVER (PARTITION BY entity_key ORDER BY updated_at DESC, id DESC, n, side) AS k FROM sides) WHERE k = 1""",
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entities(items(spark, sf_dir))


CLAIMS = f"""{PROJECTED}, claims AS (
    SELECT claim_key, subject_key, predicate, object_key, claim_mode, id AS first_item, support FROM (
        SELECT *, count(*) OVER (PARTITION BY claim_key) AS support, row_number() OVER (PARTITION BY claim_key ORDER BY updated_at DESC, id DESC, n) AS k FROM projected) WHERE k = 1)"""


@query("graph_claims_G5", f"{CLAIMS} SELECT * FROM claims")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.claims(items(spark, sf_dir))


EVIDENCE = f"""{PROJECTED}, edges AS (
    SELECT 'item:' || id AS document_key, 'ASSERTS' AS edge_kind, 'claim' AS target_kind, claim_key AS target_key, n::VARCHAR AS extra FROM projected
    UNION ALL SELECT 'item:' || id, 'MENTIONS', 'entity', subject_key, 'source:' || n FROM projected UNION ALL SELECT 'item:' || id, 'MENTIONS', 'entity', object_key, 'target:' || n FROM projected)"""


@query("graph_evidence_G5", f"{EVIDENCE} SELECT 'evidence:' || sha1(concat_ws('|', document_key, edge_kind, target_kind, target_key, extra)) AS evidence_key, document_key, edge_kind, target_kind, target_key FROM edges")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence(items(spark, sf_dir))


@query(
    "graph_summary_G6",
    f"""{CLAIMS} SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM projected) AS projected, (SELECT count(*) FROM rels) - (SELECT count(*) FROM projected) AS malformed,
    (SELECT count(DISTINCT k) FROM (SELECT subject_key AS k FROM projected UNION SELECT object_key FROM projected)) AS entities, (SELECT count(*) FROM claims) AS claims, 3 * (SELECT count(*) FROM projected) AS evidence""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    raw = i.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size(F.from_json("relationships", "array<string>"))).alias("raw"))
    made = G.projection(i).agg(F.count(F.lit(1)).alias("projected"), F.count_distinct("claim_key").alias("claims"))
    named = G.entities(i).agg(F.count(F.lit(1)).alias("entities"))
    one = lambda df: df.withColumn("k", F.lit(1))
    joined = one(raw).join(one(made), "k").join(one(named), "k")
    return joined.select("items", "projected", (F.col("raw") - F.col("projected")).alias("malformed"), "entities", "claims", (3 * F.col("projected")).alias("evidence"))


_NODE = "coalesce(nullif({0}, ''), 'Unknown') || '::' || lower({1})"


@query(
    "nodes_G7",
    f"""WITH {RAW}, ends AS (
        SELECT id, {_NODE.format("subject_type", "subject")} AS node, 1 AS outs FROM rels WHERE subject <> '' AND object <> ''
        UNION ALL SELECT id, {_NODE.format("object_type", "object")}, 0 FROM rels WHERE subject <> '' AND object <> '')
    SELECT node, count(*) AS degree, sum(1 - outs)::BIGINT AS ins, sum(outs)::BIGINT AS outs, count(DISTINCT id) AS items FROM ends GROUP BY node""",
)
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(items(spark, sf_dir))


@query(
    "edges_G7",
    f"""WITH {RAW}, e AS (SELECT id, lower(subject) AS subject, {TOKEN.format("label")} AS predicate, lower(object) AS object FROM rels WHERE subject <> '' AND object <> '')
    SELECT subject, predicate, object, count(*) AS weight, count(DISTINCT id) AS items, array_to_string(list_slice(list_sort(list(DISTINCT id)), 1, 5), '|') AS examples FROM e GROUP BY ALL""",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(items(spark, sf_dir))


@query("derived_edges_Q8", f"{CLAIMS} SELECT subject_key, predicate, object_key, support, claim_key FROM claims WHERE support >= 2")
def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    backed = G.evidence(i).where(F.col("edge_kind") == "ASSERTS").groupBy(F.col("target_key").alias("claim_key")).agg(F.count(F.lit(1)).alias("support"))
    return G.claims(i).drop("support").join(backed, "claim_key").where(F.col("support") >= 2).select("subject_key", "predicate", "object_key", "support", "claim_key")


@query(
    "entity_context_J3",
    f"""{CLAIMS}, ways AS (
        SELECT subject_key AS entity_key, 'subject' AS side, predicate, object_key AS neighbour, support, claim_key FROM claims
        UNION ALL SELECT object_key, 'object', predicate, subject_key, support, claim_key FROM claims)
    SELECT entity_key, side, predicate, neighbour, support FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, side ORDER BY support DESC, claim_key) AS k FROM ways) WHERE k <= 10""",
)
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contexts(items(spark, sf_dir))


#: The graph of an earlier day, against which today's evidence is held.
EARLIER = "2024-01-03 00:00:00"
_OLD = f"""old AS (SELECT * FROM projected WHERE id IN (SELECT id FROM items WHERE created_at < TIMESTAMP '{EARLIER}')),
known AS (SELECT subject_key AS target_key FROM old UNION SELECT object_key FROM old UNION SELECT claim_key FROM old)"""
_KEYED = "SELECT 'evidence:' || sha1(concat_ws('|', document_key, edge_kind, target_kind, target_key, extra)) AS evidence_key, document_key, edge_kind, target_kind, target_key FROM edges"


@query("unresolved_J1", f"{EVIDENCE}, {_OLD}, e AS ({_KEYED}) SELECT * FROM e WHERE target_key NOT IN (SELECT target_key FROM known)")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    old = i.where(F.col("created_at") < F.lit(EARLIER).cast("timestamp_ntz"))
    return G.unresolved(G.evidence(i), G.entities(old), G.claims(old))


@query(
    "evidence_targets_J2",
    f"""{EVIDENCE}, e AS ({_KEYED}),
    names AS (SELECT entity_key, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY updated_at DESC, id DESC, n, side) AS k FROM (
        SELECT subject_key AS entity_key, subject AS name, sk AS kind, updated_at, id, n, 0 AS side FROM projected UNION ALL SELECT object_key, object, ok, updated_at, id, n, 1 FROM projected)) WHERE k = 1),
    made AS (SELECT DISTINCT claim_key, predicate FROM projected)
    SELECT e.*, names.name, names.kind, made.predicate FROM e LEFT JOIN names ON entity_key = target_key AND target_kind = 'entity' LEFT JOIN made ON claim_key = target_key AND target_kind = 'claim'""",
)
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return G.targets(G.evidence(i), G.entities(i), G.claims(i))


@query(
    "graph_documents_G5",
    f"""{PROJECTED} SELECT 'item:' || id AS document_key, id, item_id, nullif(url, '') AS url, nullif(title, '') AS title, 'item' AS document_kind, source, published_at, created_at AS captured_at, updated_at
    FROM items WHERE id IN (SELECT id FROM projected)""",
)
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.documents(items(spark, sf_dir, "url"))


@query(
    "graph_backfill_G6",
    f"""{CLAIMS} SELECT claim_key, predicate, first_item, CASE WHEN claim_key IN (SELECT claim_key FROM projected WHERE id IN (SELECT id FROM items WHERE created_at < TIMESTAMP '{EARLIER}')) THEN 'kept' ELSE 'added' END AS state FROM claims""",
)
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of an earlier day brought up to date: claims that it had take today's values, the others are added."""
    i = items(spark, sf_dir)
    old = G.claims(i.where(F.col("created_at") < F.lit(EARLIER).cast("timestamp_ntz")))
    now = C.upsert(old.withColumn("age", F.lit(1)), G.claims(i).withColumn("age", F.lit(0)), "claim_key", F.col("age"))
    state = F.when(F.col("had").isNotNull(), "kept").otherwise("added").alias("state")
    return now.join(old.select("claim_key", F.lit(True).alias("had")), "claim_key", "left").select("claim_key", "predicate", "first_item", state)


_EARLY = f"(SELECT id FROM items WHERE created_at < TIMESTAMP '{EARLIER}')"
_SIDES = "SELECT subject_key AS entity_key, subject AS name, sk AS kind, sp AS provisional, updated_at, id, n, 0 AS side FROM {0} UNION ALL SELECT object_key, object, ok, op, updated_at, id, n, 1 FROM {0}"
_ENTITIES = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity_key) AS mentions, row_number() OVER (PARTITION BY entity_key ORDER BY updated_at DESC, id DESC, n, side) AS k FROM ({0})) WHERE k = 1)"
_CLAIMED = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY claim_key) AS support, row_number() OVER (PARTITION BY claim_key ORDER BY updated_at DESC, id DESC, n) AS k FROM {0}) WHERE k = 1)"
_STATE = lambda old, same: f"CASE WHEN {old} IS NULL THEN 'added' WHEN {same} THEN 'same' ELSE 'changed' END"


@query(
    "graph_tables_G6",
    f"""{EVIDENCE}, early AS (SELECT * FROM projected WHERE id IN {_EARLY}), e AS ({_KEYED}),
    now_e AS (SELECT * FROM {_ENTITIES.format(_SIDES.format("projected"))}), old_e AS (SELECT * FROM {_ENTITIES.format(_SIDES.format("early"))}),
    now_c AS (SELECT * FROM {_CLAIMED.format("projected")}), old_c AS (SELECT * FROM {_CLAIMED.format("early")}),
    t AS (
        SELECT 'documents' AS name, 'item:' || id AS key, {_STATE("o", "true")} AS state, NULL AS a, NULL AS b FROM (SELECT DISTINCT id, CASE WHEN id IN {_EARLY} THEN 1 END AS o FROM projected)
        UNION ALL SELECT 'entities', entity_key, {_STATE("o.name", "o.name = n.name AND o.kind = n.kind AND o.provisional = n.provisional AND o.mentions = n.mentions")}, NULL, NULL FROM now_e n LEFT JOIN old_e o USING (entity_key)
        UNION ALL SELECT 'claims', claim_key, {_STATE("o.id", "o.claim_mode = n.claim_mode AND o.id = n.id AND o.support = n.support")}, n.subject_key, n.object_key FROM now_c n LEFT JOIN old_c o USING (claim_key)
        UNION ALL SELECT 'evidence', evidence_key, {_STATE("o", "true")}, document_key, target_key FROM (SELECT *, CASE WHEN replace(document_key, 'item:', '')::BIGINT IN {_EARLY} THEN 1 END AS o FROM e))
    SELECT name, key, md5(key) AS row_id, state, md5(a) AS a_id, md5(b) AS b_id, CASE WHEN state = 'added' THEN 2 ELSE 1 END AS first_written, CASE WHEN state = 'same' THEN 1 ELSE 2 END AS last_written FROM t""",
)
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables of an earlier day brought up to date: each row's id, state, what it points to, and which writing it is from."""
    from ..operators import backfill as B

    i = items(spark, sf_dir, "url")
    old = B.brought_up(i.where(F.col("created_at") < F.lit(EARLIER).cast("timestamp_ntz")), "2024-01-01")
    now = B.brought_up(i, "2024-01-02", old)
    none, links = F.lit(None).cast("string"), {"claims": ("subject_id", "object_id"), "evidence": ("document_id", "target_id")}
    out = None
    for name, rows in now.items():
        a, b = (F.col(c) for c in links[name]) if name in links else (none, none)
        one = rows.select(F.lit(name).alias("name"), F.col(B.KEYS[name]).alias("key"), "row_id", "state", a.alias("a_id"), b.alias("b_id"), F.dayofmonth("first_written").alias("first_written"), F.dayofmonth("last_written").alias("last_written"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "node_sources_A14",
    f"""WITH {RAW}, ends AS (SELECT id, {_NODE.format("subject_type", "subject")} AS node FROM rels WHERE subject <> '' AND object <> '' UNION ALL SELECT id, {_NODE.format("object_type", "object")} FROM rels WHERE subject <> '' AND object <> '')
    SELECT node, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM ends JOIN items USING (id) GROUP BY node""",
)
def node_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_sources(items(spark, sf_dir)).select("node", F.array_join("sources", "|").alias("sources"))


@query(
    "co_occurring_J3",
    f"""{CLAIMS}, names AS (SELECT entity_key AS neighbour, name FROM {_ENTITIES.format(_SIDES.format("projected"))}),
    ways AS (SELECT subject_key AS entity_key, 0 AS side, object_key AS neighbour, support, claim_key FROM claims UNION ALL SELECT object_key, 1, subject_key, support, claim_key FROM claims),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, side ORDER BY support DESC, claim_key) AS k FROM ways) WHERE k <= 10),
    firsts AS (SELECT entity_key, name, min(side * 1000 + k) AS place FROM ranked JOIN names USING (neighbour) GROUP BY ALL)
    SELECT entity_key, string_agg(name, '|' ORDER BY place) AS names FROM firsts GROUP BY entity_key""",
)
def co_occurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_occurring(items(spark, sf_dir)).select("entity_key", F.array_join("names", "|").alias("names"))
