"""Queries of records that arrive as JSON, which the queries write into the test tables' rows first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.items import table
from .registry import registry

Q, SQL, query = registry()

#: Locations of documents, as texts, objects, and objects cut short; latitudes that are missing or 0.
LOCATIONS = """doc_id, CASE doc_id % 7 WHEN 0 THEN concat('{"location": "Place ', doc_id % 37, '", "latitude": ', doc_id % 90, '.5, "longitude": 0}') WHEN 1 THEN '{"location": "", "latitude": "12.25", "longitude": -3}'
    WHEN 2 THEN concat('{"latitude": ', doc_id % 50, '}') WHEN 3 THEN '{"location": "cut' WHEN 4 THEN NULL WHEN 5 THEN '{"location": "two"} {}' ELSE concat('Place ', doc_id % 11) END AS location,
    CASE doc_id % 3 WHEN 0 THEN 0.0e0 WHEN 1 THEN doc_id % 80 + 0.25e0 END AS latitude, CASE WHEN doc_id % 4 = 0 THEN 7.5e0 END AS longitude"""


@query(
    "location_json_N6",
    f"""WITH d AS (SELECT {LOCATIONS} FROM documents), v AS (SELECT *, CASE WHEN starts_with(location, '{{') AND json_valid(location) THEN location::JSON END AS j FROM d)
    SELECT doc_id, CASE WHEN j IS NOT NULL THEN nullif(j->>'$.location', '') ELSE location END AS location,
        CASE WHEN j IS NOT NULL AND nullif(latitude, 0) IS NULL THEN coalesce(nullif(try_cast(j->>'$.latitude' AS DOUBLE), 0), latitude) ELSE latitude END AS latitude,
        CASE WHEN j IS NOT NULL AND nullif(longitude, 0) IS NULL THEN coalesce(nullif(try_cast(j->>'$.longitude' AS DOUBLE), 0), longitude) ELSE longitude END AS longitude,
        CASE WHEN starts_with(location, '{{') THEN j IS NOT NULL END AS fixed FROM v""",
)
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placed(table(spark, sf_dir, "documents").selectExpr(*_split(LOCATIONS)))


def _split(columns: str) -> list[str]:
    """The columns of a select list, parted at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


#: An entity of each part, with members missing in some; replies of three parts each, some of them broken.
ENTITY = """concat('"Q', p_partkey, '": ', CASE p_partkey % 8 WHEN 0 THEN '{"missing": ""}' WHEN 1 THEN 'null' ELSE concat('{"labels": {', CASE WHEN p_partkey % 5 > 0 THEN concat('"en": {"language": "en", "value": "', p_name, '"}, ') ELSE '' END,
    '"fr": {"value": "x"}}, ', CASE WHEN p_partkey % 3 = 0 THEN concat('"descriptions": {"en": {"value": "', p_type, '"}}, ') ELSE '' END,
    '"aliases": {"en": [', CASE WHEN p_partkey % 2 = 0 THEN concat('{"value": "', p_brand, '"}, {"value": "', p_type, '"}, {"language": "en"}') ELSE '' END, ']}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q', p_size, '"}}}}, {"mainsnak": {"snaktype": "novalue"}}',
    CASE WHEN p_partkey % 7 = 0 THEN ', {"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}' ELSE '' END, ']}', CASE WHEN p_partkey % 4 > 0 THEN ', "sitelinks": {"enwiki": {"title": "a"}, "dewiki": {"title": "b"}}' ELSE '' END, '}') END)"""


@query(
    "wikidata_N11",
    f"""WITH e AS (SELECT p_partkey, {ENTITY} AS one FROM part), g AS (SELECT p_partkey // 3 AS id, '{{"entities": {{' || string_agg(one, ', ' ORDER BY p_partkey) || '}}' || CASE WHEN p_partkey // 3 % 11 = 0 THEN '' ELSE '}}' END AS reply FROM e GROUP BY p_partkey // 3),
    k AS (SELECT id, reply::JSON AS r, unnest(json_keys(reply, '$.entities')) AS qid FROM g WHERE json_valid(reply)),
    v AS (SELECT id, qid, json_extract(r, '$.entities.' || qid) AS e FROM k)
    SELECT id, qid, coalesce(e->>'$.labels.en.value', '') AS label, coalesce(e->>'$.descriptions.en.value', '') AS description,
        array_to_string(list_filter(json_extract_string(e, '$.aliases.en[*].value'), lambda a: a IS NOT NULL), '|') AS aliases,
        array_to_string(list_filter(json_extract_string(e, '$.claims.P31[*].mainsnak.datavalue.value.id'), lambda a: coalesce(a, '') <> ''), '|') AS instance_of,
        coalesce(len(json_keys(e, '$.sitelinks')), 0)::BIGINT AS sitelinks FROM v WHERE json_type(e) = 'OBJECT' AND NOT json_exists(e, '$.missing')""",
)
def wikidata(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey div 3 AS id", f"{ENTITY} AS one")
    lists = one.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "one"))), lambda x: x["one"]), ", ").alias("all"))
    replies = lists.select("id", F.concat(F.lit('{"entities": {'), "all", F.lit("}"), F.when(F.col("id") % 11 == 0, "").otherwise("}")).alias("reply"))
    found = R.entities(replies)
    return found.withColumns({c: F.array_join(c, "|") for c in ("aliases", "instance_of")})


#: Pages with linked data: a node, a list, graphs, and scripts that are cut or of another type.
LINKED = """concat(html, CASE page_id % 7
    WHEN 0 THEN concat('<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Place", "name": "Hall ', page_id, '", "address": {"addressLocality": "Town ', page_id % 5, '"}, "geo": {"latitude": ', page_id % 60, '.5, "longitude": "4.25"}}</script>')
    WHEN 1 THEN concat('<SCRIPT id="x" TYPE=''application/ld+json''>[{"@type": "Person", "name": "A"}, {"@type": "Event", "name": "B", "location": {"address": {"addressLocality": "Town ', page_id % 3, '"}}}, 7, {"@type": "Shop", "address": "Main Street ', page_id, '"}]</script >')
    WHEN 2 THEN concat('<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "WebSite"}, {"@type": ["Place", "Shop"], "name": "G", "geo": {"latitude": "no number"}}, {"@graph": [], "geo": null}, {"geo": {"longitude": ', page_id % 90, '}}]}</script><script>{"geo": 1}</script>')
    WHEN 3 THEN '<script type="application/ld+json">{"geo": {"latitude": 1}</script>' WHEN 4 THEN '<script type="application/ld+json">{"address": {"streetAddress": "x"}}</script><script type="application/ld+json">{"@graph": {"geo": 1}, "geo": {"latitude": 2}}</script>' ELSE '' END)"""


@query(
    "linked_data_L10",
    rf"""WITH s AS (SELECT page_id, unnest(x) AS s FROM (SELECT page_id, regexp_extract_all({LINKED}, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script\s*>', 1) AS x FROM pages)),
    n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id) - 1 AS i, s FROM (SELECT page_id, s FROM s WHERE json_valid(s))),
    tops AS (SELECT page_id, i || '.0' AS "at", s::JSON AS v FROM n WHERE json_type(s) = 'OBJECT' UNION ALL SELECT page_id, i || '.' || k, json_extract(s, '$[' || k || ']') FROM n, unnest(range(json_array_length(s)::BIGINT)) AS t(k) WHERE json_type(s) = 'ARRAY'),
    nodes AS (SELECT page_id, "at" || '.0' AS "at", v FROM tops WHERE json_type(v) = 'OBJECT' AND coalesce(json_type(v, '$."@graph"'), '') <> 'ARRAY'
        UNION ALL SELECT page_id, "at" || '.' || k, json_extract(v, '$."@graph"[' || k || ']') FROM tops, unnest(range(json_array_length(v, '$."@graph"')::BIGINT)) AS t(k) WHERE json_type(v) = 'OBJECT' AND json_type(v, '$."@graph"') = 'ARRAY')
    SELECT page_id, "at", v->>'$."@type"' AS kind, v->>'$.name' AS name, coalesce(v->>'$.address.addressLocality', v->>'$.location.address.addressLocality', CASE WHEN json_type(v, '$.address') = 'VARCHAR' THEN v->>'$.address' END) AS locality,
        try_cast(v->>'$.geo.latitude' AS DOUBLE) AS latitude, try_cast(v->>'$.geo.longitude' AS DOUBLE) AS longitude
    FROM nodes WHERE json_type(v) = 'OBJECT' AND (coalesce(json_type(v, '$.address'), 'NULL') <> 'NULL' OR coalesce(json_type(v, '$.location'), 'NULL') <> 'NULL' OR coalesce(json_type(v, '$.geo'), 'NULL') <> 'NULL')""",
)
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.linked_nodes(table(spark, sf_dir, "pages").select("page_id", F.expr(LINKED).alias("html")))


#: Rows whose columns are empty where their metadata may know better.
METADATA = """event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE event_id % 6 WHEN 0 THEN concat('{"href": "https://a.example/', event_id, '", "type": "t', user_id % 4, '", "toread": "yes", "shared": true}')
    WHEN 1 THEN props WHEN 2 THEN concat('{"href": null, "type": "x", "shared": "false", "meta": {"n": ', user_id, '}}') WHEN 3 THEN '{"href": "cut' WHEN 4 THEN '{"href": 7, "shared": "maybe", "meta": {"n": "many"}}' END AS metadata"""
FIELDS = {"url": ("$.href", "string"), "kind": ("$.type", "string"), "shared": ("$.shared", "boolean"), "n": ("$.meta.n", "long")}


@query(
    "backfill_P20",
    f"""WITH e AS (SELECT {METADATA} FROM events), v AS (SELECT *, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS j FROM e)
    SELECT event_id, coalesce(kind, j->>'$.type') AS kind, j->>'$.href' AS url, try_cast(j->>'$.shared' AS BOOLEAN) AS shared, try_cast(j->>'$.meta.n' AS BIGINT) AS n FROM v""",
)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(*_split(METADATA))
    return R.backfilled(rows, "metadata", FIELDS).select("event_id", "kind", "url", "shared", "n")
