"""Queries that choose: assets that a text really mentions, places, and the entity that a name stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources.items import ITEMS_SQL, items
from .registry import registry

Q, SQL, query = registry()


@query(
    "location_pick_G12",
    f"""WITH {ITEMS_SQL}, c AS (
        SELECT id, n, 'Place ' || ((id + n * 5) % 37) AS name, ((id * 7 + n * 13) % 10) / 10.0e0 AS confidence FROM items, range(3) t(n)),
    g AS (SELECT DISTINCT location AS name, min(latitude) AS lat, min(longitude) AS lon FROM items WHERE location IS NOT NULL AND longitude IS NOT NULL AND id % 37 <> 3 GROUP BY location),
    r AS (SELECT c.id, c.name, c.confidence, row_number() OVER (PARTITION BY c.id ORDER BY c.confidence DESC, c.n) AS k, count(*) OVER (PARTITION BY c.id) AS n FROM c JOIN g USING (name) WHERE confidence >= 0.3)
    SELECT id, name AS primary_place, confidence, n - 1 AS others FROM r WHERE k = 1""",
)
def location_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    found = i.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.struct(
        F.concat(F.lit("Place "), ((F.col("id") + n * 5) % 37).cast("string")).alias("name"), (((F.col("id") * 7 + n * 13) % 10) / 10.0).alias("confidence"),
    ))).alias("n", "p")).select("id", "n", "p.*")
    gazetteer = i.where(F.col("location").isNotNull() & F.col("longitude").isNotNull() & (F.col("id") % 37 != 3)).groupBy(F.col("location").alias("name")).agg(F.min("latitude").alias("lat"))
    return R.chosen_places(found, gazetteer).select("id", "primary_place", "confidence", "others")


@query(
    "assets_G11",
    """WITH m AS (
        SELECT doc_id, t.ticker, t.name, ((doc_id * 3 + t.k) % 25) / 10.0e0 - 1.2e0 AS raw,
            contains(lower(text), lower(t.name)) AS mentioned FROM documents, (VALUES ('AAA', 'tion', 0), ('BTC', 'ough', 1), ('ZZZ', 'quux', 2), ('GC=F', 'ent', 3)) t(ticker, name, k))
    SELECT doc_id, ticker, greatest(-1.0e0, least(1.0e0, raw)) AS sentiment, ticker IN ('AAA', 'BTC') AS tracked FROM m WHERE mentioned""",
)
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = [("AAA", "tion", 0), ("BTC", "ough", 1), ("ZZZ", "quux", 2), ("GC=F", "ent", 3)]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(n).alias("name"), F.lit(k).alias("k")) for t, n, k in named]))
    found = docs.select("doc_id", "text", each.alias("a")).select("doc_id", "text", "a.ticker", "a.name", (((F.col("doc_id") * 3 + F.col("a.k")) % 25) / 10.0 - 1.2).alias("sentiment"))
    return R.mentioned_assets(found, ["AAA", "BTC"]).select("doc_id", "ticker", "sentiment", "tracked")


@query(
    "locations_G12",
    f"""WITH {ITEMS_SQL}, c AS (SELECT id, n, 'Place ' || ((id + n * 5) % 37) AS name, ((id * 7 + n * 13) % 10) / 10.0e0 AS confidence FROM items, range(4) t(n)),
    g AS (SELECT location AS name, min(latitude) AS latitude, min(longitude) AS longitude FROM items WHERE location IS NOT NULL AND id % 37 % 5 <> 3 GROUP BY location),
    o AS (SELECT c.id, c.name, g.latitude, g.longitude, row_number() OVER (PARTITION BY c.id ORDER BY confidence DESC, n) AS k FROM c LEFT JOIN g USING (name) WHERE confidence >= 0.3),
    f AS (SELECT id, bool_or(k = 1 AND (latitude IS NOT NULL OR longitude IS NOT NULL)) AS own FROM o GROUP BY id),
    r AS (SELECT o.*, f.own, row_number() OVER (PARTITION BY o.id ORDER BY k) AS j FROM o JOIN f USING (id) WHERE CASE WHEN k = 1 THEN own ELSE latitude IS NOT NULL AND longitude IS NOT NULL END),
    w AS (SELECT id, max(name) FILTER (WHERE j = 1) AS location, max(latitude) FILTER (WHERE j = 1) AS latitude, max(longitude) FILTER (WHERE j = 1) AS longitude, array_to_string(list(name ORDER BY j) FILTER (WHERE j > 1), '|') AS others FROM r GROUP BY id)
    SELECT f.id, w.location, w.latitude, w.longitude, coalesce(w.others, '') AS others, NOT f.own AND w.id IS NOT NULL AS promoted FROM f LEFT JOIN w ON w.id = f.id""",
)
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    place = lambda n: F.struct(F.concat(F.lit("Place "), ((F.col("id") + n * 5) % 37).cast("string")).alias("name"), (((F.col("id") * 7 + n * 13) % 10) / 10.0).alias("confidence"))
    found = i.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), place)).alias("n", "p")).select("id", "n", "p.*")
    gazetteer = i.where(F.col("location").isNotNull() & (F.col("id") % 37 % 5 != 3)).groupBy(F.col("location").alias("name")).agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    return R.placed_items(found, gazetteer).withColumn("others", F.array_join("others", "|"))


#: Tracked tickers of the query, by the first letters of words.
_NAMES = {"INTE": "Inte Corp", "ATIO": "Atio Inc", "THER": "Ther Group", "EDIN": "Edin Fund"}
#: A reply's asset for a word ``w`` at ``i`` of a text, in words that Spark and DuckDB share.
_ASSET = {
    "ticker": "CASE WHEN i % 13 = 12 THEN '' WHEN i % 7 = 5 THEN upper(substring(w, 1, 3)) || '-USD' ELSE upper(substring(w, 1, 4)) END", "name": "CASE WHEN i % 4 > 0 THEN w END",
    "sentiment": "CASE WHEN i % 11 > 0 THEN ((doc_id * 3 + i) % 25) / 10.0e0 - 1.2e0 END",
    "context": "CASE i % 7 WHEN 0 THEN 'Not mentioned in the text' WHEN 1 THEN 'implied' WHEN 2 THEN 'discussed: ' || w WHEN 3 THEN ' ab ' WHEN 4 THEN 'told at length' END",
    "mentions": "CASE i % 4 WHEN 0 THEN {a}w{z} WHEN 1 THEN {a}'n/a', ' '{z} WHEN 2 THEN {a}'none', w{z} END",
}
_A = ", ".join(f"{e.format(a='[', z=']')} AS {c}" for c, e in _ASSET.items())
_NOT = R.NOT_MENTIONED.replace("(?i)", "")


@query(
    "reply_assets_G11",
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{6,}}', 0) AS every FROM documents),
    u AS (SELECT doc_id, unnest(every) AS w, generate_subscripts(every, 1) - 1 AS i FROM w), a AS (SELECT doc_id, i, i % 2 = 0 AS first_list, {_A} FROM u),
    n(ticker, full_name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items())}),
    k AS (SELECT a.*, n.full_name, n.ticker IS NOT NULL AS is_tracked FROM a LEFT JOIN n ON n.ticker = a.ticker WHERE (n.ticker IS NOT NULL) = first_list AND a.ticker <> ''
        AND NOT regexp_matches(coalesce(context, ''), '{_NOT}', 'i') AND (len(list_filter(coalesce(mentions, []), lambda m: trim(m) <> '' AND NOT regexp_matches(m, '{_NOT}', 'i'))) > 0 OR length(trim(coalesce(context, ''))) > 3)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_tracked ORDER BY i) AS k FROM k)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY is_tracked DESC, i)::INTEGER AS place, ticker, coalesce(name, full_name) AS name, greatest(-1.0e0, least(1.0e0, coalesce(sentiment, 0.0e0))) AS sentiment,
        array_to_string(coalesce(mentions, [ticker]), '|') AS mentions, CASE WHEN is_tracked THEN NULL WHEN contains(ticker, '-USD') THEN 'crypto' WHEN length(ticker) = 3 AND ticker LIKE '%Y' THEN 'etf' ELSE 'stock' END AS asset_type, is_tracked
    FROM r WHERE is_tracked OR k <= {R.MOST_DISCOVERED}""",
)
def reply_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ", ".join(f"'{c}', {e.format(a='array(', z=')')}" for c, e in _ASSET.items())
    replies = docs.selectExpr("doc_id", rf"transform(regexp_extract_all(lower(text), '[a-z]{{6,}}', 0), (w, i) -> named_struct('i', i, {fields})) AS all")
    halves = replies.selectExpr("doc_id", "filter(all, a -> a.i % 2 = 0) AS tracked", "filter(all, a -> a.i % 2 = 1) AS discovered")
    each = halves.select("doc_id", F.posexplode(R.reply_assets(F.col("tracked"), F.col("discovered"), _NAMES)).alias("place", "a"))
    return each.select("doc_id", (F.col("place") + 1).alias("place"), "a.ticker", "a.name", "a.sentiment", F.array_join("a.mentions", "|").alias("mentions"), "a.asset_type", "a.is_tracked")


_CANDIDATES = """WITH e AS (SELECT p_partkey AS entity, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Person' ELSE 'Organization' END AS kind FROM part),
c AS (SELECT e.*, t.n, e.entity * 10 + t.n AS candidate, CASE t.n WHEN 0 THEN e.name WHEN 1 THEN e.name || ' group' ELSE 'other' END AS label, (e.entity * 7 + t.n * 31) % 80 AS links, (e.entity + t.n) % 2 = 0 AS right_kind, t.n = 0 AS by_label FROM e, range(3) t(n)),
s AS (SELECT *, greatest(0.0e0, least(1.0e0, CASE WHEN lower(name) = lower(label) THEN 0.3e0 WHEN contains(lower(label), lower(name)) OR contains(lower(name), lower(label)) THEN 0.15e0 ELSE 0.0e0 END
    + CASE WHEN right_kind THEN 0.25e0 ELSE -0.1e0 END + CASE WHEN kind = 'Person' AND NOT right_kind THEN -0.2e0 ELSE 0.0e0 END + CASE WHEN links > 50 THEN 0.1e0 WHEN links > 20 THEN 0.05e0 ELSE 0.0e0 END
    + CASE WHEN by_label THEN 0.05e0 ELSE 0.0e0 END)) AS score FROM c)"""


@query(
    "resolve_heuristic_G8",
    f"""{_CANDIDATES}, b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, links DESC, candidate) AS k FROM s)
    SELECT entity, candidate, round(score, 6) AS score, CASE WHEN kind <> 'Person' AND links >= 5 AND score >= 0.65 THEN 'accepted' WHEN score >= 0.4 THEN 'needs review' ELSE 'below threshold' END AS verdict FROM b WHERE k = 1""",
)
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "Person").otherwise("Organization").alias("kind"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    )
    c = e.select(
        "*", (F.col("entity") * 10 + F.col("n")).alias("candidate"),
        F.when(F.col("n") == 0, F.col("name")).when(F.col("n") == 1, F.concat("name", F.lit(" group"))).otherwise("other").alias("label"),
        ((F.col("entity") * 7 + F.col("n") * 31) % 80).alias("links"), ((F.col("entity") + F.col("n")) % 2 == 0).alias("right_kind"), (F.col("n") == 0).alias("by_label"),
    )
    return R.resolved(c, accept=0.65).select("entity", "candidate", F.round("score", 6).alias("score"), "verdict")
