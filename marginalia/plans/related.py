"""Queries for related items: seeds are the items whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import related as R
from ..sources.items import AS_OF, ITEMS_SQL, items
from .registry import registry

Q, SQL, query = registry()


def seeds(all_items: DataFrame) -> DataFrame:
    return all_items.where(F.col("id") % 50 == 0)


WINDOW = f"published_at > TIMESTAMP '{AS_OF}' - INTERVAL {R.DAYS} DAY"
OVERLAPS = f"""shared_tags AS (
    SELECT s.id AS seed_id, i.id, i.published_at, len(list_filter(i.tags, lambda t: list_contains(s.tags, t)))::BIGINT AS overlap
    FROM (SELECT id, tags FROM items WHERE id % 50 = 0) s JOIN items i ON i.id <> s.id WHERE i.{WINDOW}
        AND len(list_filter(i.tags, lambda t: list_contains(s.tags, t))) >= {R.LEAST_OVERLAP}
)"""
BY_TAGS = f"WITH {ITEMS_SQL}, {OVERLAPS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY overlap DESC, published_at DESC, id) AS rank FROM shared_tags)"


def far(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))"
    return f"2 * {M.EARTH_MILES}::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0::DOUBLE, 1 - {h})))"


def cos(a: str, b: str) -> str:
    d = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
    return f"coalesce({d.format(a, b)} / nullif(sqrt({d.format(a, a)}) * sqrt({d.format(b, b)}), 0), 0)"


@query("related_tags_G9a", f"{BY_TAGS} SELECT seed_id, id, overlap, rank::INTEGER AS rank FROM ranked WHERE rank <= 50")
def by_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.by_tags(seeds(i), i, AS_OF).select("seed_id", "id", "overlap", "rank")


@query(
    "related_embedding_G9b",
    f"""WITH {ITEMS_SQL}, pairs AS (
        SELECT s.id AS seed_id, i.id, i.published_at, {cos("s.embedding", "i.embedding")} AS similarity
        FROM (SELECT id, embedding FROM items WHERE id % 50 = 0 AND embedding IS NOT NULL) s JOIN items i ON i.id <> s.id AND i.embedding IS NOT NULL WHERE i.{WINDOW}
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(similarity, 9) DESC, published_at DESC, id) AS rank FROM pairs WHERE similarity > 0.2)
    SELECT seed_id, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM ranked WHERE rank <= 50""",
)
def by_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir, "embedding")
    return R.by_embedding(seeds(i), i, AS_OF, least=0.2).select("seed_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "related_hybrid_G9c",
    f"""{BY_TAGS}, scored AS (
        SELECT r.seed_id, r.id, r.published_at, r.overlap, {cos("s.embedding", "i.embedding")} AS similarity
        FROM ranked r JOIN items s ON s.id = r.seed_id JOIN items i ON i.id = r.id WHERE r.rank <= 40
    ), best AS (SELECT *, overlap / 10.0::DOUBLE * 0.4::DOUBLE + similarity * 0.6::DOUBLE AS score FROM scored),
    placed AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 9) DESC, published_at DESC, id) AS place FROM best)
    SELECT seed_id, id, overlap, round(similarity, 6) AS similarity, round(score, 6) AS score, place::INTEGER AS rank FROM placed WHERE place <= 20""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.hybrid(seeds(i), i, AS_OF, 20, items(spark, sf_dir, "embedding").select("id", "embedding")).select("seed_id", "id", "overlap", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


NEAR = f"""near AS (
    SELECT s.id AS seed_id, i.id, {far("s", "i")} AS miles FROM (SELECT * FROM items WHERE id % 50 <> 51) s JOIN items i ON i.id <> s.id
    WHERE s.latitude IS NOT NULL AND s.longitude IS NOT NULL AND i.latitude IS NOT NULL AND i.longitude IS NOT NULL AND {far("s", "i")} <= {R.MILES}
)"""
SEED_NEAR = NEAR.replace("id % 50 <> 51", "id % 50 = 0")


@query("nearby_J10", f"WITH {ITEMS_SQL}, {SEED_NEAR} SELECT seed_id, id, round(miles, 6) AS miles FROM near")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.near_by(seeds(i), i).select("seed_id", "id", F.round("miles", 6).alias("miles"))


@query(
    "thread_candidates_G10",
    f"""{BY_TAGS}, {SEED_NEAR}, placed AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(miles, 9), id) AS place FROM near),
    both_ways AS (SELECT seed_id, id, 0 AS way, rank AS place FROM ranked WHERE rank <= 10 UNION ALL SELECT seed_id, id, 1, place FROM placed WHERE place <= 3),
    firsts AS (SELECT seed_id, id, way, place FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, id ORDER BY way, place) AS n FROM both_ways) WHERE n = 1),
    best AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY way, place) AS rank FROM firsts)
    SELECT seed_id, id, CASE WHEN way = 0 THEN 'tags' ELSE 'place' END AS found_by, rank::INTEGER AS rank FROM best WHERE rank <= 5""",
)
def thread_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.threads(seeds(i), i, AS_OF)


@query(
    "haversine_M1",
    f"WITH {ITEMS_SQL}, c AS (SELECT 40.5::DOUBLE AS latitude, -74.5::DOUBLE AS longitude) SELECT i.id, round({far('c', 'i')}, 6) AS miles FROM items i, c",
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.round(M.haversine_miles(F.lit(40.5), F.lit(-74.5), F.col("latitude"), F.col("longitude")), 6).alias("miles"))


@query(
    "cosine_M2",
    f"WITH v AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, round({cos('e.embedding', 'v.embedding')}, 6) AS similarity FROM embeddings e, v",
)
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = e.where("vec_id = 0").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("first"))
    return e.withColumn("asked", F.lit(0).cast("long")).join(F.broadcast(one), "asked").select("vec_id", F.round(M.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


@query(
    "themes_Q4",
    f"""{BY_TAGS}, tags AS (SELECT r.seed_id, t.tag, count(*) AS n FROM (SELECT * FROM ranked WHERE rank <= 50) r JOIN items i ON i.id = r.id, unnest(i.tags) AS t(tag) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY n DESC, tag) AS rank FROM tags) SELECT seed_id, tag, n, rank::INTEGER AS rank FROM best WHERE rank <= 3""",
)
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.common_tags(R.by_tags(seeds(i), i, AS_OF), i)


@query(
    "discovery_rate_Q1",
    f"WITH {ITEMS_SQL}, {OVERLAPS} SELECT count(DISTINCT seed_id) AS found, (SELECT count(*) FROM items WHERE id % 50 = 0 AND len(tags) >= 2) AS seeds FROM shared_tags",
)
def discovery_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    s = seeds(i).where(F.size("tags") >= 2)
    hit = s.select("id").join(R.overlap_sums(seeds(i), i, AS_OF).select(F.col("seed_id").alias("id")), "id", "left_semi")
    return s.select("id").withColumn("one", F.lit(0)).unionByName(hit.withColumn("one", F.lit(1))).agg(F.sum("one").alias("found"), F.count_if(F.col("one") == 0).alias("seeds"))


@query(
    "strength_M10",
    f"""{BY_TAGS} SELECT seed_id, count(*) AS n, CASE WHEN avg(overlap / 10.0::DOUBLE) >= 0.8 THEN 'strong' WHEN avg(overlap / 10.0::DOUBLE) >= 0.5 THEN 'medium' WHEN avg(overlap / 10.0::DOUBLE) >= 0.3 THEN 'weak' ELSE 'minimal' END AS strength
    FROM ranked WHERE rank <= 50 GROUP BY seed_id""",
)
def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return R.by_tags(seeds(i), i, AS_OF).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), M.strength(F.avg(F.col("overlap") / 10.0)).alias("strength"))


@query(
    "tag_draft_Q3",
    f"""WITH {ITEMS_SQL}, pairs AS (SELECT s.id AS seed_id, i.id, i.published_at, len(list_intersect(i.concept_tags, s.concept_tags))::BIGINT AS overlap
        FROM (SELECT id, concept_tags FROM items WHERE id % 50 = 0) s JOIN items i ON i.id <> s.id AND list_has_any(i.concept_tags, s.concept_tags) WHERE i.{WINDOW}),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY overlap DESC, published_at DESC, id) AS rank FROM pairs) SELECT seed_id, id, overlap, rank::INTEGER AS rank FROM r WHERE rank <= 50""",
)
def tag_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 recent items that share most tags with a seed, tags as sets, one of them being enough."""
    i = items(spark, sf_dir).select("id", "published_at", F.col("concept_tags").alias("tags"))
    return R.by_tags(seeds(i), i, AS_OF, least=1).select("seed_id", "id", "overlap", "rank")
