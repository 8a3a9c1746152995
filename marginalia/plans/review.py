"""Queries of review batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as R
from ..sources.items import ITEMS_SQL, items
from .registry import registry
from .text import HOST

Q, SQL, query = registry()

#: Hosts of items: most are one site's; others of each family, below a family's host, near to one, passed over, or none at all.
HOSTS = """CASE WHEN doc % 20 < 11 THEN 'www.github.com' ELSE CASE doc % 20 WHEN 11 THEN 'NYTimes.com' WHEN 12 THEN 'cooking.nytimes.com' WHEN 13 THEN 'en.wikipedia.org' WHEN 14 THEN 'fr.wikipedia.org' WHEN 15 THEN 'vox.com'
    WHEN 16 THEN 'old.reddit.com' WHEN 17 THEN 'notgithub.com' WHEN 18 THEN 'www.youtube.com' ELSE 'reddit.com' END END"""
URL = f"CASE WHEN doc % 33 = 5 THEN NULL WHEN doc % 31 = 7 THEN 'not a url' ELSE concat('https://', {HOSTS}, '/p/', doc, CASE WHEN doc % 9 = 1 THEN '.JPG?w=1' ELSE '' END) END"
CONTENT = "CASE doc % 17 WHEN 3 THEN concat('Error processing ', text) WHEN 5 THEN concat(text, ' About Press Copyright Contact us Creators Advertise Developers ') WHEN 8 THEN 'photo.png' WHEN 9 THEN concat(text, ' see a.gif') ELSE text END"

#: Families whose domains overlap: the longest one decides.
OVERLAPPING = {"everything": ("com", "org"), **R.FAMILIES, "wikis": ("wikipedia.org", "en.wikipedia.org"), "food": ("cooking.nytimes.com",)}
_LISTED = ", ".join(f"('{d}', '{f}', {i})" for i, (f, ds) in enumerate(OVERLAPPING.items()) for d in ds)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda e: F.expr(e.replace("doc", "id").replace("text", "content"))
    return items(spark, sf_dir).select("id", "source", "updated_at", "title", made(CONTENT).alias("content"), made(URL).alias("url"))


_SQL = f"WITH {ITEMS_SQL}, s AS (SELECT id, source, updated_at, title, {CONTENT.replace('doc', 'id').replace('text', 'content')} AS content, {URL.replace('doc', 'id')} AS url FROM items)"


@query(
    "domain_family_L8",
    f"""{_SQL}, h AS (SELECT id, {HOST.format("url")} AS host FROM s), listed(domain, family, nr) AS (VALUES {_LISTED}),
    m AS (SELECT host, family, domain, row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC, nr) AS k FROM (SELECT DISTINCT host FROM h) JOIN listed ON host = domain OR ends_with(host, '.' || domain))
    SELECT id, h.host, family, domain FROM h LEFT JOIN m ON m.host = h.host AND k = 1""",
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_family(sites(spark, sf_dir).select("id", T.host(F.col("url")).alias("host")), "host", OVERLAPPING)


_any = lambda c, names: "(" + " OR ".join(f"contains(coalesce({c}, ''), '{n}')" for n in names) + ")"
_THIN = f"(length(content) < {R.LEAST_CONTENT} OR starts_with(lower(content), '{R.BROKEN}') OR regexp_matches(lower(content), '{R.FOOTER}'))"


@query(
    "review_batch_G22",
    f"""{_SQL}, h AS (SELECT *, {HOST.format("url")} AS host, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, id DESC) AS newest FROM s WHERE content IS NOT NULL),
    listed(domain, bucket) AS (VALUES {", ".join(f"('{d}', '{f}')" for f, ds in R.FAMILIES.items() for d in ds)}),
    b AS (SELECT bucket, id, updated_at, host FROM h JOIN listed ON domain = host WHERE source = 'pinboard' AND newest <= {R.NEWEST_BOOKMARKS} AND NOT {_THIN} AND NOT {_any("host", R.PASSED_OVER)}
        UNION ALL SELECT 'arenaText', id, updated_at, host FROM h WHERE source = 'arena' AND newest <= {R.NEWEST_BLOCKS} AND NOT {_THIN} AND NOT regexp_matches(lower(title || ' ' || content), '{R.IMAGE_NAME}')
            AND NOT regexp_matches(lower(coalesce(url, '')), '{R.MEDIA_URL}') AND NOT {_any("url", R.BLOCKS_PASSED_OVER)} AND regexp_matches(content, '\\s'))
    SELECT bucket, place, id, host FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY updated_at DESC, id DESC)::INTEGER AS place FROM b) WHERE place <= {R.PER_BUCKET}""",
)
def review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_batch(sites(spark, sf_dir))


@query("content_checks_F44", f"{_SQL} SELECT id, {_THIN} AS thin, regexp_matches(lower(title || ' ' || content), '{R.IMAGE_NAME}') AS image, regexp_matches(lower(coalesce(url, '')), '{R.MEDIA_URL}') AS media FROM s")
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"thin": R.thin_or_broken(F.col("content")), "image": R.image_name(F.col("title"), F.col("content")), "media": R.media_url(F.col("url"))}
    return sites(spark, sf_dir).select("id", *[c.alias(k) for k, c in checks.items()])
