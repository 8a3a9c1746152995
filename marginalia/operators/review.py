"""Batches for review: hosts by family, content that can't be judged, and the newest few of each bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.stored import stored
from .related import small

#: Families of hosts, in the order in which they are tried.
FAMILIES = {
    "news": (
        "nytimes.com", "theguardian.com", "wired.com", "bloomberg.com", "propublica.org", "washingtonpost.com", "theatlantic.com", "npr.org", "apnews.com", "cnn.com", "latimes.com",
        "404media.co", "nysfocus.com", "newyorker.com", "vox.com", "nbcnews.com",
    ),
    "codeResearch": ("github.com", "arxiv.org", "nature.com", "huggingface.co", "npmjs.com", "medium.com"),
    "reference": ("en.wikipedia.org", "lesswrong.com", "reddit.com"),
}

#: Hosts that are passed over (wherever the name stands in a host, or in a block's url), and what marks a broken page or an image.
PASSED_OVER, BLOCKS_PASSED_OVER = ("youtube.com", "youtu.be", "x.com", "twitter.com"), ("youtube.com", "youtu.be", "twitter.com", "x.com", "reddit.com")
LEAST_CONTENT, BROKEN = 180, "error processing "
FOOTER = r"(^|\s)(about press copyright contact us creators advertise developers)(\s|$)"
IMAGE_NAME, MEDIA_URL = r"\.(png|jpe?g|gif|webp)(\?|$)", r"\.(png|jpe?g|gif|webp|mp4|mov)(\?|$)"
PER_BUCKET, NEWEST_BOOKMARKS, NEWEST_BLOCKS = 4, 350, 250


def suffixes(host: Column) -> Column:
    """A host and all domains above it, longest first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def with_family(df: DataFrame, host: str, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with family and its domain: those of the longest listed domain that ``host`` is or lies below; null for others.

    Each row meets the list by equality, once for each domain above its host; of a domain in several families the first
    family counts. A null or empty host has none.
    """
    spark, seen = df.sparkSession, {}
    for family, domains in families.items():
        for domain in domains:
            seen.setdefault(domain, family)
    listed = F.broadcast(spark.createDataFrame(list(seen.items()), "_domain string, _family string"))  # the list is fixed
    hosts = df.select(F.col(host).alias("_host")).where(F.coalesce(F.col(host) != "", F.lit(False))).distinct()
    met = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("_domain")).join(listed, "_domain")
    best = met.groupBy("_host").agg(F.max_by(F.struct(F.col("_family").alias("family"), F.col("_domain").alias("domain")), F.length("_domain")).alias("_best"))
    best = small(stored(best, name="hosts"))  # most archives have few hosts, and one may have most rows: then nothing is shuffled
    return df.join(best, F.col(host) == F.col("_host"), "left").select(*df.columns, "_best.family", "_best.domain")


def thin_or_broken(content: Column) -> Column:
    text = F.coalesce(content, F.lit(""))
    return (F.length(text) < LEAST_CONTENT) | F.lower(text).startswith(BROKEN) | F.lower(text).rlike(FOOTER)


def image_name(title: Column, content: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))).rlike(IMAGE_NAME)


def media_url(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(MEDIA_URL)


def holds_any(c: Column, names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(F.coalesce(c, F.lit("")), F.lit(n))
    return out


def newest_in(df: DataFrame, bucket: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each bucket by ``order``, with their place. Every task passes on ``n`` rows a bucket at most."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("place") <= n)


def review_batch(items: DataFrame, per_bucket: int = PER_BUCKET, families: Mapping[str, Sequence[str]] = FAMILIES) -> DataFrame:
    """bucket, place, id, host: the newest ``per_bucket`` items of each family of hosts (bookmarks), and of blocks with text.

    ``items``: id, source, url, title, content, updated_at. As much as the newest NEWEST_BOOKMARKS bookmarks and NEWEST_BLOCKS blocks
    with content are looked through. A bookmark's host has to be one of a family's own; hosts in which a passed-over name
    stands anywhere are left out, whatever their family.
    """
    order = [F.col("updated_at").desc(), F.col("id").desc()]
    newest = lambda source, n: items.where((F.col("source") == source) & F.col("content").isNotNull()).orderBy(*order).limit(n)
    host = T.host(F.col("url")).alias("host")
    marks = newest("pinboard", NEWEST_BOOKMARKS).select("*", host).where(~thin_or_broken(F.col("content")) & (F.col("host") != "") & ~holds_any(F.col("host"), PASSED_OVER))
    own = with_family(marks.select("id", "updated_at", "host"), "host", families).where(F.col("domain") == F.col("host")).withColumn("bucket", F.col("family"))
    blocks = newest("arena", NEWEST_BLOCKS).select("*", host)
    text = blocks.where(
        ~thin_or_broken(F.col("content")) & ~image_name(F.col("title"), F.col("content")) & ~media_url(F.col("url")) & ~holds_any(F.col("url"), BLOCKS_PASSED_OVER) & F.col("content").rlike(r"\s")
    )
    both = own.select("bucket", "id", "updated_at", "host").unionByName(text.select(F.lit("arenaText").alias("bucket"), "id", "updated_at", "host"))
    return newest_in(both, "bucket", per_bucket, *order).select("bucket", "place", "id", "host")
