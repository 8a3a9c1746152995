"""Distances, similarities and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES, KM_PER_MILE = 3959.0, 1.609344


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The great-circle distance in miles; null where a coordinate is null."""
    h = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = h(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * h(lon2 - lon1)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_MILES) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where a vector is null or has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def overlap(tags: Column, wanted: Column) -> Column:
    """How many of ``tags`` are wanted, each as often as it stands there."""
    return F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.array_contains(wanted, t)))


#: Tags and hosts that raise a backlog score.
SPECIAL_TAGS = ("!tobuy", "!inspo", "!tohire", "!toread", "!important", "toread", "tobuy")
QUALITY_DOMAINS = (
    "nytimes.com", "theguardian.com", "washingtonpost.com", "propublica.org", "theintercept.com", "arstechnica.com", "wired.com", "theverge.com", "github.com",
    "arxiv.org", "nature.com", "newyorker.com", "theatlantic.com", "bloomberg.com", "reuters.com", "simonwillison.net", "substack.com",
)


def steps(x: Column, *levels: tuple[float, int], strict: bool = False) -> Column:
    """The points of the first level that ``x`` reaches (or passes), 0 of none and for null."""
    out = None
    for level, points in levels:
        hit = x > level if strict else x >= level
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.otherwise(0)


def backlog_score(created: Column, content: Column, tags: Column, url: Column) -> Column:
    n = F.coalesce(F.size(tags), F.lit(0))
    special = F.exists(tags, lambda t: _any(F.lower(t), SPECIAL_TAGS))
    return (
        steps(F.year(created), (2024, 30), (2023, 25), (2022, 20), (2021, 15), (2020, 10), (2018, 5))
        + steps(F.length(content), (2000, 20), (1000, 15), (500, 10), (100, 5), strict=True)
        + steps(n, (3, 15), (2, 10), (1, 5))
        + F.when(F.coalesce(special, F.lit(False)), 20).otherwise(0)
        + F.when(F.coalesce(_any(url, QUALITY_DOMAINS), F.lit(False)), 15).otherwise(0)
    )


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def tier(score: Column) -> Column:
    return F.when(score >= 70, "S").when(score >= 50, "A").when(score >= 30, "B").when(score >= 10, "C").otherwise("D")


def repair_score(created: Column, as_of: Column, url: Column, source: Column, title: Column, content: Column) -> Column:
    """Points by age, URL, source and what is there already."""
    days = F.timestamp_diff("SECOND", created, as_of) / 86400.0
    bonus = F.when(source == "pinboard", 30).when(source == "arena", 20).when(source == "github", 15).when(source == "mastodon", 10).otherwise(0)
    filled = lambda c, n: F.when(F.length(c) > n, 10).otherwise(0)
    return F.greatest(F.lit(0.0), 100 - days) + F.when(F.coalesce(url, F.lit("")) != "", 50).otherwise(0) + bonus + filled(title, 10) + filled(content, 100)


def strength(score: Column) -> Column:
    return F.when(score >= 0.8, "strong").when(score >= 0.5, "medium").when(score >= 0.3, "weak").when(score.isNotNull(), "minimal").otherwise("none")


def relative_day(day: Column, as_of: Column) -> Column:
    n = F.datediff(as_of, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))


#: What quality audits look for.
SUMMARY_LEAST, SUMMARY_AVOID = 500, ("unknown", "error", "failed")
TAGS_LEAST, TAGS_AVOID = 3, ("pinboard", "bookmark", "link")
PLACE_AVOID, PLACE_WORDS = ("unknown", "n/a", "none", ""), ("in ", "at ", "from ", "located", "city", "country", "street", "avenue")
FINANCE_WORDS = ("$", "price", "cost", "revenue", "investment", "fund")
RELATIONSHIP_PARTS = ("source.type", "source.name", "target.type", "target.name", "type")
