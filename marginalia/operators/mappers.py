"""Landed records of two sources as items, and the texts that models are asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.items import greatest, newest


def filled(c: Column | str) -> Column:
    """A string, or null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*paths: str) -> Column:
    return F.coalesce(*[filled(p) for p in paths])


def distinct_tags(*parts: Column) -> Column:
    """The parts, arrays one after the other, without nulls, empty and repeated ones; the first of each stays."""
    return F.array_distinct(F.filter(F.concat(*parts), lambda t: t.isNotNull() & (t != "")))


def _or_none(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def repository_rows(df: DataFrame) -> DataFrame:
    """Items of landed repository records, by type.

    Columns: id, type, html_url, url, title, name, description, body, topics, language, state, private, fork. Repositories,
    gists and starred ones tell their description, changes, issues and releases their body; another type has no content.
    A state is a tag of changes and issues alone, visibility of repositories and gists, a fork of repositories.
    """
    kind = F.col("type")
    content = (
        F.when(kind.isin("repo", "gist", "starred"), F.coalesce(filled("description"), F.lit("No description")))
        .when(kind.isin("pr", "issue", "release"), F.coalesce(filled("body"), F.lit("No content"))).otherwise("No content")
    )
    facets = F.array(
        F.lower("language"), kind, F.when(kind.isin("pr", "issue"), F.col("state")),
        F.when(kind.isin("repo", "gist"), F.when(F.col("private"), "private").otherwise("public")), F.when((kind == "repo") & F.col("fork"), "fork"),
    )
    return df.select(
        F.concat(F.lit("github-"), F.col("id").cast("string")).alias("item_id"), F.lit("github").alias("source"), kind.alias("type"), first_filled("html_url", "url").alias("url"),
        F.coalesce(first_filled("title", "name"), F.lit("Untitled")).alias("title"), content.alias("content"), distinct_tags(_or_none("topics"), facets).alias("tags"),
    )


#: Where a block's picture is looked for, best first.
IMAGES = ("image.original", "image.large", "image.display", "image.square", "image.thumb", "attachment.url", "embed.thumbnail_url")


def block_rows(df: DataFrame) -> DataFrame:
    """Items of landed blocks, by class in any case.

    Columns: id, class, base_class, title, generated_title, description, content, and the structs source (url, title),
    attachment (url), embed (url, title, thumbnail_url) and image (original, large, display, square, thumb: addresses).
    """
    kind = F.lower("class")
    of = lambda last, *paths: F.coalesce(*[filled(p) for p in paths], F.lit(last))
    content = (
        F.when(F.coalesce(filled("class"), F.lit("")) == "", "No content")
        .when(kind == "image", of("Untitled image", "description", "title", "generated_title"))
        .when(kind == "text", of("Empty text block", "content", "description"))
        .when(kind == "link", of("Untitled link", "description", "source.title"))
        .when(kind == "attachment", of("Untitled attachment", "description", "title"))
        .when(kind == "media", of("Untitled media", "description", "embed.title"))
        .otherwise(of("No content", "content", "description"))
    )
    here = F.concat(F.lit("https://www.are.na/block/"), F.col("id").cast("string"))
    return df.select(
        F.concat(F.lit("arena-"), F.col("id").cast("string")).alias("item_id"), F.lit("arena").alias("source"), F.lit("block").alias("type"),
        F.coalesce(first_filled("source.url", "attachment.url", "embed.url"), here).alias("url"), of("Untitled Block", "title", "generated_title").alias("title"),
        content.alias("content"), first_filled(*IMAGES).alias("image_url"),
        F.filter(F.array(kind, F.lower("base_class")), lambda t: t.isNotNull() & (t != "")).alias("tags"),
    )


def union_of(lists: list[DataFrame], order: Column, limit: int | None = None) -> DataFrame:
    """Rows of all lists in the order of the lists, then by ``order``; the first ``limit`` of them, if one is given."""
    every = None
    for at, rows in enumerate(lists):
        rows = rows.withColumn("list", F.lit(at))
        every = rows if every is None else every.unionByName(rows)
    return every if limit is None else every.orderBy("list", order).limit(limit)


def cached_fetch(cache: DataFrame, remote: DataFrame, key: str, time: str, cached_at: str | None, updated_at: str | None, newest_rows: int = 100) -> DataFrame:
    """What a source holds now, with as little of ``remote`` as will do.

    Nothing cached (``cached_at`` null): all of ``remote``. Cached when ``updated_at`` was the same: the cache. Else the
    newest ``newest_rows`` of ``remote`` by ``time`` before the cache; of rows with one ``key`` the first stays. An unknown
    ``updated_at`` (the source could not be asked) gives the cache, if there is one.
    """
    if cached_at is None:
        return remote
    if updated_at is None or updated_at == cached_at:
        return cache
    recent = remote.orderBy(newest(time), greatest(key)).limit(newest_rows)
    from_both = recent.withColumn("_at", F.lit(0)).unionByName(cache.withColumn("_at", F.lit(1)))
    rest = [c for c in recent.columns if c != key]
    first = from_both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_at", newest(time).alias("t"))).alias("f"))
    return first.select(*[F.col(c) if c == key else F.col(f"f.{c}").alias(c) for c in recent.columns])


def repository_text(df: DataFrame) -> Column:
    """What a model is told of a repository: type, name, description, language, stars, topics, author and times, a line each."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    text = lambda c, none: F.coalesce(filled(F.col(c).cast("string")), F.lit(none))
    topics = F.coalesce(filled(F.array_join("topics", ", ")), F.lit("None"))
    return F.concat(
        line("Type", text("type", "")), line("Name", text("name", "")), line("Description", text("description", "No description")), line("Language", text("language", "Not specified")),
        line("Stars", text("stars", "0")), line("Topics", topics), line("Author", text("author", "Unknown")), line("Created", text("created_at", "")), line("Updated", text("updated_at", "")),
    )


def status_text() -> Column:
    """What a model is told of a status: content, created_at, media (array of type, description), tags, visibility, language."""
    text = lambda c, none: F.coalesce(filled(F.col(c).cast("string")), F.lit(none))
    one = lambda m, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". Type: "), F.coalesce(m["type"], F.lit("")), F.lit(", Description: "), F.coalesce(filled(m["description"]), F.lit("No description")), F.lit("\n"))
    media = F.when(F.size("media") > 0, F.concat(F.lit("Media attachments:\n"), F.array_join(F.transform("media", one), ""))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Existing tags: "), F.array_join("tags", ", "), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("Status: "), text("content", ""), F.lit("\nCreated at: "), text("created_at", ""), F.lit("\n"), F.coalesce(media, F.lit("")), F.coalesce(tags, F.lit("")),
        F.lit("Visibility: "), text("visibility", ""), F.lit("\nLanguage: "), text("language", "unknown"), F.lit("\n"),
    )


def line_tags(reply: Column) -> Column:
    """Tags of a reply of a tag a line: the first # goes, then spaces around; empty ones are none."""
    bare = F.transform(F.split(reply, "\n"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^([^#]*)#", "$1"), r"^\s+|\s+$", ""))
    return F.filter(bare, lambda t: t != "")
