"""What readers and prompts see: context of related items, images, relationships, progress; and smaller dates and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_json, parsed_json

#: Lengths of a url that stands in for a title, and of a summary's snippet; relationships that are shown.
URL_TITLE, SNIPPET, SHOWN = 50, 200, 16

#: The modes and states of claims, and the modes that an extraction may have.
CLAIM_MODES = ("observed", "quoted", "reported", "asserted", "alleged", "derived")
CLAIM_STATES = ("unreviewed", "plausible", "supported", "contested", "contradicted", "uncertain")
EXTRACTED_MODES = ("asserted", "reported")


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def context_block(number: Column, created: Column, title: Column, url: Column, summary: Column, location: Column, kind: Column, miles: Column, shared: Column) -> Column:
    """One related item as lines of a prompt: its date and title, place, type, distance (null: none), shared tags (null: none), and its summary's first line."""
    name = F.coalesce(filled(title), filled(F.substring(url, 1, URL_TITLE)), F.lit("Untitled"))
    whole = F.coalesce(filled(summary), F.lit("No summary available"))
    line = F.coalesce(F.get(F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != ""), 0), whole)
    snippet = F.substring(F.regexp_replace(line, r"^(?:•|-|\*)\s*", ""), 1, SNIPPET)
    return F.concat(
        number.cast("string"), F.lit(". ["), F.date_format(created, "yyyy-MM-dd"), F.lit('] "'), name, F.lit('"\n   Location: '), F.coalesce(filled(location), F.lit("Unknown location")),
        F.lit(" | Type: "), F.coalesce(filled(kind), F.lit("bookmark")), F.when(miles.isNotNull(), F.format_string(" | Distance: %.1f mi", miles)).otherwise(""),
        F.coalesce(F.concat(F.lit("\n   Shared tags: "), F.array_join(shared, ", ")), F.lit("")), F.lit("\n   Summary: "), snippet, F.when(F.length(snippet) >= SNIPPET, "...").otherwise(""),
    )


def short_id(c: Column) -> Column:
    """The first eight characters, such as are no lower-case hex digits as 0."""
    return F.regexp_replace(F.substring(c, 1, 8), "[^0-9a-f]", "0")


def months_before(c: Column, months: int) -> Column:
    """The same day of an earlier month; days that it lacks run over into the next one."""
    return F.date_add(F.add_months(F.trunc(c, "month"), -months), F.dayofmonth(c) - 1)


def image(metadata: Column, screenshot: Column) -> Column:
    """A block's image: as displayed, then of the image host, then the original, then a screenshot."""
    v = parsed_json(metadata)
    return F.coalesce(*[filled(F.try_variant_get(v, f"$.image_data.{k}", "string")) for k in ("display", "cloudinary_url", "original_url")], filled(screenshot))


def shown(relationships: Column, limit: int = SHOWN) -> Column:
    """struct<lines, more>: the relationships of a JSON array that have a source or a target, the first ``limit``, and how many more."""
    all_ = F.from_json(F.when(is_json(relationships), relationships), "array<variant>")
    get = lambda v, k: F.coalesce(filled(F.try_variant_get(v, f"$.{k}.name", "string")), filled(F.try_variant_get(v, f"$.{k}", "string")))
    valid = F.filter(all_, lambda v: F.schema_of_variant(v).startswith("OBJECT") & (get(v, "source").isNotNull() | get(v, "target").isNotNull()))
    label = lambda v: F.coalesce(F.try_variant_get(v, "$.relationship", "string"), F.try_variant_get(v, "$.type", "string"), F.lit(""))
    line = lambda v: F.concat(F.coalesce(get(v, "source"), F.lit("?")), F.lit(" →["), label(v), F.lit("]→ "), F.coalesce(get(v, "target"), F.lit("?")))
    return F.struct(F.transform(F.slice(valid, 1, limit), line).alias("lines"), F.greatest(F.size(valid) - limit, F.lit(0)).alias("more"))


def progress(*fields: Column) -> Column:
    """complete: all fields are there; processing: some; new: none."""
    n = sum((F.coalesce(f, F.lit(False)).cast("int") for f in fields), F.lit(0))
    return F.when(n == len(fields), "complete").when(n > 0, "processing").otherwise("new")


def merged(a: Column, b: Column) -> Column:
    """The objects of two JSON arrays, equal values once, whatever the order of their keys."""
    read = lambda c: F.transform(F.coalesce(F.from_json(F.when(is_json(c), c), "array<variant>"), F.array().cast("array<variant>")), lambda v: F.to_json(v))
    return F.array_distinct(F.concat(read(a), read(b)))


def text_chunks(content: Column, most: int = 16384) -> Column:
    """A text in chunks of ``most`` characters about: whole paragraphs while they fit, then words of those that are longer.

    A chunk is trimmed and an empty one left out. A word longer than ``most`` is a chunk of its own.
    """
    state = lambda now, out: F.struct(now.alias("now"), out.alias("out"))
    start = state(F.lit(""), F.array().cast("array<string>"))
    closed = lambda s: F.when(F.trim(s["now"]) != "", state(F.lit(""), F.array_append(s["out"], F.trim(s["now"])))).otherwise(s)
    joined = lambda s, sign, x: state(F.concat(s["now"], F.when(s["now"] != "", sign).otherwise(""), x), s["out"])
    fits = lambda s, x: F.length(s["now"]) + F.length(x) <= most

    def word(s: Column, w: Column) -> Column:
        return F.when(fits(s, w), joined(s, " ", w)).otherwise(joined(closed(s), " ", w))

    def paragraph(s: Column, p: Column) -> Column:
        long = F.aggregate(F.split(p, " "), closed(s), word, closed)
        return F.when(fits(s, p), joined(s, "\n", p)).when(F.length(p) <= most, state(p, closed(s)["out"])).otherwise(long)

    return F.aggregate(F.split(F.coalesce(content, F.lit("")), "\n"), start, paragraph, lambda s: closed(s)["out"])
