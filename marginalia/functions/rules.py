"""Smaller rules of the archive: kinds of entities, scores of passages, tags, ages, filled fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entity_name, is_json, parsed_json, squeezed

#: Patterns of entity types in the order in which they are tried.
ENTITY_PATTERNS = (
    ("Organization", r"(?i)\b(Inc\.?|Corp\.?|LLC|Ltd\.?|GmbH|SA|AG|PLC|Company|Corporation|Group|Foundation|Institute|University|College|Agency|Department|Ministry|Commission|Committee|Council|Board|Authority|Office|Bureau|Service|Administration|Association|Society|Union|Federation|Alliance|Coalition|Network|Consortium|Trust|Fund)\b"),
    ("Organization", r"(?i)^(Microsoft|Google|Facebook|Meta|Amazon|Apple|OpenAI|Anthropic|DeepMind|IBM|Oracle|Intel|NVIDIA|MIT|Harvard|Stanford|CIA|NSA|FDA|CDC|FBI|NASA|UN|NATO|EU)$"),
    ("Model", r"(?i)(^|\b)(gpt-\d|gpt-4o|claude|llama|gemini|mistral|bert|whisper|sdxl|stable diffusion)(\b|$)"),
    ("Model", r"(?i)\b(model|llm|embedding model|vision model|foundation model)\b"),
    ("Dataset", r"(?i)\b(dataset|data set|registry|corpus|benchmark|spreadsheet|csv|parquet|shapefile|geojson|archive|database)\b"),
    ("Dataset", r"(?i)\b(common crawl|imagenet|laion|c4|covert catharsis)\b"),
    ("Tool", r"(?i)\.(js|py|java|cpp|c|go|rs|ts|jsx|tsx|vue|rb|php|swift|kt|scala)$"),
    ("Tool", r"(?i)^(react|vue|angular|svelte|next\.?js|nuxt|webpack|babel|vite|rollup|esbuild|docker|kubernetes|terraform|postgresql|mongodb|redis|sqlite)$"),
    ("Tool", r"(?i)\b(framework|library|toolkit|platform|service|protocol|software|hardware|application|tool|package|module|api|sdk|cli|repository|repo)\b"),
    ("Artwork", r"(?i)\b(film|album|song|book|novel|poem|essay collection|installation|performance|exhibition|zine|documentary|artwork|painting|sculpture)\b"),
    ("Artwork", r"(?i)\broulette\b"),
    ("Project", r"(?i)\b(project|initiative|campaign|investigation|operation|program|effort|series)\b"),
    ("Movement", r"(?i)\b(movement|uprising|solidarity movement|political movement|social movement)\b"),
    ("Movement", r"(?i)^(Civil Rights Movement|Black Lives Matter|MAGA|Make America Great Again|QAnon|Tea Party)$"),
    ("Location", r"(?i)^(United States|Canada|Mexico|Brazil|United Kingdom|France|Germany|China|Japan|India|Australia|New York|Los Angeles|San Francisco|Washington|London|Paris|Berlin|Rome|Madrid|Moscow|Beijing|Tokyo)$"),
    ("Location", r"(?i)\b(street|avenue|road|boulevard|lane|drive|court|plaza|square|park|city|town|village|county|state|province|country|region|river|lake|mountain|island|campus|building)\b"),
    ("Person", r"(?i)^(Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Prof\.?|Sir|Dame)\s+"),
    ("Person", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z'-.]+)+$"),
    ("Person", r"(?i)\b(CEO|CTO|CFO|President|Director|Engineer|Scientist|Professor|Doctor|Attorney|Judge|Senator|Representative|Governor|Mayor|Minister|Secretary|Commissioner|Founder|Co-founder|Chair)\b"),
    ("Person", r"(?i)^@[A-Za-z0-9_]+$"),
    ("Person", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$"),
    ("Organization", r"^[A-Z][A-Za-z0-9_.-]+$"),
)


def entity_type(name: Column) -> Column:
    """The type that a name looks like: the first pattern that fits; Organization for an empty name, else Project."""
    n, out = entity_name(name), F.when(entity_name(name) == "", "Organization")
    for kind, pattern in ENTITY_PATTERNS:
        out = out.when(n.rlike(pattern), kind)
    return out.otherwise("Project")


#: Points of words in a passage of a code host's page; of words of which any counts once; and of its length.
PASSAGE_POINTS = (
    ("summary", 5), ("maintained by", 6), ("author", 5), ("license and attribution", 5), ("repository", 3), ("implementation", 4), ("model", 3), ("library", 3),
    ("requires ", 2), ("depends on", 2), ("uses ", 2), ("built with", 2), ("ported", 2), ("owner", 2),
)
PASSAGE_ANY = (
    (("copyright", "(c)"), 4),
    (("navigation menu", "skip to content", "saved searches", "sign up", "pull requests", "actions", "security", "insights"), -8),
    (("brew install", "go install", "pip install", "npm install", "cargo install", "homebrew"), -5),
)
PASSAGE_PATH, LEAST_PASSAGE, LONG_PASSAGE, SHORT_PASSAGE = r"[A-Z][A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", 40, 800, 60


def passages(content: Column) -> Column:
    """The paragraphs of a text, their white space squeezed, of LEAST_PASSAGE characters or more."""
    return F.filter(F.transform(F.split(content, r"\n{2,}"), squeezed), lambda p: F.length(p) >= LEAST_PASSAGE)


def passage_score(p: Column) -> Column:
    low = F.lower(p)
    any_ = lambda words: reduce(or_, [low.contains(w) for w in words])
    points = [F.when(low.contains(w), n).otherwise(0) for w, n in PASSAGE_POINTS] + [F.when(any_(words), n).otherwise(0) for words, n in PASSAGE_ANY]
    points += [F.when(p.rlike(PASSAGE_PATH), 2).otherwise(0), F.when(F.length(p) > LONG_PASSAGE, -2).otherwise(0), F.when(F.length(p) < SHORT_PASSAGE, -1).otherwise(0)]
    return reduce(add, points)


def best_passages(content: Column, most: int) -> Column:
    """array<struct<at, score, passage>>: the ``most`` passages of the highest score above 0, in the order of the text."""
    scored = F.transform(passages(content), lambda p, i: F.struct((-passage_score(p)).alias("less"), i.alias("at"), p.alias("passage")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["less"] < 0)), 1, most)
    return F.array_sort(F.transform(best, lambda x: F.struct(x["at"].alias("at"), (-x["less"]).alias("score"), x["passage"].alias("passage"))))


#: Short tags that are allowed, tags about the archive itself, stop words and words that titles leave behind.
SHORT_TAGS, META_TAGS = ("ai", "ar", "vr", "ui", "ux", "js", "ny", "r", "d3"), ("pinboard", "bookmark", "webpage")
STOP_TAGS, TITLE_TAGS = ("of", "and", "the", "a", "an", "in", "on", "at", "to", "for", "-", "or"), ("Artificial", "Intelligence", "Machine", "Learning", "Table", "Contents")
KEYWORDS = ("javascript", "python", "design", "api", "github", "data", "tool")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is made once, and not again for each element of an array that ``f`` goes through."""
    return F.get(F.transform(F.array(value), f), 0)


def clean_tags(reply: Column) -> Column:
    """Tags of a reply of comma or line separated ones: single lower-case words, without what is no tag."""
    parts = F.transform(F.split(F.regexp_replace(reply, r"[\n\r]", ","), ","), lambda t: F.trim(t))
    fine = lambda t: (F.length(t) > 0) & (F.length(t) < 30) & ~t.contains(" ") & ~F.lower(t).isin(*META_TAGS)
    short = lambda t: (F.length(t) > 2) | t.startswith("!") | F.lower(t).isin(*SHORT_TAGS)
    # the first part of a spelling decides whether it was written in lower case
    spelled = lambda p: F.array_sort(F.transform(p, lambda t, i: F.struct(F.lower(t).alias("s"), i.alias("i"), t.rlike("[A-Z]").alias("capital"))))
    begins = lambda b: lambda x, i: x["capital"] & F.coalesce(F.get(b, i - 1)["s"] != x["s"], F.lit(True))
    capitals = lambda p: bound(spelled(p), lambda b: F.transform(F.filter(b, begins(b)), lambda x: x["s"]))
    kept = lambda p, c: F.filter(p, lambda t: fine(t) & short(t) & ((F.length(t) <= 2) | ~F.array_contains(c, F.lower(t))))
    return bound(parts, lambda p: bound(capitals(p), lambda c: F.transform(kept(p, c), F.lower)))


def bad_tags(tags: Column) -> Column:
    """Whether tags are those of no one's making: pinboard alone, a stop word, or a capitalised word."""
    bad = lambda t: t.isin(*STOP_TAGS, *TITLE_TAGS) | ((F.length(t) > 2) & t.rlike("^[A-Z]"))
    return F.coalesce((F.size(tags) == 1) & (F.get(tags, 0) == "pinboard"), F.lit(False)) | F.coalesce(F.exists(tags, bad), F.lit(False))


def keyword_tags(source: Column, text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(source, *[F.when(F.lower(text).contains(k), k) for k in KEYWORDS])))


#: Units of ages, in seconds.
AGES = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60))


def age(seconds: Column) -> Column:
    """The largest whole unit of an age in seconds."""
    out = None
    for name, size in AGES:
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
        out = F.when(n >= 1, text) if out is None else out.when(n >= 1, text)
    return out.otherwise("just now")


def duration(seconds: Column) -> Column:
    h, m, s = (F.floor(x).cast("string") for x in (seconds / 3600, seconds % 3600 / 60, seconds % 60))
    return F.when(seconds >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(seconds >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def filled(c: Column, dtype: str) -> Column:
    """Whether a value is there: an array or map with an entry, a string with a sign that is no space, anything else not null."""
    there = F.size(c) > 0 if dtype.startswith(("array", "map")) else F.trim(c) != "" if dtype == "string" else c.isNotNull()
    return F.coalesce(there, F.lit(False))


#: Points of a source in the order of repairs.
REPAIR_SOURCES = {"pinboard": 3, "arena": 2, "mastodon": 1}


def fix_priority(source: Column, issues: Column, url: Column, days: Column) -> Column:
    base = reduce(lambda c, kv: c.when(source == kv[0], kv[1]), list(REPAIR_SOURCES.items())[1:], F.when(source == "pinboard", 3)).otherwise(0)
    return base + issues + F.when(F.coalesce(url, F.lit("")) != "", 2).otherwise(0) + F.when(days < 7, 3).when(days < 30, 2).when(days < 90, 1).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where that says nothing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def csv_field(c: Column) -> Column:
    """A value as a field of a line: quoted, its quotes doubled, where it holds a quote, a comma or a line break."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def escaped(c: Column) -> Column:
    """A text for a page of markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def first_json(text: Column, opens: str = "{") -> Column:
    """The object (or array) that begins at a reply's first opening sign, written anew; null if that is no JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}" if opens == "{" else r"(?s)\[.*\]", 0), F.lit(""))
    return F.to_json(parsed_json(found))


def salvaged(text: Column, key: str) -> Column:
    """The flat objects of a broken reply that have ``key``, those of them that are JSON."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\"%s\"\s*:[^{}]*\}" % key), F.lit(0))
    return F.filter(found, is_json)


def json_with(text: Column, key: str, value: Column) -> Column:
    """The JSON object of ``text`` with ``key`` set to a string, every other key and value as it was; null for what is no object."""
    object_ = parsed_json(text)
    entries = F.from_json(F.when(F.schema_of_variant(object_).startswith("OBJECT"), F.to_json(object_)), "map<string,variant>")
    own = F.create_map(F.lit(key), value.cast("string").cast("variant"))
    return F.to_json(F.map_concat(F.map_filter(entries, lambda k, _: k != key), own))


#: A tag's attributes, in which a sign > may stand between quotes, and the value of one of them: quoted in either way, or bare.
ATTRIBUTES, VALUE = r"""(?:[^>"']|"[^"]*"|'[^']*')*""", r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, names: str) -> Column:
    """The value of a tag's attribute (a pattern of its name); empty without one."""
    pattern = rf"(?is)[\s\"'/](?:{names}){VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def meta_tags(html: Column) -> Column:
    """map of the lower-case names of a page's meta tags (name or property) to their contents, the first of each name."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<meta(?=[\s/]){ATTRIBUTES}>"), F.lit(0))
    pairs = F.filter(F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name|property")).alias("key"), attribute(t, "content").alias("value"))), lambda p: p["key"] != "")
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def linked_data(html: Column) -> Column:
    """The texts of a page's scripts of linked data (JSON-LD), those of them that are JSON."""
    scripts = F.regexp_extract_all(html, F.lit(rf"(?is)<script(?=[\s/])({ATTRIBUTES})>.*?</script\s*>"), F.lit(0))
    typed = F.filter(scripts, lambda s: F.lower(attribute(F.regexp_extract(s, rf"(?is)^<script{ATTRIBUTES}>", 0), "type")) == "application/ld+json")
    return F.filter(F.transform(typed, lambda s: F.trim(F.regexp_replace(s, rf"(?is)^<script{ATTRIBUTES}>|</script\s*>$", ""))), is_json)
