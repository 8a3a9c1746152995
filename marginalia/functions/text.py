"""Text and URL functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the archive's rules see it: also the no-break space and the byte-order mark.
SPACE = r"[\s ﻿]+"


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"'`]+|[\"'`]+$", "")


def entity_name(c: Column) -> Column:
    """A name without outer quotes, with plain quotes and single spaces; null counts as empty."""
    return F.translate(squeezed(unquoted(F.coalesce(c, F.lit("")))), "’“”", "'\"\"")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "['\"`]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def predicate_token(c: Column) -> Column:
    """camelCase and other marks as UPPER_CASE words."""
    apart = F.regexp_replace(F.trim(c), "([a-z])([A-Z])", "$1_$2")
    return F.upper(F.regexp_replace(F.regexp_replace(apart, "[^A-Za-z0-9]+", "_"), "^_|_$", ""))


def match_form(c: Column) -> Column:
    """Lower-case words of letters and digits, for comparison."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def without_html(c: Column) -> Column:
    return squeezed(F.regexp_replace(c, "<[^>]*>", " "))


def without_markdown(c: Column) -> Column:
    """Plain text: tags, emphasis, links, code and headings unwrapped, on one line."""
    steps = (
        ("<[^>]*>", " "), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), ("__(.+?)__", "$1"), ("_(.+?)_", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"```[\s\S]*?```", ""), ("`([^`]+)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\n{3,}", "\n\n"), (r"\n", " "),
    )
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def shortened(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last three dots where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def too_thin(c: Column) -> Column:
    return F.length(without_html(c)) < 100


def middle_cut(c: Column, most: int = 14000, head: int = 9500, tail: int = 3500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit("\n...\n"), F.substring(c, -tail, tail))).otherwise(c)


def sentence_chunks(c: Column, limit: int) -> Column:
    """Whole sentences gathered while their estimate of tokens stays within ``limit``; a longer sentence stands alone."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")
    size = lambda s: F.ceil(F.length(s) / 4)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        both = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.when((acc["open"] != "") & (size(both) > limit), F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open"))).otherwise(
            F.struct(acc["done"].alias("done"), both.alias("open"))
        )

    return F.aggregate(sentences, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x != ""))


def host(url: Column) -> Column:
    """The host in lower case without www., empty where the URL has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url).when(F.trim(url) != "", F.concat(F.lit("https://"), F.trim(url)))


def percent_encoded(c: Column, signs: str) -> Column:
    """Spaces, control characters, ``signs`` (as in a class of a pattern) and all beyond ASCII as %XX of their UTF-8 bytes."""
    encoded = lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20")
    out = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(rf"[^\x21-\x7e]|[{signs}]"), encoded(x)).otherwise(x)), "")
    return F.when(c.rlike(rf"[^\x21-\x7e]|[{signs}]"), out).otherwise(c)


def without_dots(path: Column) -> Column:
    """A path with its . and .. resolved; it starts with a slash."""
    dot, up = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    parts = F.split(path, "/")
    last = F.try_element_at(parts, F.lit(-1))
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda done, p: F.when(p.rlike(up), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p.rlike(dot), done).otherwise(F.concat(done, F.array(p))),
    )
    kept = F.when(last.rlike(dot) | last.rlike(up), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def clean_url(url: Column) -> Column:
    """An address in its standard form, https where it names no scheme; null where it can't be one.

    The host is in lower case, a scheme's own port goes, an empty path is a slash, dots in the path are resolved, spaces
    and what lies beyond ASCII are percent-encoded. Hosts beyond ASCII stay as they are.
    """
    bare = F.regexp_replace(url, r"^\s+|\s+$", "")
    # signs that may stand nowhere go, backslashes are slashes before a query
    bare = F.regexp_replace(F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare)), r"[\t\n\r]", "")
    part = lambda n: F.regexp_extract(bare, r"^(https?)://[/\\]*([^/\\?#]*@)?([^/\\?#]*?)(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?$", n)
    scheme, user, name, port, path, asked, place = (part(n) for n in range(1, 8))
    digits = F.regexp_replace(port, "^0+(?=.)", "")
    own = (digits == "") | ((scheme == "http") & (digits == "80")) | ((scheme == "https") & (digits == "443"))
    whole = F.concat(
        scheme, F.lit("://"), percent_encoded(user, "\"<>`{}|^"), F.lower(name), F.when(own, "").otherwise(F.concat(F.lit(":"), digits)),
        percent_encoded(without_dots(F.when(path == "", "/").otherwise(F.translate(path, "\\", "/"))), "\"<>`{}^"), percent_encoded(F.when(asked == "?", "?").otherwise(asked), "\"<>'"), percent_encoded(place, "\"<>`"),
    )
    fine = (bare != "https://") & (name != "") & ~name.rlike(r"[\x00-\x20#%/:<>?@\[\]\\^|\x7f]") & ((F.length(digits) < 5) | ((F.length(digits) == 5) & (digits <= "65535")))
    return F.when(fine, whole)


def url_title(url: Column) -> Column:
    """A title from the last part of the path, else the host."""
    last = F.try_element_at(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: (p != "") & (p != "index.html")), F.lit(-1))
    words = F.regexp_replace(F.translate(last, "-_", "  "), r"\.[^.]+$", "")
    return F.coalesce(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000)), F.nullif(host(url), F.lit("")))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:youtube\.com/watch\?(?:[^#]*&)?v=|youtu\.be/|youtube\.com/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


#: Parts of URLs that hint at a place.
PLACE_SEGMENTS = ("local", "city", "region", "metro", "area", "location", "weather", "news", "events", "places", "venue", "address")
PLACE_TLDS = (".us", ".uk", ".ca", ".au", ".fr", ".de", ".jp", ".in")
PLACE_DOMAINS = ("patch.com", "weather.com", "yelp.com", "foursquare.com", "maps.google.com", "local.", "city.", ".gov")


def place_hints(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    hints = [F.when(u.contains(f"/{s}/") | u.contains(f"-{s}-"), s) for s in PLACE_SEGMENTS]
    hints += [F.when(u.contains(t), f"geographic domain ({t})") for t in PLACE_TLDS]
    hints += [F.when(u.contains(d), f"location-focused domain ({d})") for d in PLACE_DOMAINS]
    return F.array_distinct(F.array_compact(F.array(*hints)))


#: Kinds of content in the order in which they are tried, by patterns of the URL and of the title.
CONTENT_TYPES = (
    ("news", r"/(news|article|story|breaking|politics|world)/", None),
    ("news", r"(nytimes|washingtonpost|reuters|apnews|cnn|bbc|theguardian|wsj)\.com", None),
    ("opinion", r"/(opinion|commentary|blog|post)/", None),
    ("opinion", r"(medium\.com|substack\.com|/blog/)", None),
    ("tutorial", r"/(tutorial|guide|how-to|howto|learn)/", r"^(how to|tutorial|guide to|learn)"),
    ("research", r"/(research|paper|study|journal|arxiv|doi)/", None),
    ("research", r"\.(pdf)(\?|$)", None),
    ("product", r"/(product|pricing|buy|shop|store)/", None),
    ("product", r"(amazon\.com|ebay\.com|shopify\.com)", None),
    ("discussion", r"(reddit\.com|hackernews|news\.ycombinator|discourse|forum)", None),
    ("discussion", r"/(comments|thread|discussion)/", None),
    ("discussion", r"(twitter\.com|x\.com|mastodon|threads\.net)", None),
    ("video", r"(youtube\.com|vimeo\.com|/watch\?)", None),
    ("documentation", r"/(docs|documentation|api|reference)/", None),
)


def content_type(url: Column, title: Column) -> Column:
    u, t, out = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))), None
    for kind, in_url, in_title in CONTENT_TYPES:
        hit = u.rlike(in_url) | t.rlike(in_title) if in_title else u.rlike(in_url)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("article")


def summary_title(summary: Column, url: Column) -> Column:
    """The first bullet of over 10 characters, else the first sentence, else the first 100 characters; the URL without a summary."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(summary, r"(?m)^#+\s*", ""), r"\*\*", ""))
    bullets = F.filter(
        F.transform(F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[•\-*]")), lambda x: F.trim(F.substring(x, 2, 10_000))),
        lambda x: F.length(x) > 10,
    )
    sentence = F.split_part(clean, F.lit(". "), F.lit(1))
    short = F.trim(F.substring(clean, 1, 100))
    rest = F.when(F.length(clean) > 100, F.concat(short, F.lit("..."))).otherwise(short)
    own = F.coalesce(shortened(F.get(bullets, 0), 100), F.when(F.length(sentence) > 10, shortened(F.trim(sentence), 100)), rest)
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", url_title(url)).otherwise(own)


def meta_summary(kind: Column, title: Column, location: Column, n_links: Column, tags: Column, summary: Column) -> Column:
    """About 140 characters on an item: kind, title, place, links and tags, and as much of the summary as fits."""
    parts = F.concat_ws(
        " · ",
        F.when(kind != "bookmark", F.upper(kind)),
        F.substring(without_markdown(F.nullif(title, F.lit(""))), 1, 40),
        F.when((location != "") & (location != "Unknown"), F.concat(F.lit("@ "), location)),
        F.when(n_links > 0, F.concat(n_links.cast("string"), F.lit(" connections"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("#"), F.array_join(F.slice(tags, 1, 2), " #"))),
    )
    room = F.lit(140) - F.length(parts) - 3
    text = F.when(
        (F.length(parts) < 120) & (F.coalesce(summary, F.lit("")) != "") & (room > 20), F.concat(parts, F.lit(" - "), without_markdown(summary).substr(F.lit(1), room))
    ).otherwise(parts)
    text = F.when(F.length(text) > 140, F.concat(F.substring(text, 1, 139), F.lit("…"))).otherwise(text)
    return F.when(text == "", "No summary available").otherwise(text)


#: Names that are no entity, whole names and patterns.
JUNK_NAMES = (
    "about", "article", "articles", "audio", "contact us", "contact", "cookie policy", "developers", "download", "home", "homepage", "menu", "news",
    "podcast", "podcasts", "press", "privacy policy", "read more", "share", "sign in", "sign up", "terms", "terms of service", "url", "video", "videos",
)
JUNK_PATTERNS = (
    r"^[\W_]+$", r"(?i)^\$[\d,.]+(\s*(million|billion|trillion|m|bn|k))?$", r"(?i)^https?://", r"(?i)^www\.", r"^[\d,.%]+$", r"^[><=]+$", r"^[/\"'`.,;:()\[\]{}-]+$", r"^[A-Za-z]$"
)


def junk_name(name: Column) -> Column:
    n = entity_name(name)
    out = (F.length(n) < 2) | F.lower(n).isin(*JUNK_NAMES)
    for p in JUNK_PATTERNS:
        out = out | n.rlike(p)
    return out


#: Actors that stand for no one in particular.
GENERIC_ACTORS = (
    r"^(federal|immigration|masked|armed|plainclothes)?\s*officers?$", r"^(federal|immigration|masked|armed|plainclothes)?\s*agents?$",
    r"^(dhs|ice|cbp|border patrol)\s+officers?$", r"^(dhs|ice|cbp|border patrol)\s+agents?$", r"^protesters?$", r"^demonstrators?$", r"^residents?$",
    r"^immigrants?$", r"^migrants?$", r"^children$", r"^parents?$", r"^people$", r"^officials?$", r"^organizers?$", r"^journalists?$", r"^law enforcement$",
    r"^local officials?$", r"^government officials?$",
)


def generic_actor(name: Column) -> Column:
    n = F.lower(entity_name(name))
    out = F.lit(False)
    for p in GENERIC_ACTORS:
        out = out | n.rlike(p)
    return out


def human_name(name: Column) -> Column:
    """Two to four capitalised words."""
    return entity_name(name).rlike(r"^[A-Z][A-Za-z'.-]+( [A-Z][A-Za-z'.-]+){1,3}$")


def asset_type(ticker: Column) -> Column:
    """Classes of tickers in the order in which they are tried."""
    t = F.upper(ticker)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "unknown")
        .when(t.contains("-USD") | t.contains("USDT") | t.isin("BTC", "ETH", "ADA", "DOT", "SOL", "MATIC", "AVAX", "DOGE"), "crypto")
        .when(t.contains("=X") | t.contains("/"), "forex")
        .when(t.startswith("^") | t.isin("SPX", "NDX", "DJX"), "index")
        .when((F.length(t) == 3) & (t.contains("ETF") | t.isin("SPY", "QQQ", "VTI", "IWM", "GLD", "SLV") | t.endswith("Y")), "etf")
        .when(t.contains("=F") | F.split_part(t, F.lit("="), F.lit(1)).isin("GC", "SI", "CL", "NG"), "commodity")
        .otherwise("stock")
    )


#: Strings that mark what is no place on earth.
NO_PLACES = (
    "reddit", "twitter", "facebook", "instagram", "linkedin", "youtube", "tiktok", "snapchat", "pinterest", "tumblr", "github", "gitlab", "bitbucket",
    "stackoverflow", "codepen", ".com", ".org", ".net", ".io", ".dev", ".co", "http://", "https://", "online", "virtual", "digital", "web", "internet",
    "cloud", "app", "website", "platform", "service", "network",
)


def real_place(location: Column) -> Column:
    low = F.lower(location)
    bad = F.lit(False)
    for term in NO_PLACES:
        bad = bad | low.contains(term)
    return F.coalesce(~bad & (F.length(F.trim(location)) >= 2), F.lit(False))


def balanced_json(text: Column) -> Column:
    """JSON that was cut off, with its open string, arrays and objects closed; null where no object or array begins."""

    @F.pandas_udf("string")
    def close(texts):
        import json

        def one(t):
            start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1) if t else -1
            if start < 0:
                return None
            stack, quoted, escaped = [], False, False
            for c in t[start:]:
                if quoted:
                    escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif c in "}]" and stack:
                    stack.pop()
            out = t[start:] + '"' * quoted
            out = out.rstrip().rstrip(",:") + "".join(reversed(stack))
            try:
                json.loads(out)
            except ValueError:
                return None
            return out

        return texts.map(one, na_action="ignore")

    return close(text)


def parsed_json(text: Column) -> Column:
    """The value that a text is as JSON, as a variant; null for what is none, text after the value included.

    Spark's own parser stops at the end of the first value. Inside an array as well as inside an object nothing can
    follow a value and leave both whole.
    """
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def is_json(text: Column) -> Column:
    """Whether a text is JSON, ``null`` included; null for a null text."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(text.isNotNull(), whole)


def tolerant_json(text: Column) -> Column:
    """The JSON of a reply: of its fenced block, of the whole, or from its first brace to its last; null otherwise."""
    fenced = F.nullif(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda c: F.when(is_json(c), c)
    return F.coalesce(valid(stripped(fenced)), valid(stripped(text)), valid(inner))
