"""Pages as trees: which element each piece of a page stands in, by a fold over its tags with a stack of open elements.

Elements that are never closed end with the element around them, void ones have no inside, and some end where a sibling of
theirs begins. A closing tag that nothing is open for is passed over. Everything is an expression of columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ATTRIBUTES

#: Elements whose text a page's text is made of; those whose words, and whose links and strong words, count.
TEXT_ELEMENTS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "a", "td", "th", "tr", "pre", "code", "blockquote", "li", "ol", "ul", "table", "caption")
WORD_ELEMENTS = ("p", "h1", "h2", "h3", "h4", "blockquote", "li", "ol", "ul")
LINK_ELEMENTS = ("p", "h1", "h2", "h3", "h4", "blockquote")

#: Elements without an inside; elements that end where one of others begins, and those within which that holds.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section",
    "table", "ul",
)
ENDED_BY = {"p": BLOCKS, "li": ("li",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

#: References to signs, the sign & last.
SIGNS = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))

#: A comment or declaration, an element whose inside is no markup, a tag, or text.
_PIECE = rf"(?is)<!--.*?-->|<[!?][^>]*>|<(script|style|textarea|title)(?=[\s/>]){ATTRIBUTES}>.*?</\1\s*>|</?[a-z]{ATTRIBUTES}>|[^<]+|<"

_NODE = "array<struct<at:int,tag:string,parent:int,ends:int,text:string>>"


def unescaped(text: Column) -> Column:
    for a, b in SIGNS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pieces(html: Column) -> Column:
    """array<struct<kind, tag, text>>: open, void, close or text, in order; comments, scripts and styles are none."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_PIECE), F.lit(0))

    def piece(t: Column) -> Column:
        tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        kind = F.when((tag == "") & ~t.rlike(r"^<[!?]"), "text").when(tag == "", "none").when(t.startswith("</"), "close").when(tag.isin("script", "style", "textarea"), "none")
        kind = kind.when(tag.isin(*VOID) | t.endswith("/>"), "void").when(tag == "title", "title").otherwise("open")
        inside = F.regexp_replace(t, rf"(?is)^<title{ATTRIBUTES}>|</title\s*>$", "")
        return F.struct(kind.alias("kind"), tag.alias("tag"), F.when(kind == "text", unescaped(t)).when(kind == "title", unescaped(inside)).alias("text"))

    return F.filter(F.transform(raw, piece), lambda p: p["kind"] != "none")


def nodes(html: Column) -> Column:
    """array<struct<at, tag, parent, ends, text>>: a page's elements and texts (tag ``#text``) in the order in which they begin.

    at: place among the page's pieces; parent: that of the element around it, -1 for none; ends: the first place behind it.
    """
    read = pieces(html)
    open_ = "array<struct<tag:string,at:int>>"
    state = lambda i, stack, out, ends: F.struct(i.alias("i"), stack.alias("stack"), out.alias("out"), ends.alias("ends"))
    start = state(F.lit(0), F.array().cast(open_), F.array().cast("array<struct<at:int,tag:string,parent:int,text:string>>"), F.array().cast("array<struct<at:int,ends:int>>"))

    def cut(s: Column, keep: Column) -> tuple[Column, Column]:
        """The stack with its first ``keep`` elements, and the ends of the others, which are here."""
        gone = F.slice(s["stack"], keep + 1, F.greatest(F.size(s["stack"]) - keep, F.lit(0)))
        return F.slice(s["stack"], 1, keep), F.concat(s["ends"], F.transform(gone, lambda o: F.struct(o["at"].alias("at"), s["i"].alias("ends"))))

    def last_of(stack: Column, which) -> Column:
        """The place, from 1, of the last element of a kind; 0 without one."""
        hits = F.filter(F.transform(stack, lambda o, i: F.when(which(o), i + 1)), lambda x: x.isNotNull())
        return F.coalesce(F.array_max(hits), F.lit(0))

    def step(s: Column, p: Column) -> Column:
        top = F.coalesce(F.element_at(F.transform(s["stack"], lambda o: o["at"]), F.when(F.size(s["stack"]) > 0, -1)), F.lit(-1))
        node = lambda parent: F.struct(s["i"].alias("at"), F.when(p["kind"] == "text", "#text").otherwise(p["tag"]).alias("tag"), parent.alias("parent"), p["text"].alias("text"))
        found = last_of(s["stack"], lambda o: o["tag"] == p["tag"])
        closed, ends = cut(s, F.greatest(found - 1, F.lit(0)))
        close = F.when(found > 0, state(s["i"] + 1, closed, s["out"], ends)).otherwise(state(s["i"] + 1, s["stack"], s["out"], s["ends"]))
        # the innermost open element ends where this one begins
        ended = F.lit(False)
        inner = F.element_at(F.transform(s["stack"], lambda o: o["tag"]), F.when(F.size(s["stack"]) > 0, -1))
        for tag, by in ENDED_BY.items():
            ended = ended | ((inner == tag) & p["tag"].isin(*by))
        size = F.size(s["stack"])
        keep = F.when(F.coalesce(ended, F.lit(False)), size - 1).otherwise(size)
        kept, kept_ends = cut(s, keep)
        outer = F.coalesce(F.element_at(F.transform(kept, lambda o: o["at"]), F.when(keep > 0, -1)), F.lit(-1))
        begun = state(s["i"] + 1, F.array_append(kept, F.struct(p["tag"].alias("tag"), s["i"].alias("at"))), F.array_append(s["out"], node(outer)), kept_ends)
        alone = state(s["i"] + 1, kept, F.array_append(s["out"], node(outer)), F.array_append(kept_ends, F.struct(s["i"].alias("at"), (s["i"] + 1).alias("ends"))))
        text = state(s["i"] + 1, s["stack"], F.array_append(s["out"], node(top)), F.array_append(s["ends"], F.struct(s["i"].alias("at"), (s["i"] + 1).alias("ends"))))
        return F.when(p["kind"] == "close", close).when(p["kind"] == "text", text).when(p["kind"] == "open", begun).otherwise(alone)

    def finished(s: Column) -> Column:
        _, ends = cut(s, F.lit(0))
        in_order = F.array_sort(ends)  # one for each node, by place
        joined = F.zip_with(s["out"], in_order, lambda n, e: F.struct(n["at"].alias("at"), n["tag"].alias("tag"), n["parent"].alias("parent"), e["ends"].alias("ends"), n["text"].alias("text")))
        return joined.cast(_NODE)

    return F.aggregate(read, start, step, finished)


def text_of(nodes_: Column, at: Column, ends: Column) -> Column:
    """All text between two places."""
    return F.array_join(F.transform(F.filter(nodes_, lambda n: (n["tag"] == "#text") & (n["at"] > at) & (n["at"] < ends)), lambda n: n["text"]), "")


def page_text(nodes_: Column, elements: tuple[str, ...] = TEXT_ELEMENTS) -> Column:
    """The texts of all listed elements in order, one within another once for each, parted by a space."""
    return F.array_join(F.transform(F.filter(nodes_, lambda n: n["tag"].isin(*elements)), lambda n: text_of(nodes_, n["at"], n["ends"])), " ")


def page_title(nodes_: Column) -> Column:
    return F.get(F.filter(nodes_, lambda n: n["tag"] == "title"), 0)["text"]


def _children(nodes_: Column, tags: tuple[str, ...], child: str) -> Column:
    """The nodes of tag ``child`` whose parent is one of ``tags``."""
    parents = F.transform(F.filter(nodes_, lambda n: n["tag"].isin(*tags)), lambda n: n["at"])
    return F.filter(nodes_, lambda n: (n["tag"] == child) & F.array_contains(parents, n["parent"]))


def measures(nodes_: Column) -> Column:
    """struct<words, links, photos, strong>: words and links that stand in text elements themselves, images, and the texts in bold of such elements."""
    texts = F.transform(_children(nodes_, WORD_ELEMENTS, "#text"), lambda n: n["text"])
    words = F.size(F.filter(F.split(F.array_join(texts, " "), " "), lambda w: w != ""))
    bold = F.transform(_children(nodes_, LINK_ELEMENTS, "strong"), lambda n: n["at"])
    strong = F.transform(F.filter(nodes_, lambda n: (n["tag"] == "#text") & F.array_contains(bold, n["parent"])), lambda n: n["text"])
    photos = F.size(F.filter(nodes_, lambda n: n["tag"] == "img"))
    return F.struct(words.alias("words"), F.size(_children(nodes_, LINK_ELEMENTS, "a")).alias("links"), photos.alias("photos"), strong.alias("strong"))
