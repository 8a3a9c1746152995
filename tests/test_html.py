"""Pages as trees, against a parser with a stack that reads one tag after the other."""

import random
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marginalia.functions import html as H


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.nodes, self.quiet = [], [], 0

    def add(self, tag, text=None):
        self.nodes.append([tag, self.stack[-1] if self.stack else -1, None, text])
        return len(self.nodes) - 1

    def end(self, keep):
        for k in self.stack[keep:]:
            self.nodes[k][2] = len(self.nodes)
        del self.stack[keep:]

    def handle_starttag(self, tag, attrs, closed=False):
        if tag in ("script", "style", "textarea"):
            self.quiet = not closed
            return
        if self.stack and tag in H.ENDED_BY.get(self.nodes[self.stack[-1]][0], ()):
            self.end(len(self.stack) - 1)
        k = self.add(tag)
        if tag in H.VOID or closed:
            self.nodes[k][2] = len(self.nodes)
        else:
            self.stack.append(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "textarea"):
            self.quiet = 0
            return
        at = max((i for i, k in enumerate(self.stack) if self.nodes[k][0] == tag), default=None)
        if at is not None:
            self.end(at)

    def say(self, text):
        if not self.quiet:
            if self.nodes and self.nodes[-1][0] == "#text" and self.joined:
                self.nodes[-1][3] += text
            else:
                self.nodes[self.add("#text", "")][2:] = [len(self.nodes), text]
            self.joined = True

    joined = False

    def handle_data(self, data):
        self.say(data)

    def handle_entityref(self, name):
        self.say(f"&{name};")

    def handle_charref(self, name):
        self.say(f"&#{name};")


def plain(html):
    p = Plain()
    for method in ("handle_starttag", "handle_startendtag", "handle_endtag", "handle_comment", "handle_decl"):
        own = getattr(p, method)

        def parted(*a, own=own):
            p.joined = False
            return own(*a)

        setattr(p, method, parted)
    p.feed(html or "")
    p.close()
    p.end(0)
    return p.nodes


def known(nodes):
    """Texts of listed elements, words, links, images and bold texts, from (tag, parent, ends, text)."""
    tag = [n[0] for n in nodes]
    inside = lambda k: "".join(unescape(n[3]) for n in nodes[k + 1 : nodes[k][2]] if n[0] == "#text")
    of = lambda n, tags: n[1] >= 0 and tag[n[1]] in tags
    words = " ".join(unescape(n[3]) for n in nodes if n[0] == "#text" and of(n, H.WORD_ELEMENTS)).split(" ")
    strong = [unescape(n[3]) for n in nodes if n[0] == "#text" and of(n, ("strong",)) and of(nodes[n[1]], H.LINK_ELEMENTS)]
    return (
        " ".join(inside(k) for k, t in enumerate(tag) if t in H.TEXT_ELEMENTS), sum(w != "" for w in words), sum(n[0] == "a" and of(n, H.LINK_ELEMENTS) for n in nodes), tag.count("img"), strong,
    )


def measured(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(4).withColumn("n", H.nodes(F.col("html")))
    rows = df.select("id", H.page_text(F.col("n")).alias("text"), H.measures(F.col("n")).alias("m")).collect()
    return {r["id"]: (r["text"], r["m"]["words"], r["m"]["links"], r["m"]["photos"], r["m"]["strong"]) for r in rows}


def test_pages_of_the_tables(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = measured(spark, pages)
    for i, html in enumerate(pages):
        nodes = [n for n in plain(html)]
        title = next((k for k, n in enumerate(nodes) if n[0] == "title"), None)
        assert title is None or nodes[title][0] == "title"
        assert got[i] == known(nodes), html[:200]


@pytest.mark.parametrize("seed", range(3))
def test_broken_pages(spark, seed):
    rng = random.Random(seed)
    parts = ["<p>", "</p>", "<ul>", "<li>", "</li>", "</ul>", "<a href='x>y'>", "</a>", "<br>", "<img src=1 />", "<strong>", "</strong>", "<b>", "</div>", "<div>", "one two ", "&amp;&lt;b ", " ", "<table><tr><td>", "<tr>", "</table>", "<h2>", "</h2>", "<!-- <p> -->", "<script>if (a</p>b)</script>", "<blockquote>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", "just text", "<p>never closed <b>bold"]
    got = measured(spark, pages)
    for i, html in enumerate(pages):
        assert got[i] == known(plain(html)), html
