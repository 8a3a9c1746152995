"""Landed records as items, texts for models, clean addresses, and what replies and audits make of odd rows."""

import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import mappers as R
from marginalia.operators import resolve
from marginalia.plans import quality as A
from marginalia.plans import search as S

RECORD = "id long, type string, html_url string, url string, title string, name string, description string, body string, topics array<string>, language string, state string, private boolean, fork boolean"


def test_repository_rows_by_type(spark):
    base = (None, "u", "", "n", "d", "b", ["x", "go", "", None], "Go", "open", False, True)
    rows = {r["type"]: r for r in R.repository_rows(spark.createDataFrame([(i, t, *base) for i, t in enumerate(["repo", "pr", "issue", "gist", "release", "starred", "other"])], RECORD)).collect()}
    assert {t: r["content"] for t, r in rows.items()} == {"repo": "d", "gist": "d", "starred": "d", "pr": "b", "issue": "b", "release": "b", "other": "No content"}
    assert rows["repo"]["tags"] == ["x", "go", "repo", "public", "fork"] and rows["pr"]["tags"] == ["x", "go", "pr", "open"]
    assert rows["gist"]["tags"] == ["x", "go", "gist", "public"] and rows["starred"]["tags"] == ["x", "go", "starred"]
    assert (rows["repo"]["title"], rows["repo"]["url"]) == ("n", "u")
    empty = R.repository_rows(spark.createDataFrame([(1, "repo", *[None] * 11)], RECORD)).first()
    assert (empty["title"], empty["content"], empty["tags"], empty["url"]) == ("Untitled", "No description", ["repo", "public"], None)
    assert R.repository_rows(spark.createDataFrame([], RECORD)).count() == 0


BLOCK = """id long, class string, base_class string, title string, generated_title string, description string, content string, source struct<url: string, title: string>,
    attachment struct<url: string>, embed struct<url: string, title: string, thumbnail_url: string>, image struct<original: string, large: string, display: string, square: string, thumb: string>"""


def test_block_rows_by_class(spark):
    rows = [
        (1, "Image", "Block", None, "gen", None, "c", None, None, None, (None, "large", "display", None, "thumb")), (2, "TEXT", None, "t", None, "d", "c", None, ("file",), None, None),
        (3, "Link", "Block", "t", None, None, "c", ("src", "source title"), None, None, None), (4, "Media", "Block", "t", None, "", None, None, None, ("emb", "embedded", "pic"), None),
        (5, None, None, None, None, "d", "c", None, None, None, None), (6, "Channel", "Block", "t", None, "d", "c", ("", None), ("file",), ("emb", None, "pic"), None),
    ]
    got = {r["item_id"][-1]: r for r in R.block_rows(spark.createDataFrame(rows, BLOCK)).collect()}
    assert [got[k]["content"] for k in "123456"] == ["gen", "c", "source title", "embedded", "No content", "c"]
    assert [got[k]["url"] for k in "123456"] == ["https://www.are.na/block/1", "file", "src", "emb", "https://www.are.na/block/5", "file"]
    assert [got[k]["image_url"] for k in "123456"] == ["large", "file", None, "pic", None, "file"]
    assert (got["2"]["tags"], got["5"]["tags"], got["5"]["title"]) == (["text"], [], "Untitled Block")


def test_cached_fetch(spark):
    cache = spark.createDataFrame([(1, "old", 1), (2, "old", 2), (9, "old", 3)], "hash long, state string, at long")
    remote = spark.createDataFrame([(i, "new", i) for i in range(1, 6)], "hash long, state string, at long")
    got = lambda *a, **k: {r["hash"]: r["state"] for r in R.cached_fetch(cache, remote, "hash", "at", *a, **k).collect()}
    remote = remote.withColumn("at", F.timestamp_seconds("at"))
    cache = cache.withColumn("at", F.timestamp_seconds("at"))
    assert got("a", "a") == got("a", None) == {1: "old", 2: "old", 9: "old"}
    assert got(None, "a") == dict.fromkeys(range(1, 6), "new")
    assert got("a", "b", newest_rows=2) == {1: "old", 2: "old", 4: "new", 5: "new", 9: "old"}
    assert got("a", "b", newest_rows=4)[2] == "new"


def test_union_keeps_the_order_of_lists(spark):
    lists = [spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([5, 6], [1, 2], [0])]
    assert [r["id"] for r in R.union_of(lists, F.col("id"), 3).orderBy("list", "id").collect()] == [5, 6, 1]
    assert R.union_of(lists, F.col("id")).count() == 5


def test_line_tags(spark):
    df = spark.createDataFrame([("#a b\n ## c \n\n#\nd#e\r",), ("",), (None,)], "r string")
    assert [r[0] for r in df.select(R.line_tags(F.col("r"))).collect()] == [["a b", "# c", "de"], [], None]


#: Addresses and their standard forms.
CLEAN = {
    "example.com": "https://example.com/", " http://EXAMPLE.com/A ": "http://example.com/A", "http://a.org:80/x": "http://a.org/x", "https://a.org:80/x": "https://a.org:80/x", "https://a.org:443": "https://a.org/",
    "http://a.org?q=1#f": "http://a.org/?q=1#f", "http://a.org/a/../b/./c": "http://a.org/b/c", "http://a.org/a/b/..": "http://a.org/a/", "http://a.org/../..": "http://a.org/", "http://a.org/%2e%2e/x": "http://a.org/x",
    "http://a.org/é b?x=ü": "http://a.org/%C3%A9%20b?x=%C3%BC", "http://a.org/a//b": "http://a.org/a//b", "http://user:pw@A.org/": "http://user:pw@a.org/", "http://a.org:8080": "http://a.org:8080/",
    "http://a.org:70000/": None, "http://a b/": None, "": None, "   ": None, "http://": None, None: None, "HTTP://a.org/x": "https://http//a.org/x", "http://a.org/..a/.b": "http://a.org/..a/.b", "http://a.org\\x": "http://a.org/x",
    "http://a.org/x#a b": "http://a.org/x#a%20b", "http:///a.org/x": "http://a.org/x", "http://a.org/a'b?c'd": "http://a.org/a'b?c%27d", "http://a.org/~+%20": "http://a.org/~+%20",
}


def test_clean_urls(spark):
    rows = spark.createDataFrame([(u,) for u in CLEAN], "u string").select("u", T.clean_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == CLEAN


def test_clean_urls_again_are_the_same(spark):
    urls = [u for u in CLEAN.values() if u]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.clean_url(F.col("u"))).collect()] == urls
    path = "/".join(["x y", "é", "ok"])
    assert spark.createDataFrame([("a.org/" + path,)], "u string").select(T.clean_url(F.col("u"))).first()[0] == "https://a.org/" + quote(path)


ASSET = "array<struct<ticker: string, name: string, sentiment: double, context: string, mentions: array<string>>>"


def test_reply_assets(spark):
    a = lambda t, s=0.5, c="told at length", m=None, n=None: (t, n, s, c, m)
    rows = [
        ([a("AAPL", 3.0), a("ZZZ"), a("BTC", None, "Not mentioned", ["BTC"]), a("BTC", -9.0, "", ["n/a", "bitcoin"])], [a(f"X{i}") for i in range(14)] + [a("AAPL")]),
        (None, [a("Q", 1.0, "ab"), a("R", 1.0, None, ["none", " "]), a("", 1.0), a(None), a("BTC-USD", 0.0, None, ["it"])]), ([], None), (None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, f"t {ASSET}, d {ASSET}").select(resolve.reply_assets(F.col("t"), F.col("d"), {"AAPL": "Apple", "BTC": "Bitcoin"})).collect()]
    assert [(x["ticker"], x["name"], x["sentiment"], x["mentions"]) for x in got[0][:2]] == [("AAPL", "Apple", 1.0, ["AAPL"]), ("BTC", "Bitcoin", -1.0, ["n/a", "bitcoin"])]
    assert [x["ticker"] for x in got[0][2:]] == [f"X{i}" for i in range(10)] and not any(x["is_tracked"] for x in got[0][2:])
    assert [(x["ticker"], x["asset_type"]) for x in got[1]] == [("BTC-USD", "crypto")] and got[2] == [] and got[3] is None


def test_places_are_promoted(spark):
    found = spark.createDataFrame(
        [(1, 0, "nowhere", 0.9), (1, 1, "half", 0.8), (1, 2, "b", 0.7), (1, 3, "a", 0.7), (2, 0, "a", 0.2), (3, 0, "a", 0.5), (3, 1, "b", 0.5), (4, 0, "nowhere", 0.9), (5, 0, "half", 0.9), (5, 1, " ", 1.0), (5, 2, "a", None)],
        "id long, n int, name string, confidence double",
    )
    gazetteer = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0), ("half", 5.0, None)], "name string, latitude double, longitude double")
    got = {r["id"]: (r["location"], r["others"], r["promoted"]) for r in resolve.placed_items(found, gazetteer).collect()}
    assert got == {1: ("b", ["a"], True), 3: ("a", ["b"], False), 4: (None, [], False), 5: ("half", [], False)}
    assert resolve.placed_items(found.limit(0), gazetteer).count() == 0


def test_truthy(spark):
    df = spark.createDataFrame([("", 0, 0.0, False, []), ("x", 2, float("nan"), True, None), (None, None, None, None, [1]), (" ", -1, 0.5, True, [])], "s string, n long, d double, b boolean, a array<int>")
    got = df.select(*[S.truthy(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [(False, False, False, False, True), (True, True, False, True, False), (False, False, False, False, True), (True, True, True, True, True)]


@pytest.mark.parametrize("asked", ["The cat!", "cat  the", "", "c'at", "dog"])
def test_all_terms(spark, asked):
    texts = ["the Cat sat", "the catalogue", "", None, "THE-CAT"]
    words = re.sub(r"[^\w\s]", "", asked).lower().split()
    want = [bool(words) and t is not None and set(words) <= set(re.split(r"\W+", t.lower())) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.all_terms(F.col("t"), asked)).collect()] == want


def test_item_faults(spark):
    fine = dict(item_id="a-1", source="pinboard", type="bookmark", url="https://a.org", title="t", content="c", published_at="1", created_at="1", updated_at="1", shared=True, tags=["x"], metadata="{}", screenshot_url=None, relationships=None, location="L", latitude=1.0, longitude=1.0)
    good, bad = '{"source": {"type": "P", "name": "n"}, "type": "T", "target": {"type": "O", "name": "m"}}', '{"source": {"type": "P", "name": ""}, "type": "T", "target": "x"}'
    cases = [
        ({}, "", ""), ({"title": None, "url": None}, "Missing required field: url|Missing required field: title|Invalid URL format", ""), ({"metadata": "{} x"}, "metadata must be type object", ""), ({"metadata": "[1]"}, "", ""),
        ({"source": "rss", "type": "post"}, "Invalid source: rss|Invalid type: post", ""), ({"screenshot_url": "http://x/shots/1"}, "Screenshot URL must be HTTPS|Invalid screenshot URL path format", ""),
        ({"source": "arena", "type": "block", "screenshot_url": "http://x"}, "", ""), ({"relationships": f"[{good}, {bad}, {{}}]"}, "Invalid relationship structure at index 1|Invalid relationship structure at index 2", ""),
        ({"location": None}, "", "Location missing but coordinates present"), ({"location": None, "latitude": None, "longitude": 0.0}, "", ""),
    ]
    kinds = "item_id string, source string, type string, url string, title string, content string, published_at string, created_at string, updated_at string, shared boolean, tags array<string>, metadata string, screenshot_url string, relationships string, location string, latitude double, longitude double"
    df = spark.createDataFrame([tuple((fine | c)[k.split()[0]] for k in kinds.split(", ")) for c, *_ in cases], kinds)
    got = df.select(F.array_join(A.item_errors(), "|"), F.array_join(A.item_warnings(), "|")).collect()
    assert [tuple(r) for r in got] == [(e, w) for _, e, w in cases]
