"""Hand-made cases of the functions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import measures as M
from marginalia.functions import text as T
from marginalia.operators import changes as C
from marginalia.operators import graph as G
from marginalia.operators import related as R
from marginalia.operators.folds import running_totals
from marginalia.sources import items as I


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.slug, {"The Times's “A”": "the-timess-a", "--": "", " a  b ": "a-b"}),
        (T.predicate_token, {"worksFor": "WORKS_FOR", "based in!": "BASED_IN", "": ""}),
        (T.entity_name, {"  'Tim  Cook' ": "'Tim Cook'", '"A"': "A", "a b": "a b", None: ""}),
        (T.junk_name, {"x": True, "Home": True, "$5 million": True, "https://a": True, "Apple Inc.": False, "--": True}),
        (T.generic_actor, {"masked agents": True, "Officers": True, "Jane Doe": False}),
        (T.human_name, {"Tim Cook": True, "tim cook": False, "Tim": False}),
        (T.asset_type, {"btc": "crypto", "EURUSD=X": "forex", "^GSPC": "index", "SPY": "etf", "GC=F": "commodity", "AAPL": "stock", "": "unknown"}),
        (T.real_place, {"Cape Town": True, "Webster": False, "x": False, None: False}),
        (T.host, {"http://WWW.Example.com/a": "example.com", "nothing": "", None: ""}),
        (T.url_title, {"https://a.org/x/my-page_one.html": "My page one", "https://www.a.org/": "a.org", "": None}),
        (T.video_id, {"https://youtu.be/abcdefghijk": "abcdefghijk", "https://a.org": None}),
        (T.without_markdown, {"**a** [b](c) `d`": "a b d", "# T\nx": "T x"}),
        (T.tolerant_json, {'```json\n{"a": 1}\n```': '{"a": 1}', 'so: {"b": 2} ok': '{"b": 2}', "none": None}),
        (T.balanced_json, {'{"a": [1, {"b": "c': '{"a": [1, {"b": "c"}]}', "none": None, '[{"x": 1},': '[{"x": 1}]'}),
        (G.canonical_type, {"ORG": "Organization", "Person": "Person", "software": "Tool", "thing": None, "": None}),
    ],
)
def test_text(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_content_types(spark):
    df = spark.createDataFrame([("https://a.org/news/x", "t"), (None, "How to x"), ("https://arxiv.org/1.pdf", ""), ("https://a.org", None)], "u string, t string")
    assert [r[0] for r in df.select(T.content_type(F.col("u"), F.col("t"))).collect()] == ["news", "tutorial", "research", "article"]


def test_summary_titles(spark):
    rows = [("• A bullet that is long enough\nmore", ""), ("Short. Rest", ""), ("A first sentence. Then", ""), ("", "https://a.org/some-page"), ("x" * 120, None)]
    df = spark.createDataFrame(rows, "s string, u string")
    got = [r[0] for r in df.select(T.summary_title(F.col("s"), F.col("u"))).collect()]
    assert got == ["A bullet that is long enough", "Short. Rest", "A first sentence", "Some page", "x" * 97 + "..."]


def test_distances(spark):
    row = spark.range(1).select(
        M.haversine_miles(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)), M.haversine_miles(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), M.cosine(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))),
        M.clamped(F.lit(None).cast("double"), 0, 1), M.half_up(F.lit(-2.5)),
    ).first()
    assert row[0] == pytest.approx(2445.5, abs=1) and row[1] is None and row[2] == pytest.approx(0.7071, abs=1e-4)
    assert row[3] == 0.0 and row[4] is None and row[5] == -2.0


def test_overlap_counts_duplicates_of_the_row(spark):
    row = spark.range(1).select(M.overlap(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))), M.overlap(F.lit(None).cast("array<string>"), F.array(F.lit("a")))).first()
    assert tuple(row) == (2, 0)


def test_near_by_wraps_round_the_globe_and_takes_zero_for_a_place(spark):
    rows = [(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 0.0, 0.0), (4, 0.01, 0.01), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    found = {(r["seed_id"], r["id"]) for r in R.near_by(df, df, 5.0).collect()}
    assert found == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_predicate_aliases():
    tokens = {t: (p, r) for t, p, r in G.predicate_tokens()}
    assert tokens["RUNS"] == ("OPERATES", False) and tokens["FUNDED_BY"] == ("FUNDS", True) and tokens["LEADS"] == ("LEADS", False)
    assert len(G.predicate_tokens()) == len(tokens)


def test_projection_invariants(spark, sf_dir):
    i = I.items(spark, sf_dir)
    assert G.evidence(i).count() == 3 * G.projection(i).count()
    assert G.unresolved(G.evidence(i), G.entities(i), G.claims(i)).count() == 0
    dangling = G.evidence(i).limit(3).withColumn("target_key", F.lit("claim:gone"))
    assert G.unresolved(dangling, G.entities(i), G.claims(i)).count() == 3


def test_relationships_keep_columns_named_as_their_fields(spark):
    raw = """[{"source": {"name": "A", "type": "Person"}, "type": "LEADS", "target": {"name": "B", "type": "Project"}}, {"source": "C", "target": "D", "relationship": "owns"}]"""
    df = spark.createDataFrame([(1, "github", "repo", raw), (2, "arena", "block", raw)], "id long, source string, type string, relationships string")
    rows = G.exploded(df, "id", "source", "type").select("id", "source", "type", "subject", "subject_type", "label", "object").collect()
    told = [("A", "Person", "LEADS", "B"), ("C", None, "owns", "D")]
    assert sorted(map(tuple, rows), key=repr) == [(*kept, *t) for kept in ((1, "github", "repo"), (2, "arena", "block")) for t in told]
    assert {r["node"]: r["sources"] for r in G.node_sources(df).collect()}["Person::a"] == ["arena", "github"]


def test_upsert_is_idempotent_and_takes_new_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, x string, v int")
    new = spark.createDataFrame([(2, "c", 2, True), (3, "d", 2, False)], "id int, x string, v int, y boolean")
    once = C.upsert(old, new, "id", I.greatest("v"))
    twice = C.upsert(once, new, "id", I.greatest("v"), F.col("x"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(once) == rows(twice) == [(1, "a", 1, None), (2, "c", 2, True), (3, "d", 2, False)]
    assert sorted(map(tuple, C.upsert_columns(old, new.select("id", F.lit(None).cast("string").alias("x"), "v"), "id").collect())) == [(1, "a", 1), (2, "b", 2), (3, None, 2)]
    assert C.delete_where(old, F.lit(None).cast("boolean")).count() == 2
    assert C.insert_missing(old, new, "id").count() == 3


def test_running_totals(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), 10 * h + m, 1 + m) for h in range(3) for m in range(4)], "ts timestamp_ntz, id int, v int")
    got = [r["t"] for r in running_totals(df, F.date_trunc("hour", "ts"), ["ts", "id"], "v", "t").orderBy("ts").collect()]
    want, total = [], 0
    for r in df.orderBy("ts").collect():
        total += r["v"]
        want.append(total)
    assert got == want


def test_mappers(spark):
    b = spark.createDataFrame([("h", "http://a", "d", "", "x  y", "2024-01-01T00:00:00Z", "yes", "no")], "hash string, href string, description string, extended string, tags string, time string, shared string, toread string")
    row = I.bookmarks(b).first()
    assert (row["item_id"], row["content"], row["tags"], row["shared"], row["to_read"]) == ("pinboard-h", "d", ["x", "y"], True, False)
    s = spark.createDataFrame([("1", "u", "<p>Hi</p><p>there</p>", "2024-01-01T00:00:00Z", None, ["Art"], "public")], "id string, url string, content string, created_at string, edited_at string, tags array<string>, visibility string")
    row = I.statuses(s).first()
    assert (row["content"], row["tags"], row["updated_at"]) == ("Hi there", ["art", "public"], row["created_at"])
    tries = spark.createDataFrame([("u", 1, "x" * 10), ("u", 2, "y" * 600), ("u", 3, "z" * 900), ("v", 1, "ab"), ("v", 2, "cd")], "url string, tier int, content string")
    assert {r["url"]: r["tier"] for r in I.best_extraction(tries).collect()} == {"u": 2, "v": 1}
    assert I.merged_fetch(b, b.withColumn("description", F.lit("old")).unionByName(b.withColumn("hash", F.lit("k")))).count() == 2


def test_relationship_and_finance_scores(spark):
    from marginalia.plans import quality as P

    good = '{"source": {"name": "Org", "type": "o"}, "type": "OWNS", "target": {"name": "Tool", "type": "t"}}'
    flat = '{"source": "Person", "target": "Org", "relationship": "worksFor"}'
    short = good.replace("Org", "X")
    values = [None, "[]", f"[{good}]", f"[{good}, {flat}]", f"[{flat}]", f"[{short}]", f"[{flat}, {flat}, {flat}, {flat}]"]
    assert column(spark, values, P.relationships_score) == [50, 50, 100, 70, 30, 60, -60]
    assert column(spark, [None, "", "A Price list", "$5", "words"], P.finance_score) == [100, 100, 30, 30, 100]


def test_json_in_replies(spark):
    from marginalia.functions import rules as R

    rows = [('so: {"a": [1]} ok', ), ("none",), ('[1, 2] {"ticker": "A", "x": 1} {"ticker": broken} {"ticker": "B"}',), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(R.first_json(F.col("t")).alias("o"), R.first_json(F.col("t"), "[").alias("l"), R.salvaged(F.col("t"), "ticker").alias("s")).collect()
    assert [r["o"] for r in got] == ['{"a":[1]}', None, None, None] and [r["l"] for r in got] == ["[1]", None, "[1,2]", None]
    assert got[2]["s"] == ['{"ticker": "A", "x": 1}', '{"ticker": "B"}']


def test_what_is_filled(spark):
    from marginalia.functions import rules as R

    df = spark.createDataFrame([(" ", [], 0, None), ("x", ["a"], None, {"k": 1})], "s string, a array<string>, n int, m map<string,int>")
    assert [tuple(r) for r in df.select(*[R.filled(F.col(c), t) for c, t in df.dtypes]).collect()] == [(False, False, True, False), (True, True, False, True)]


def test_json_with_more_behind_it_is_none(spark):
    from marginalia.functions import rules as R

    good = ['{"a":1}', ' {"a": [1, {"b": "}"}]} ', "[]", "null", "1.5", '"x"', '{"extra": "keep", "n2": 2.5, "seen": [1]}']
    bad = ['{"a":1} tail', '{"a":1}}', '{"a":1}]', "1, 2", '1,"b":2', '{"a":1},"b":2', "", " ", "{", "{'a':1}", '1] x', '1} x', "nul"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, None]], "t string")
    got = {r["t"]: r for r in df.select("t", T.is_json(F.col("t")).alias("ok"), F.to_json(T.parsed_json(F.col("t"))).alias("v"), R.json_with(F.col("t"), "seen", F.lit("9")).alias("w")).collect()}
    assert {t for t, r in got.items() if r["ok"]} == set(good) and got[None]["ok"] is None
    assert all(got[t]["v"] is None for t in bad) and json.loads(got[good[1]]["v"]) == json.loads(good[1])
    assert json.loads(got[good[-1]]["w"]) == {"extra": "keep", "n2": 2.5, "seen": "9"} and got["[]"]["w"] is None
    firsts = spark.createDataFrame([('so: {"a":1} then',), ('{"a":1}} x }',)], "t string").select(R.first_json(F.col("t")).alias("j")).collect()
    assert [r["j"] for r in firsts] == ['{"a":1}', None]


def test_attributes_of_tags(spark):
    from marginalia.functions import rules as R

    html = """<meta content='1' property=og:title><META NAME="Description" content="x>y"/><meta name=description content=z><metadata name="q"><meta charset="u">
        <script type="application/ld+json">{"a": [1]}</script><script type='application/ld+json' id="b>">{"a": </script><script>{"a": 2}</script>"""
    r = spark.createDataFrame([(html,), (None,)], "h string").select(R.meta_tags(F.col("h")).alias("m"), R.linked_data(F.col("h")).alias("d")).collect()
    assert r[0]["m"] == {"og:title": "1", "description": "x>y"} and r[0]["d"] == ['{"a": [1]}'] and r[1]["m"] is None


def test_clean_tags_take_the_first_spelling(spark):
    from marginalia.functions import rules as R

    reply = "Data, data, tools\ntools,AI,ai,x,two words,!urgent,bookmark"
    assert spark.createDataFrame([(reply,)], "t string").select(R.clean_tags(F.col("t")).alias("t")).first()["t"] == ["tools", "tools", "ai", "ai", "!urgent"]


def test_clean_tags_of_a_long_reply(spark):
    from marginalia.functions import rules as R

    reply = "Tool0," + ",".join(f"tool{i % 3000}" for i in range(20_000))  # minutes, when each part split the reply again
    got = spark.createDataFrame([(reply,), (None,)], "t string").select(R.clean_tags(F.col("t")).alias("t")).collect()
    assert got[0]["t"] == [f"tool{i % 3000}" for i in range(20_000) if i % 3000] and got[1]["t"] is None
