from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle as M
from marginalia.llm.queries import ORACLES, QUERIES


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(leaves):
    """The root of one tree, and the siblings of each leaf by level."""
    level, at, ways = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for way, i in zip(ways, at):
            start = i - i % 8
            way.append((level[start:i], level[i + 1 : start + 8]))
        at = [i // 8 for i in at]
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], ways


def expected(rows, hit, lower=str.lower):
    """doc_id, leaf, subroot, root, proof, folded of each row (doc_id, source, lang, n_chars, text), sorted."""
    name = lambda r: (r[2] is not None, (r[2] or "").encode())
    leaf = lambda r: H(*map(framed, r))
    rows = sorted(rows, key=lambda r: (name(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=name)]
    subs = [plain(list(map(leaf, g))) for g in groups]
    root, tops = plain([s for s, _ in subs]) if subs else (None, [])
    out = []
    for g, (sub, ways), top in zip(groups, subs, tops):
        for r, way in zip(g, ways):
            changed = hit(r[0]) and r[4] is not None
            now = H(*map(framed, (*r[:4], lower(r[4]) if changed else r[4])))
            for left, right in way + top:
                now = H(*left, now, *right)
            out.append((r[0], leaf(r), sub, root, H(*[x for a, b in way + top for x in a + b]), now))
    return sorted(out, key=repr)


def third(doc_id):
    return doc_id is not None and doc_id % 3 == 0


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(df, depth=M.DEPTH, **kw):
    return M.manifest(df, changed={"text": F.lower("text")}, when=F.col("doc_id") % 3 == 0, depth=depth, **kw)


def got(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trees_of_many_rounds(spark, depth):
    rows = [(i * 7 % 1201, f"s{i % 3}", ["en", "é", None, "", "z"][min(i % 9, 4)], i, f"Text {i}") for i in range(1201)]
    assert got(made(spark.createDataFrame(rows, SCHEMA), depth)) == expected(rows, third)


def test_repeated_rows_nulls_and_ties(spark):
    rows = [(3, "s", "en", 1, "Same")] * 700 + [(None, None, None, None, None)] * 20 + [(3, "s", "en", 1, "Other"), (4, "", "", 0, ""), (6, "a", "fr", 2, None), (9, "a", "fr", 10**6, "Ab " * 10**5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(made(df)) == expected(rows, third)
    clashing = df.withColumns({c: F.lit("x") for c in ["tree", "ord", "leaf", "block", "first", "n", "held", "root", "path", "TREES"]})
    assert got(made(clashing)) == expected(rows, third)
    assert made(df.limit(0)).count() == 0
    one = [(5, "s", "en", 1, "alone")]
    (r,) = made(spark.createDataFrame(one, SCHEMA)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == H()


def test_versions_share_all_but_their_path(spark):
    rows = [(i, "s", ["en", "fr"][i % 2], i, f"Text {i}") for i in range(300)]
    out = made(spark.createDataFrame(rows, SCHEMA), 1, with_versions=True).collect()
    for r in out:
        assert bool(r["version"]) == third(r["doc_id"]) and r["verified"] == (not third(r["doc_id"]))
        if r["version"]:  # the leaf, three levels to its language's root, one to the root of all
            assert len(r["version"]) == 5 and r["version"][-1] == r["folded_root"] != r["root"]


def test_block_versions():
    block = M.Block([H(str(i)) for i in range(100)], M.levels_of(100, 3))
    for i in (0, 7, 8, 63, 99):
        other = M.Block([H("new") if j == i else H(str(j)) for j in range(100)], 3)
        path = M.copied(H("new"), block.siblings(i))
        assert path[-1] == other.root and [level[i // 8**k] for k, level in enumerate(other.levels)] == path


def test_query(spark, sf_dir, same):
    same(QUERIES["op13_merkle_manifest"], ORACLES["op13_merkle_manifest"])
    rows = QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()
    assert {r["verified"] for r in rows} == {True, False} and len({r["root"] for r in rows}) == 1
