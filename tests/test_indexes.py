"""Written indexes: equal to scans, of every row, and read in the asked folders alone."""

import random
from collections import Counter
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from marginalia.operators import fulltext as T
from marginalia.operators import ivf
from marginalia.operators import related as R
from marginalia.plans import indexes as I
from marginalia.plans import related as P
from marginalia.sources.items import AS_OF, items


def folders(df, column):
    """The values of a partition column that the scans of a plan still read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(rf"{column}#\d+ (?:IN|INSET) \(?([\d, ]+)\)?|{column}#\d+ = (\d+)", plan)), plan


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return I.texts(spark, sf_dir)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fulltext"))
    T.build(texts, f"{path}/i", 16)
    return T.opened(spark, f"{path}/i")


def test_index_and_scan_agree(spark, sf_dir, texts, index):
    asked = I.benchmark(spark, sf_dir).unionByName(
        spark.createDataFrame([(9001, "The AND, of!"), (9002, "no-such-word"), (9003, " ?! "), (9004, None), (9005, "la la LA")], "query_id long, text string")
    )
    found = T.matching(index, asked, 7)
    assert rows(found) == rows(T.matching_by_scan(texts, asked, 7)) and found.where("query_id = 9001").count() > 0
    assert not {9002, 9003, 9004} & {r["query_id"] for r in found.collect()}


def test_only_the_asked_folders_are_read(spark, index):
    asked = spark.createDataFrame([(1, "the")], "query_id long, text string")
    _, postings = T.asked(index, asked)
    kept, every = len(postings.inputFiles()), len(index.postings.inputFiles())
    read, plan = folders(postings, "part")
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in postings.select("part").distinct().collect()} == {spark.range(1).select(T.part(F.lit("the"), 16)).first()[0]} and kept <= every


def test_terms_and_edges(spark):
    data = [(1, "Größe größe GRÖSSE x1", None), (2, None, None), (3, "", None), (1, "again größe", None)]
    made = T.build(spark.createDataFrame(data, "id long, text string, created_at timestamp_ntz"))
    assert {(r["term"], r["id"], r["n"], r["length"]) for r in made.postings.collect()} == {
        ("größe", 1, 2, 4), ("grösse", 1, 1, 4), ("x1", 1, 1, 4), ("again", 1, 1, 2), ("größe", 1, 1, 2)
    }
    empty = T.build(spark.createDataFrame([], "id long, text string, created_at timestamp_ntz"))
    asked = spark.createDataFrame([(1, "größe")], "query_id long, text string")
    assert T.best(empty, asked).count() == 0 and T.matching(empty, asked).count() == 0 and T.best(made, asked).count() == 1


def test_tag_index_answers_one_seed(spark, sf_dir, tmp_path):
    i = items(spark, sf_dir)
    index = R.tag_index(i, str(tmp_path / "tags"))
    every = {}
    for r in P.by_tags(spark, sf_dir).collect():
        every.setdefault(r["seed_id"], set()).add((r["id"], r["overlap"], r["rank"]))
    assert every
    for r in P.seeds(i).collect():
        assert {(x["id"], x["overlap"], x["rank"]) for x in R.by_tag_index(r["tags"], r["id"], index, AS_OF).collect()} == every.get(r["id"], set())
    one = R.by_tag_index(["thanedble", "ofonrereer"], 0, index, AS_OF)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "tag" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_hot_and_repeated_tags(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_A_SALT", 7)
    rng = random.Random(3)
    data = [(i, rng.choices("abcdefghijkl", [40, 20, 9, 5, 4, 3, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 6))) for i in range(120)] + [(200, None), (201, [])]
    df = spark.createDataFrame([(i, t, "2024-01-20") for i, t in data], "id long, tags array<string>, d string").withColumn("published_at", F.col("d").cast("timestamp_ntz"))
    own = {i: set(t or []) for i, t in data if i % 10 == 0}
    want = {(s, i, n) for s, tags in own.items() for i, t in data if i != s and (n := sum(x in tags for x in t or [])) >= 2}
    got = R.tag_overlaps(df.where("id % 10 = 0"), df, AS_OF)
    assert {(r["seed_id"], r["id"], r["overlap"]) for r in got.collect()} == want and want


def recall(exact, found):
    want = {(r["seed_id"], r["id"]) for r in exact.collect()}
    have = {(r["seed_id"], r["id"]) for r in found.collect()}
    return len(want & have) / max(1, len(want)), len(have - want)


def test_cells_find_nine_of_ten(spark):
    sf = "/root/testdata/sf0.01"  # too few vectors in the smallest tables for cells to matter
    i = items(spark, sf, "embedding")
    share, _ = recall(P.by_embedding(spark, sf), I.by_cells(spark, sf))
    assert share >= 0.9
    index = ivf.build(i)
    assert index.rows.count() == i.where("embedding IS NOT NULL").count()  # every vector is in a cell
    assert recall(P.by_embedding(spark, sf), ivf.similar(P.seeds(i), index, I.after(), least=0.2, probes=len(index.centroids))) == (1.0, 0)


def test_groups_need_few_cells_and_hot_ones_are_cut(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12 if i % 3 else 0] + 0.05 * rng.normal(size=16)).tolist() for i in range(900)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8]
    df = spark.createDataFrame([(i, v, "2024-01-20") for i, v in enumerate([*vectors, *bad, vectors[0]])], "id long, embedding array<double>, d string")
    df = df.withColumn("published_at", F.col("d").cast("timestamp_ntz"))
    index = ivf.build(df, str(tmp_path / "i"))
    assert index.probes <= 6 < len(index.centroids) and index.rows.count() == 901
    seeds = df.where("id % 50 = 0")
    exact = R.by_embedding(seeds.where("id < 900"), df.where("id < 900 OR id = 904"), AS_OF, 20)
    share, more = recall(exact, ivf.similar(seeds, index, I.after(), 20, block_bytes=2000))
    assert share >= 0.9
    ties = {(r["seed_id"], r["id"]): r["similarity"] for r in exact.collect()}
    assert (0, 904) in ties and abs(ties[0, 904] - 1) < 1e-9
    assert ivf.similar(seeds, ivf.build(df.limit(0)), I.after()).count() == 0


def test_pairs_of_frequent_tags_are_counted_without_being_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_TAGS", 50)
    rng = random.Random(4)
    data = [(i, ["hot", "warm", *rng.choices("abcdef", k=rng.randint(0, 5))], rng.choice(["2024-01-20", "2024-01-21"])) for i in range(150)]
    df = spark.createDataFrame(data, "id long, tags array<string>, d string").withColumn("published_at", F.col("d").cast("timestamp_ntz"))
    pairs = {}
    for s, own, _ in data[::10]:
        for i, tags, d in data:
            if i != s:
                pairs.setdefault(s, []).append((-sum(t in own for t in tags), -int(d[-2:]), i, "|".join(sorted(set(own) & set(tags)))))
    seeds = df.where("id % 10 = 0")
    best = {(r["seed_id"], r["rank"]): (r["id"], r["overlap"]) for r in R.by_tags(seeds, df, AS_OF, 3).collect()}
    assert best == {(s, k + 1): (p[2], -p[0]) for s, found in pairs.items() for k, p in enumerate(sorted(found)[:3])}
    assert {tuple(r) for r in R.overlap_sums(seeds, df, AS_OF).collect()} == {(s, len(found), -sum(p[0] for p in found)) for s, found in pairs.items()}
    assert {tuple(r) for r in R.shared_tags(seeds, df, AS_OF).collect()} == {(s, p[2], p[3]) for s, found in pairs.items() for p in found}


def test_a_tile_orders_its_tags_once_for_all_lots(monkeypatch):
    sorts, sort = [], pc.sort_indices
    monkeypatch.setattr(R.pc, "sort_indices", lambda *args, **how: sorts.append(1) or sort(*args, **how))
    monkeypatch.setattr(R, "CELLS", 40)
    monkeypatch.setattr(R, "COUNTS", 40, raising=False)
    rng = random.Random(9)
    own = {s: sorted({*rng.choices(["b", "a", "é", "c c", "d"], k=4)}, key=lambda t: rng.random()) for s in range(7)}
    other = {i: rng.choices(["b", "a", "é", "x", "c c"], k=rng.randint(0, 6)) for i in range(100)}
    batch = lambda rows: pa.RecordBatch.from_pydict({"id": list(rows), "tags": list(rows.values())}, pa.schema([("id", pa.int64()), ("tags", pa.list_(pa.string()))]))
    tile = R.Tile([batch(own)], None, 2)
    lots = list(tile.shared(batch(other)))
    got = [tuple(r.values()) for lot in lots for r in lot.to_pylist()]
    assert len(lots) > 5 and len(sorts) == 1
    assert sorted(got) == [(s, i, "|".join(sorted({*tags} & {*own[s]}))) for s in own for i, tags in other.items() if s != i and sum(t in own[s] for t in tags) >= 2]


def test_tags_of_found_items_are_counted_by_blocks_of_seeds(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_SEEDS", 3)
    rng = random.Random(6)
    tags = {i: rng.choices(["b", "a", "é", "d", None], k=rng.randint(0, 4)) for i in range(30)} | {30: None, 31: []}
    found = [(s, i) for s in range(20) for i in rng.sample(sorted(tags), 5)] + [(20, 31), (21, 99)]
    counts = {s: Counter(t for x, i in found if x == s for t in tags.get(i) or [] if t) for s, _ in found}
    want = {(s, t, n, r + 1) for s, c in counts.items() for r, (t, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2])}
    got = R.common_tags(spark.createDataFrame(found, "seed_id long, id long"), spark.createDataFrame(list(tags.items()), "id long, tags array<string>"), 2)
    assert {tuple(r) for r in got.collect()} == want and want


def test_searches_by_small_lots_and_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(T, "LOT_ROWS", 40)
    monkeypatch.setattr(T, "BROADCAST_ROWS", 9)
    rng = random.Random(8)
    data = [(i, " ".join(rng.choices("abcdef", [30, 20, 9, 4, 2, 1], k=rng.randint(0, 9))), rng.choice(["2024-01-20", "2024-01-21", None])) for i in [*range(90), None]]
    data += [data[5], data[5], data[-1]]  # repeated rows are one item
    df = spark.createDataFrame(data, "id long, text string, d string").withColumn("created_at", F.col("d").cast("timestamp_ntz"))
    asked = spark.createDataFrame([(q, rng.choice(["a b", "a c", "b e", "f zz", "c", ""])) for q in range(30)], "query_id long, text string")
    made = T.build(df)
    once = df.dropDuplicates()
    assert rows(T.matching(made, asked, 4)) == rows(T.matching_by_scan(once, asked, 4)) and T.matching(made, asked, 4).count()
    held = {i: (Counter(t.split()), len(t.split())) for i, t, _ in data}
    plain = T.best(T.build(once), asked, 4)
    mean, n = sum(size for _, size in held.values()) / len(held), len(held)
    having = Counter(t for c, _ in held.values() for t in c)
    want = set()
    for q, text in asked.collect():
        own = {t for t in text.split() if having[t]}
        weigh = {i: sum(np.log(1 + (n - having[t] + 0.5) / (having[t] + 0.5)) * c[t] * (T.K1 + 1) / (c[t] + T.K1 * (1 - T.B + T.B * size / mean)) for t in own if t in c) for i, (c, size) in held.items() if own & set(c)}
        want |= {(q, i, r + 1) for r, i in enumerate(sorted(weigh, key=lambda i: (-round(weigh[i], 9), i is not None, i or 0))[:4])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in plain.collect()} == want


def test_no_join_brings_texts_beside_embeddings(spark, sf_dir, monkeypatch):
    """Vectors apart give what vectors in the items give, null ones and repeated rows included, and the query takes them apart."""
    rows = [(i, "2024-01-20", ["a", "b"] + ["c"] * (i % 3) if i != 9 else None, None if i % 7 == 0 else [float(i % 5), 1.0]) for i in [*range(20), 5]]
    df = spark.createDataFrame(rows, "id long, d string, tags array<string>, embedding array<float>").withColumn("published_at", F.col("d").cast("timestamp_ntz"))
    found = lambda items, **how: sorted(map(tuple, R.hybrid(items.where("id < 6"), items, AS_OF, 4, **how).collect()), key=repr)
    assert found(df) == found(df.drop("embedding"), vectors=df.select("id", "embedding")) != []
    seen, own = [], R.hybrid
    monkeypatch.setattr(R, "hybrid", lambda *args: seen.append(args) or own(*args))
    P.Q["related_hybrid_G9c"](spark, sf_dir)
    assert "Join" not in seen[0][1]._jdf.queryExecution().optimizedPlan().toString()
