"""The stages against plainer versions of what they decide."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from marginalia.llm import mixing as M


def test_stages_keep_clean_documents_and_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, out := spark.read.parquet(str(tmp_path / name)))
        docs = out
        assert name == P.STAGES[-1][0] or out.columns == names
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = kept["quality classifier"]
    left = {r["doc_id"] for r in after.collect()}
    known = [r["doc_id"] for r in before.collect() if r["doc_id"] in labels]
    assert sum((d in left) == (labels[d] == 1) for d in known) >= 0.95 * len(known)
    from marginalia.llm import quality_classifier as C
    from test_quality_classifier import plain_score

    model = C.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in before.orderBy("n_chars").limit(40).collect():
        s = plain_score(model, r["text"])
        assert abs(s - C.THRESHOLD) < 1e-4 or (r["doc_id"] in left) == (s >= C.THRESHOLD)

    from test_near_dedup import brute

    before, after = kept["MinHash near-dedup"]
    assert {r["doc_id"] for r in after.collect()} == set(brute([(r["doc_id"], r["text"]) for r in before.collect()]).values())

    from test_secrets import base

    before, after = kept["secret scans"]
    texts = {r["doc_id"]: r for r in before.collect()}
    for r in after.collect():
        found, old = base(texts[r["doc_id"]]["text"]), texts[r["doc_id"]]
        assert (r["text"] == old["text"]) if not found and "[SECRET]" not in r["text"] else "[SECRET]" in r["text"]
        assert not base(r["text"]) and r["n_chars"] == len(r["text"]) and r["lang"] == old["lang"]
    assert after.count() == before.count()

    before, after = kept["mixing sources to target weights"]
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == plain_mix(before.collect())

    before, after = kept["best-fit packing"]
    assert after.where("piece = 0").count() == before.count()
    uses = Counter(r["doc_id"] for r in before.collect())
    assert Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == uses
    assert {(r["doc_id"], r["epoch"]) for r in after.where("piece = 0").collect()} == {(d, e) for d, n in uses.items() for e in range(n)}
    sequences = {}
    for r in after.collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u2" if len(r["ids"]) == 2 * r["length"] else "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], {})[r["offset"]] = ids
    for parts in sequences.values():
        ends = [(at, at + len(ids)) for at, ids in sorted(parts.items())]
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] <= 4096


def plain_mix(rows):
    """How often each document is used, by the rule as it is stated: budgets down the tree, then prefixes of epochs."""
    name = lambda x: x or ""
    number = lambda s: int(m[0]) % 4 if (m := re.search(r"[0-9]{1,9}$", name(s))) else 0
    leaf = lambda r: (f"d{number(r['source'])}", name(r["lang"]), name(r["source"]))
    size = lambda r: -(-len(r["text"] or "") // 4)
    held = Counter()
    for r in rows:
        held[leaf(r)] += size(r)
    weight = lambda level, x: M.WEIGHTS[M.LEVELS[level]].get(x, 1)
    given = {}

    def share(prefix, budget):
        level = len(prefix)
        if level == 3:
            given[prefix] = budget
            return
        caps = Counter()
        for k, n in held.items():
            if k[:level] == prefix:
                caps[k[level]] += n * M.MAX_EPOCHS
        left, open_ = budget, sorted(caps, key=lambda x: (Fraction(caps[x], weight(level, x)), x))
        while open_ and caps[open_[0]] * sum(weight(level, x) for x in open_) <= weight(level, open_[0]) * left:
            share((*prefix, open_[0]), caps[open_[0]])
            left -= caps[open_.pop(0)]
        total = sum(weight(level, x) for x in open_)
        for x in open_:
            share((*prefix, x), left * weight(level, x) // total)

    share((), min(int(sum(held.values()) * M.BUDGET_SHARE), sum(held.values()) * M.MAX_EPOCHS))
    out = Counter()
    for k, budget in given.items():
        epochs = budget // held[k] if held[k] else 0
        rest = budget - epochs * held[k]
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        at = lambda r: md5(f"{M.SEED}|{epochs}|{r['doc_id']}|{md5(r['text'] or '')}")[:15]
        for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: (at(r), r["doc_id"])):
            rest -= size(r)
            out[r["doc_id"], r["text"]] += epochs + (rest >= 0)
    return +out


def test_run(spark, sf_dir):
    before = spark.conf.get(P.BATCH)
    assert P.run(spark, sf_dir).count() > 0 and spark.conf.get(P.BATCH) == before


def test_batches_are_bounded_and_smaller_settings_stand(spark):
    before = spark.conf.get(P.BATCH)
    try:
        for given, then in ((10_000, 1000), (0, 1000), (-1, 1000), (1000, 1000), (10, 10)):
            spark.conf.set(P.BATCH, given)
            with P.bounded(spark):
                assert int(spark.conf.get(P.BATCH)) == then
            assert int(spark.conf.get(P.BATCH)) == given
    finally:
        spark.conf.set(P.BATCH, before)


ROWS = [
    (1, None, "en", "src1"), (2, "", None, None), (3, "token = abcdef1234 and some more plain words here", "en", "src2"), (3, "token = abcdef1234 and some more plain words here", "en", "src2"),
    (4, "a plain text of several words that says nothing", "fr", "src3"), (None, "one more text of several other words", "fr", "src3"), (5, "long words " * 20_000, "de", "x"),
]
CLASHING = ("row", "given", "key", "held", "tokens", "epoch", "spans", "ids", "domain", "score", "Found", "__c", "more")


def test_edges_of_every_stage(spark, tmp_path):
    spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(ROWS, schema).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"my {c}") for c in CLASHING})
    for name, stage in P.STAGES:
        for given in (docs, docs.drop("n_chars"), docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            if name != P.STAGES[-1][0]:
                assert out.columns == given.columns and all(r[c] == f"my {c}" for r in rows for c in CLASHING)
        if name == "secret scans":
            out = stage(spark, docs, str(tmp_path)).collect()
            assert len(out) == len(ROWS) and all((r["n_chars"] or 0) == len(r["text"] or "") for r in out)
            assert sorted((r["text"] or "")[:8] for r in out if r["doc_id"] == 3) == ["[SECRET]"] * 2
