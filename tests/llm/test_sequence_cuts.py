import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import sequence_cuts as S
from marginalia.llm.queries import QUERIES
from marginalia.llm.tokenise import default_path, word_tokeniser


def padding(n, size):
    return 0 if n & (n - 1) == 0 else size - n


def best(at, cost, size):
    """The least cost of cuts up to each place, trying every window."""
    least = [0]
    for j in range(1, len(at)):
        least.append(min(least[i] + padding(int(at[j] - at[i]), size) for i in range(j) if at[j] - at[i] <= size) + int(cost[j]) + S.EACH)
    return least


def stream(rng, size, n):
    at = np.cumsum([0] + [rng.choice([1, 2, 3, 5, size // 8, size // 3, size]) for _ in range(n)])
    return at, np.array([0] + [rng.choice([0, 0, 16, 64]) for _ in range(n)])


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 64, 256])
    at, cost = stream(rng, size, rng.choice([1, 2, 30, 200]))
    least, back = S.settled(at, cost, size)
    assert least == best(at, cost, size)
    way = [0, *S.way_to(back, len(at) - 1)]
    assert sum(padding(int(at[b] - at[a]), size) + int(cost[b]) + S.EACH for a, b in zip(way, way[1:])) == least[-1]


@pytest.mark.parametrize("seed", range(20))
def test_a_stream_settles_the_best_cuts(seed):
    """Settling as it goes costs what one plan over all the stream does."""
    rng = random.Random(seed)
    size = 64
    s, rows, all_at, all_cost, base = S.Stream(0, size, 4, 10**6), [], [0], [0], 0
    for d in range(120):
        n = rng.choice([1, 7, 20, 64, 150])
        at = np.unique([*[rng.randint(1, n) for _ in range(n // 6)], *range(size, n, size), n])
        cost = np.array([0 if x == n else 16 for x in at])
        s.add(d, bytes(4 * n), at, cost)
        rows += s.flush()
        all_at, all_cost, base = [*all_at, *(at + base)], [*all_cost, *cost], base + n
    assert rows  # some were settled early
    rows += s.flush(last=True)
    more = np.setdiff1d(np.arange(base - size, base), all_at)
    at, cost = np.append(all_at, more), np.append(all_cost, np.full(len(more), S.SPLIT))
    order = np.argsort(at, kind="stable")
    least = best(at[order], cost[order], size)
    ends, doc_start, start_of = {}, {}, np.cumsum([0] + [sum(r[2] for r in rows if r[0] == d) for d in range(120)])
    for doc, start, length, _, _, sequence, offset, _ in rows:
        ends[sequence] = max(ends.get(sequence, 0), int(start_of[doc]) + start + length)
    price, before = dict(zip(at.tolist(), cost.tolist())), 0
    total = 0
    for k in sorted(ends):
        total += padding(ends[k] - before, size) + price[ends[k]] + S.EACH
        before = ends[k]
    assert before == base and total == least[-1]


def check(rows, texts, size):
    """Every id once, sequences gapless and in the order of the table; returns the share of padding."""
    encode = word_tokeniser(default_path()).tokenizer.encode
    left, seqs = {}, {}
    for doc_id, text in texts:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [S.END], "<u4")
        left.setdefault(doc_id, []).append(ids)
    pieces = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        seqs.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, got in pieces.items():
        want = left.pop(doc_id)
        found, at = [], 0
        for r in got:  # in the order of the table: a document's pieces stand one after the other
            assert r["start"] == at
            at = 0 if at + r["length"] == r["doc_tokens"] else at + r["length"]
            found.append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        assert at == 0 and sum(x[1] for x in found) == sum(map(len, want))
        if len(want) == 1:
            assert all(c == zlib.crc32(want[0][a : a + n].tobytes()) and t == len(want[0]) for a, n, c, t in found)
        else:
            whole = lambda x: sorted((len(y), zlib.crc32(y.tobytes())) for y in x)
            assert whole(want) == sorted((r["length"], r["ids_crc32"]) for r in got) or len(got) > len(want)
    assert not left
    lost = total = 0
    for got in seqs.values():
        at = 0
        for r in got:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        lost, total = lost + padding(at, size), total + at
    return lost / max(total, 1)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check(QUERIES["op11_order_preserving_packing"](spark, sf_dir).collect(), texts, S.SIZE) < 0.01
    spread = S.pack_in_order(docs.repartition(16, "doc_id"), order=["doc_id"]).collect()
    assert check(spread, texts, S.SIZE) < 0.05
    by_place = sorted(spread, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in by_place] == sorted(r["doc_id"] for r in spread)


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 5000), (5, "The end. It is 3.14. So"), (6, "x" * 3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("z") for c in ["length", "START", "offset", "ids"]})
    assert check(S.pack_in_order(df, 16).collect(), texts, 16) < 0.2
    assert S.pack_in_order(df.limit(0)).count() == 0
    rows = S.pack_in_order(df.where("doc_id = 5"), with_ids=True).collect()
    ids = np.frombuffer(b"".join(r["ids"] for r in sorted(rows, key=lambda r: r["start"])), "<u4")
    assert ids[-1] == S.END and sum(r["length"] for r in rows) == len(ids)


def test_sentences():
    own = word_tokeniser(default_path())
    ids = np.frombuffer(own.ids(['He said "go." It is 3.14 now! And so... on'])[0] + S.END.to_bytes(4, "little"), "<u4")
    at, cost = S.marks(default_path()).cuts(ids)
    ends = [own.tokenizer.decode(ids[a:b].tolist()).strip() for a, b in zip([0, *at], at)]
    assert ends == ['he said " go ."', "it is 3 . 1 4 now !", "and so ...", "on\x00"] or len(ends) == 4
    assert list(cost) == [S.SENTENCE] * 3 + [0]
    plain = np.frombuffer(own.ids(["word " * 2000])[0] + S.END.to_bytes(4, "little"), "<u4")
    at, cost = S.marks(default_path()).cuts(plain)
    assert np.diff(at, prepend=0).max() <= S.STRETCH and set(cost[:-1]) == {S.WORD}
    solid = np.frombuffer(own.ids(["x" * 5000])[0] + S.END.to_bytes(4, "little"), "<u4")
    at, cost = S.marks(default_path()).cuts(solid)
    assert np.diff(at, prepend=0).max() <= S.STRETCH
