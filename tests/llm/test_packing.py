import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing as P
from marginalia.llm.queries import QUERIES
from marginalia.llm.tokenise import WordTokeniser, default_path


@pytest.fixture(scope="module")
def own():
    return WordTokeniser(default_path())


def test_ids_are_the_tokenizers_own(own):
    random.seed(1)
    signs = "aAbB'sStTéÉßÿÀ×÷ªº²¼ \n\t\x1c\x85\xa0İıſḰ中文<|endoftext|>9!?.,µ-_"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    texts += ["it's IT'S we'LL <|endoftext|> x<|startoftext|>y", "", "wordwordword" * 500]
    for got, want in zip(own.ids(texts), own.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got == np.array(want.ids, "<u4").tobytes()


def test_small_tables_change_nothing(own, monkeypatch):
    from marginalia.llm import tokenise

    monkeypatch.setattr(tokenise, "CACHE", 20)
    small = WordTokeniser(default_path())
    texts = [f"word{i} the {chr(97 + i % 26) * 3}, again {i}" for i in range(300)]
    for at in range(0, 300, 10):
        assert small.ids(texts[at : at + 10]) == own.ids(texts[at : at + 10])


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    random.seed(seed)
    size = random.choice([10, 64, 4096])
    lengths = [random.randint(1, size) if random.random() < 0.7 else size for _ in range(random.choice([0, 1, 5, 300, 2000]))]
    counts, ranks, seqs = Counter(lengths), {}, {}
    for length, first, n, sequence, offset in P.plan(counts, size):
        for i in range(n):
            ranks.setdefault(length, []).append(first + i)
            seqs.setdefault(sequence + i, []).append((offset, length))
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
    for placed in seqs.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    bins = []
    for length in sorted(lengths, reverse=True):
        k = bisect_left(bins, length)
        insort(bins, (bins.pop(k) if k < len(bins) else size) - length)
    assert len(bins) == len(seqs)


def check(rows, texts, size):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(default_path()), Counter()
    for doc_id, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [P.END], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            x = ids[at : at + size]
            want[doc_id, k, at, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in seqs.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


def test_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op6_best_fit_packing"](spark, sf_dir).collect()
    least = -(-sum(r["length"] for r in rows) // P.SIZE)
    assert least <= check(rows, texts, P.SIZE) <= least + 2


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 5000), (5, "the end")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("z")).withColumn("rank", F.lit(1))
    check(P.pack(df, 16).collect(), texts, 16)
    assert P.pack(df.limit(0)).count() == 0
    ids = {r["doc_id"]: r["ids"] for r in P.pack(df.where("doc_id = 5"), with_ids=True).collect()}
    assert ids[5][-1] == P.END and len(ids[5]) == 3


def test_fewer_entries_give_the_same_ids():
    texts = [f"word{i} other{i % 7} Ünïcode {i}!" for i in range(300)]
    few, many = WordTokeniser(default_path(), 10), WordTokeniser(default_path())
    assert [few.ids(texts[i : i + 20]) for i in range(0, 300, 20)] == [many.ids(texts[i : i + 20]) for i in range(0, 300, 20)]
    assert max(len(few.chunks), len(few.pieces)) <= 10 < len(many.chunks)


def test_ids_of_mixed_batches_are_the_tokenizers_own(own):
    """Contractions, odd pieces and empty texts in any order, each text with its own ids."""
    random.seed(2)
    parts = ["'s", "'S", "''s", "'re", "'Ll", "'l", "'t's", "it's", "x're'", "' s", "3.14", "²½", "ÉÀß", "ŒUVRE", "“Quote”", "中文", "e\u0301", "<|endoftext|>", "<|", "\t", "\x01", "\x02", "\x85", "\xa0", "\r\n", "\n\n", " ", "", "...!?", "µª", "x" * 70]
    texts = [random.choice(["", " "]).join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)] + [None, "", None]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for size in (1, 7, len(texts)):
        assert [x for at in range(0, len(texts), size) for x in own.ids(texts[at : at + size])] == want
    assert own.ids([]) == [] and own.ids([None]) == own.ids([""]) == [b""]


def test_a_lot_of_characters_ends_between_texts(own, monkeypatch):
    from marginalia.llm import tokenise

    texts = [f"some words, number {i} — and {'more ' * (i % 9)}" if i % 7 else None for i in range(100)]
    want = own.ids(texts)
    monkeypatch.setattr(tokenise, "AT_ONCE", 50)
    assert own.ids(texts) == want


def test_a_word_is_kept_once(monkeypatch):
    """neither its case nor the signs around it make a word an entry of its own that is encoded or looked up apart."""
    from marginalia.llm import tokenise

    own, seen = WordTokeniser(default_path()), []
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda x: seen.extend(x) or encode(x))
    words = ["alpha", "béta", "gamma"]
    forms = [f(w) for w in words for f in (str, str.upper, str.title)]
    texts = [f"{a}{x}{b}" for x in forms for a in ("", "(", '"', "$$") for b in ("", ",", "!!", ")", '"', "%%%")]
    own.ids(texts)
    own.ids(texts[::-1])
    assert len(seen) == len(set(seen)) == 3 + 7  # the words and the runs of signs
    assert len(own.chunks) + len(own.pieces) <= 11
    few = WordTokeniser(default_path(), 10)
    few.ids(["a b c d e f g h — “i” “j” “k” “l” " + str(k) for k in range(10)])
    assert len(few.chunks) + len(few.pieces) <= 10
