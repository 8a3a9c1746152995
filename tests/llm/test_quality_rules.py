import re

from pyspark.sql import functions as F

from marginalia.llm import quality_rules as R
from marginalia.llm.queries import ORACLES, QUERIES


def test_same_as_sql(same):
    same(QUERIES["op3_line_frequency"], ORACLES["op3_line_frequency"])


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, cover = {}, set()
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            cover |= {p + d for p in places for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t ", "a b c a b c", "x x x x", "é ñ #$ é ñ #$\né ñ", "a\n\na\nb\r\na", "one two", "a b c d " * 3000, "no break line"]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    for r in R.line_quality(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(TEXTS[r["doc_id"]]), r["doc_id"]


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"Menu | Home\n{own(i, 60)}", "h") for i in range(40)] + [(99, "Menu  |  HOME\n" * 30, "h"), (100, f"Menu | Home\n{own(100, 60)}", None), (101, None, "h")]
    rows += [(200, f"copied line here\n{own(200, 60)}", "h")] * 40  # copies of one text are no evidence
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit(5)).withColumn("c", F.lit(1)).withColumn("lines", F.lit(2))
    out = {r["doc_id"]: r for r in R.line_quality(df, line_texts=20).collect()}
    assert out[3]["kept"] and out[3]["n_removed_lines"] == 1 and out[3]["clean_text"] == own(3, 60)
    assert not out[99]["kept"] and out[99]["n_removed_lines"] == 30
    assert out[100]["n_removed_lines"] == 0 and out[100]["kept"]
    assert out[200]["n_removed_lines"] == 0 and out[200]["kept"] and not out[101]["kept"] and out[3]["lines"] == 2
    assert R.line_quality(df.limit(0)).count() == 0


def test_the_limit_does_not_grow_with_the_host(spark):
    rows = [(i, f"Menu | Home\nonly w{i} here" if i < 25 else f"only w{i} here", "h") for i in range(6000)]
    out = R.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r["doc_id"] for r in out.where("n_removed_lines = 1").collect()) == list(range(25))


def test_documents_that_copy_a_text_count_each(spark):
    rows = [(i, "a copied line", "h") for i in range(21)] + [(100 + i, "another copied line", "h") for i in range(20)]
    rows += [(200, "a line of one document", "h")] * 40
    out = R.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in out.where("n_removed_lines = 1").collect()} == set(range(21))
