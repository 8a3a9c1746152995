"""Extra columns that bear the names that operators use for themselves, in lower and upper case, keep their values."""

import pytest
from pyspark.sql import functions as F

from marginalia.llm import language_id, mixing, near_dedup, quality_classifier, quality_rules, secrets, sharding, token_counts

NAMES = """row key host doc c h lines rows docs texts line n n_lines gone v found tokens domain epoch at part start last more uses epochs rest before cut over
held id none stays root class_id text_key sieve_part sieve_bits rank_bucket rank_rows rank_first shard slot grown_shard jumped order_0 score predicted
lang_pred made u edits spans n_base n_tested n_passed n_words kept clean_text base_failed token_leaves token_tree n_encoded __found __key __t given nr""".split()

ROWS = [(1, "one two three four five six", "en", "src1"), (2, "token = abcdefgh and words", None, "src2"), (None, None, "fr", None), (1, "one two three four five six", "en", "src1")]

OPERATORS = {
    "sharding": (lambda df, _: sharding.shard(df, "doc_id", 3), {"shard", "slot", "grown_shard"}),
    "language": (lambda df, _: language_id.identified(df, F.lit(True)), {"lang_pred", "score"}),
    "lines": (
        lambda df, _: quality_rules.line_quality(df),
        {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "clean_text", "kept"},
    ),
    "mixing": (lambda df, _: mixing.mix(df, budget_share=1.0), {"domain", "tokens", "epoch"}),
    "classes": (lambda df, _: near_dedup.classed(df), {"class_id"}),
    "copies": (lambda df, _: near_dedup.deduplicated(df), set()),
    "quality": (lambda df, spark: quality_classifier.scored(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")), {"score", "predicted"}),
    "counts": (lambda df, _: token_counts.with_edits(token_counts.with_trees(df), token_counts.masking(F.col("text"))), {"token_leaves", "token_tree", "n_encoded"}),
    "secrets": (lambda df, _: secrets.scan(df), {"spans", "n_base", "n_tested", "n_passed"}),
}


@pytest.mark.parametrize("case", [str.lower, str.upper])
@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_keep_their_values(spark, name, case):
    run, results = OPERATORS[name]
    extra = [case(n) for n in NAMES]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"my {c}") for c in extra})
    out = run(df, spark)
    lower = [c.lower() for c in out.columns]
    assert len(lower) == len(set(lower)) and set(lower) == {c.lower() for c in df.columns} | results
    rows = out.collect()
    assert rows and all(r[c] == f"my {c}" for r in rows for c in extra if c.lower() not in results)
