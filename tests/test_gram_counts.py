"""Words and pairs of words of the bigram model are counted before they become rows."""

from __future__ import annotations

from collections import Counter

from corpusloom.operators.language_model import bigram_counts, gram_counts, unigram_counts

TEXTS = ["A b a b", "a", None, "", " \t b\x0bA\n\nb ", "ä Ä Σ a", "a b" + " a b" * 2000]


def plain(texts) -> tuple[Counter, Counter]:
    one, two = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").lower().replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
        one.update(words)
        two.update(zip(words, words[1:]))
    return one, two


def test_counts_equal_the_plain_definition(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS * 200], "text string").repartition(3)
    one, two = plain(TEXTS * 200)
    assert {r["a"]: r["c_a"] for r in unigram_counts(rows).collect()} == one
    assert {(r["a"], r["b"]): r["c_ab"] for r in bigram_counts(rows).collect()} == two
    assert gram_counts(rows.where("false")).count() == 0


def test_no_row_for_each_word(spark):
    plan = bigram_counts(spark.createDataFrame([("a b",)], "text string"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
