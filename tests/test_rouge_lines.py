"""ROUGE-Lsum compares no more lines than can change the result."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import evaluation


def plain_hits(refs, cans):
    left_ref, left_can, hits = Counter(t for s in refs for t in s), Counter(t for s in cans for t in s), 0
    for ref in refs:
        union = set().union(*(evaluation.lcs_positions(ref, can) for can in cans))
        for i in sorted(union):
            if left_ref[ref[i]] > 0 and left_can[ref[i]] > 0:
                hits += 1
                left_ref[ref[i]] -= 1
                left_can[ref[i]] -= 1
    return hits


def test_hits_equal_the_plain_definition():
    rng = random.Random(7)
    for _ in range(500):
        refs, cans = ([[rng.choice("abcdefg") for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(0, 5))] for _ in range(2))
        refs, cans = refs + refs[:rng.randint(0, 2)], cans + refs[:rng.randint(0, 2)]
        assert evaluation.summary_hits(refs, cans) == plain_hits(refs, cans)


def test_lines_that_add_no_wanted_token_are_not_compared(monkeypatch):
    """Forty lines that share words, each with a prediction that misses some: one comparison a line is enough."""
    rng = random.Random(8)
    refs = [[f"w{rng.randint(0, 60)}" for _ in range(40)] for _ in range(40)]
    cans = [[w for i, w in enumerate(line) if i % 7 != 3] for line in refs]
    calls, positions = [], evaluation.lcs_positions
    monkeypatch.setattr(evaluation, "lcs_positions", lambda ref, can: calls.append(1) or positions(ref, can))
    assert evaluation.summary_hits(refs, cans) == sum(map(len, cans))
    assert len(calls) <= 2 * len(refs)


def test_texts_are_normalized_byte_by_byte(spark):
    """As the pattern ``[^a-z0-9\\n]+`` does on lower-cased text, but without a pattern: it took most of the time."""
    texts = ["A b,c\nD-9", "", "İx K1 ä\U0001f600z", "\n\n a\t\r\nb ", "ΣΣ  end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = rows.selectExpr("i", "lower(t) AS low", "regexp_replace(lower(t), '[^a-z0-9\\n]+', ' ') AS plain").collect()
    for row in both:
        new, old = ([line.split() for line in x.split("\n")] for x in (evaluation.rouge_lines(row["low"]), row["plain"]))
        assert new == old
    pairs = spark.createDataFrame([(1, "a b", None), (2, "A, b\nc", "a b\nC!")], "k int, p string, r string")
    scored = evaluation.rouge_l(pairs, "k", F.col("p"), F.col("r"))
    assert "regexp" not in scored._jdf.queryExecution().toString()
    assert {r["k"]: (r["rouge_l"], r["rouge_lsum"]) for r in scored.collect()} == {1: (0.0, 0.0), 2: (1.0, 1.0)}
