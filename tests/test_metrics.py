import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.evaluation import (
    bleu, clipped_matches, combine, corpus_stats, gram_stats, lcs_length, lcs_positions, log_metrics, metric_log, rouge_l, rouge_n,
    sacrebleu, score_lines, summary_hits, tokens_13a, tokens_rouge, unpaired,
)
from corpusloom.operators.language_model import perplexity
from corpusloom.plans.model_eval import metric_suites
from corpusloom.plans.skew import lookup
from corpusloom.session import scratch_path
from tests.conftest import plan_of


def table(prefix, ref, can):
    t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(can) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == can[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def walk(ref, can):
    t, i, j, out = table("", ref, can), len(ref), len(can), set()
    while i and j:
        if ref[i - 1] == can[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_lcs_matches_the_full_table():
    rng = random.Random(6)
    for _ in range(400):
        ref = [rng.choice("abcd") for _ in range(rng.randint(0, 15))]
        can = [rng.choice("abcde") for _ in range(rng.randint(0, 15))]
        assert lcs_length(ref, can) == table("", ref, can)[-1][-1]
        assert lcs_positions(ref, can) == walk(ref, can)


def test_summary_score_by_hand():
    # Union over sentences: w1 w2 from the first, w1 w3 w5 from the second.
    _, lsum = score_lines("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")
    assert lsum == pytest.approx(2 * 4 / 15)


def test_clipped_matches_by_counting():
    rng = random.Random(7)
    for _ in range(100):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2 * rng.randint(1, 4))]
        got = clipped_matches(texts, [1, 2, 3, 4])
        for k in range(len(texts) // 2):
            for n in (1, 2, 3, 4):
                p, r = (Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in texts[2 * k:2 * k + 2])
                assert got[k][n - 1] == sum((p & r).values())


def test_13a_tokens(spark):
    text = "It cost 3.5, or 4-5 units. x-\nray 3."
    got = spark.createDataFrame([(text,)], ["t"]).select(tokens_13a(F.col("t")).alias("v")).first().v
    assert got == ["It", "cost", "3.5", ",", "or", "4", "-", "5", "units", ".", "xray", "3", "."]


def pairs(spark, rows):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], "id int, p string, r string")


def scores(spark, rows):
    stats = corpus_stats(gram_stats(pairs(spark, rows), "id", tokens_13a(F.col("p")), tokens_13a(F.col("r")), (1, 2, 3, 4)))
    return bleu(stats).first(), sacrebleu(stats).first()


def test_perfect_prediction(spark):
    b, s = scores(spark, [("a b c d e", "a b c d e")])
    assert b.bleu == pytest.approx(1) and s.score == pytest.approx(100)
    f = rouge_n(gram_stats(pairs(spark, [("a b c", "a b c")]), "id", tokens_rouge(F.col("p")), tokens_rouge(F.col("r")), (1, 2)), "id")
    assert {r.f for r in f.collect()} == {1.0}


def test_no_four_gram_match(spark):
    b, s = scores(spark, [("a b c x e f g", "a b c d e f g")])
    assert b.bleu == 0 and s.score > 0
    # 6/7, 4/6, 2/5 and the smoothed 1/(2*4)
    expected = 100 * math.exp((math.log(6 / 7) + math.log(4 / 6) + math.log(2 / 5) + math.log(1 / 8)) / 4)
    assert s.score == pytest.approx(expected)


def test_longer_prediction_has_no_penalty(spark):
    b, _ = scores(spark, [("a b c d e f", "a b c d")])
    assert b.brevity_penalty == 1 and b.length_ratio == 1.5


def test_empty_prediction(spark):
    b, s = scores(spark, [("", "a b c d")])
    assert (b.bleu, s.score) == (0, 0)
    l = rouge_l(pairs(spark, [("", "a b"), ("", "")]), "id", F.col("p"), F.col("r"))
    assert {(r.rouge_l, r.rouge_lsum) for r in l.collect()} == {(0.0, 0.0)}
    assert perplexity(pairs(spark, [("a", "x y")]), pairs(spark, [("", "b")]), "id", "p").count() == 0


def test_regression_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 = 0")
    ref = docs.select("doc_id", tokens_13a(F.col("text")).alias("r"))
    for keep, score, penalty in ((lambda x, i: i % 7 != 3, 0.641406697, 0.846366973), (lambda x, i: i % 2 == 0, 0.051342234, 0.368558325)):
        rows = ref.withColumn("p", F.filter("r", keep))
        got = bleu(corpus_stats(gram_stats(rows, "doc_id", F.col("p"), F.col("r"), (1, 2, 3, 4)))).first()
        assert round(got.bleu, 9) == score and round(got.brevity_penalty, 9) == penalty


def test_counting_needs_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stats = gram_stats(docs, "doc_id", words(F.col("text")), words(F.lower("text")), (1, 2))
    plan = plan_of(stats)
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_perplexity_by_hand(spark):
    train = spark.createDataFrame([(1, "a b a b c")], "id int, text string")
    test = spark.createDataFrame([(2, "a b c"), (3, "z a"), (4, "a")], "id int, text string")
    got = {r.id: (r.n_bigrams, r.perplexity) for r in perplexity(train, test, "id").collect()}
    # V = 3; p(b|a) = (2+1)/(2+3), p(c|b) = (1+1)/(2+3), p(a|z) = 1/3
    assert got[2][1] == pytest.approx(math.exp(-(math.log(3 / 5) + math.log(2 / 5)) / 2))
    assert got[3] == (1, pytest.approx(3.0)) and 4 not in got


def test_lookup_beyond_the_head(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).where("k < 900")
    got = lookup(facts, dim, ["k"], "n", head_rows=10)
    assert dim.where(F.col("n") * 10 >= dim.agg(F.sum("n")).scalar()).count() == 1
    assert got.count() == 1000
    want = facts.join(dim, "k", "left")
    assert got.select("id", "k", "n").exceptAll(want.select("id", "k", "n")).count() == 0


def test_unpaired(spark):
    got = {r.side: r.n for r in unpaired(spark.range(0, 5), spark.range(3, 10), "id").collect()}
    assert got == {"both": 2, "prediction_only": 3, "reference_only": 5}


def test_combined_names(spark):
    row = spark.createDataFrame([(0.5, 3)], "a double, b int")
    got = {(r.suite, r.metric): r.value for r in combine(("x", row), ("y", row)).collect()}
    assert got == {("x", "x_a"): 0.5, ("x", "x_b"): 3.0, ("y", "y_a"): 0.5, ("y", "y_b"): 3.0}


def test_suites(spark):
    rows = pairs(spark, [("a b c d e", "a b c d e")]).withColumnsRenamed({"p": "generated_text", "r": "reference_text"})
    training = spark.createDataFrame([("a b c d e",)], "text string")
    got = {r.metric: r.value for r in metric_suites(rows, "id", training=training).collect()}
    assert got["perplexity_mean_perplexity"] == pytest.approx(3.0)  # p = 2 / 6 for every bigram
    assert got["bleu_bleu"] == pytest.approx(1) and got["sacrebleu_score"] == pytest.approx(100)
    assert got["rouge_rougeL"] == got["rouge_rougeLsum"] == got["rouge_rouge1"] == 1


def test_logging_twice_counts_once(spark):
    path = scratch_path(spark, "t-log")
    rows = spark.createDataFrame([("bleu", "bleu_score", 1.0), ("bleu", "bleu_bp", 0.5)], "suite string, metric string, value double")
    log_metrics(rows, path, "007", 10)
    log_metrics(rows, path, "a/b=c d", 10)
    log_metrics(rows, path, "007", 20)
    log_metrics(rows.where("metric = 'bleu_score'").withColumn("value", F.lit(2.0)), path, "007", 10)
    got = sorted((r.run, r.step, r.metric, r.value) for r in metric_log(spark, path).collect())
    assert got == [
        ("007", 10, "bleu_score", 2.0), ("007", 20, "bleu_bp", 0.5), ("007", 20, "bleu_score", 1.0),
        ("a/b=c d", 10, "bleu_bp", 0.5), ("a/b=c d", 10, "bleu_score", 1.0),
    ]
    with pytest.raises(ValueError):
        log_metrics(rows, path, "", 1)


def test_line_matches_equal_the_full_table():
    """Positions by the whole table and its ties, on lines with repeats, gaps and words of one side only."""
    def positions(ref, can):
        table = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
        for i, a in enumerate(ref, 1):
            for j, b in enumerate(can, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if a == b else max(table[i - 1][j], table[i][j - 1])
        i, j, found = len(ref), len(can), set()
        while i and j:
            if ref[i - 1] == can[j - 1]:
                found.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i - 1][j] == table[i][j]:
                i -= 1
            else:
                j -= 1
        return found, table[-1][-1]

    rng = random.Random(4)
    for _ in range(3_000):
        words = "abcdefgh"[:rng.randint(1, 8)]
        refs = [[rng.choice(words + "z") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        cans = [[rng.choice(words + "xy") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        cans.append([w for w in refs[0] if rng.random() < 0.8] or ["q"])
        refs.append(list(rng.choice(refs)))
        assert (lcs_positions(refs[0], cans[0]), lcs_length(refs[0], cans[0])) == positions(refs[0], cans[0])
        left_ref, left_can = Counter(w for r in refs for w in r), Counter(w for c in cans for w in c)
        hits = 0
        for ref in refs:
            for i in sorted(set().union(*(positions(ref, can)[0] for can in cans))):
                if left_ref[ref[i]] > 0 and left_can[ref[i]] > 0:
                    hits += 1
                    left_ref[ref[i]] -= 1
                    left_can[ref[i]] -= 1
        assert summary_hits(refs, cans) == hits
