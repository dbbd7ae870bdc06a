"""Evaluation: held-out prompts, generation, pairing by key, metric suites."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.payloads import BATCH_SAMPLING, completion_payload
from corpusloom.functions.prompts import test_prompt
from corpusloom.operators.evaluation import (
    MAX_ORDER, bleu, combine, corpus_stats, gram_stats, rouge_l, rouge_n, sacrebleu, tokens_13a, tokens_rouge,
)
from corpusloom.operators.generation import call_model, with_answer
from corpusloom.operators.language_model import perplexity
from corpusloom.operators.sampling import with_split
from corpusloom.session import materialize


def held_out_predictions(rows: DataFrame, key: str, model: str, make_client,
                         sampling: Mapping[str, object] = BATCH_SAMPLING, **split) -> DataFrame:
    """``(key, prompt, generated_text, reference_text, status)`` for the test split."""
    test = with_split(rows, key, **split).where("split = 'test'")
    prompts = test.select(
        key, test_prompt(F.col("instruction"), F.col("input")).alias("prompt"), F.col("output").alias("reference_text")
    )
    body = completion_payload(F.col("prompt"), F.lit(model), sampling)
    answered = with_answer(call_model(prompts.withColumn("payload", body), "payload", make_client), "completion")
    return answered.select(key, "prompt", "generated_text", "reference_text", "status")


def metric_suites(pairs: DataFrame, key: str, prediction: str = "generated_text",
                  reference: str = "reference_text", training: DataFrame | None = None) -> DataFrame:
    """BLEU, ROUGE, sacreBLEU and, given training texts, perplexity of a table of pairs in long form."""
    p, r = F.col(prediction), F.col(reference)
    # Several metrics read the per-order sums: a few numbers, written once.
    grams = materialize(corpus_stats(gram_stats(pairs, key, tokens_13a(p), tokens_13a(r), range(1, MAX_ORDER + 1))), "grams")
    rouge = rouge_n(gram_stats(pairs, key, tokens_rouge(p), tokens_rouge(r), (1, 2)), key).groupBy().agg(
        F.avg(F.when(F.col("n") == 1, F.col("f"))).alias("rouge1"),
        F.avg(F.when(F.col("n") == 2, F.col("f"))).alias("rouge2"),
    )
    longest = rouge_l(pairs, key, p, r).agg(F.avg("rouge_l").alias("rougeL"), F.avg("rouge_lsum").alias("rougeLsum"))
    suites = [("bleu", bleu(grams)), ("rouge", rouge), ("rouge", longest), ("sacrebleu", sacrebleu(grams))]
    if training is not None:
        texts = pairs.select(key, p.alias("text"))
        scored = perplexity(training.select("text"), texts, key)
        suites.append(("perplexity", scored.agg(F.avg("perplexity").alias("mean_perplexity"))))
    return combine(*suites)
