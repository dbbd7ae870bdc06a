"""Perplexity under an add-one bigram model that Spark counts from a training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.functions.text import words
from corpusloom.plans.skew import lookup
from corpusloom.session import materialize


def model_tokens(text: Column) -> Column:
    return words(F.lower(text))


def _bigrams(tokens: Column) -> Column:
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.arrays_zip(F.slice(t, 1, n).alias("a"), F.slice(t, 2, n).alias("b"))

    return let(tokens, pairs)


#: Texts whose words are numbered together.
TEXTS_AT_ONCE = 512


def gram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, n)``: how often each word ``a`` occurs (``b`` is null) and is followed by ``b``.

    Grams are counted within a few texts in Arrow, in one pass; only their partial counts become rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                split = pc.ascii_split_whitespace(batch.column(0).slice(first, TEXTS_AT_ONCE).fill_null(""))
                flat, of = split.flatten(), pc.list_parent_indices(split)
                kept = pc.not_equal(flat, "")
                found, of = flat.filter(kept).dictionary_encode(), of.filter(kept).to_numpy()
                words_, width = found.indices.to_numpy().astype(np.int64), max(len(found.dictionary), 1)
                inside = of[:-1] == of[1:]
                pairs, n = np.unique(words_[:-1][inside] * width + words_[1:][inside], return_counts=True)
                single = np.bincount(words_, minlength=len(found.dictionary))
                following = found.dictionary.take(pa.array(pairs % width))
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([found.dictionary, found.dictionary.take(pa.array(pairs // width))]),
                    pa.concat_arrays([pa.nulls(len(single), following.type), following]),
                    pa.array(np.concatenate([single, n]), pa.int64()),
                ], names=["a", "b", "n"])

    counted = rows.select(F.lower(text)).mapInArrow(run, "a string, b string, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def unigram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return gram_counts(rows, text).where("b is null").select("a", F.col("n").alias("c_a"))


def bigram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return gram_counts(rows, text).where("b is not null").select("a", "b", F.col("n").alias("c_ab"))


def perplexity(train: DataFrame, test: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, n_bigrams, perplexity)``; the first token of a text has no bigram.

    ln p splits into ln(c_ab + 1) - ln(c_a + V), so bigrams and their first words are
    looked up side by side: common ones on the map side, rare ones through a shuffle.
    A bigram that training never saw adds ln 1 = 0 to the first part.
    """
    # Both counts are read more than once; they are taken in one pass and written first.
    grams = materialize(gram_counts(train, text), "grams")
    unigrams = materialize(grams.where("b is null").select("a", F.col("n").alias("c_a")), "unigrams")
    bigrams = grams.where("b is not null").select("a", "b", F.col("n").alias("c_ab"))
    size = unigrams.agg(F.count("*").alias("v")).scalar()
    # So are the bigrams of the texts: two lookups read them.
    seen = test.select(key, F.explode(_bigrams(model_tokens(F.col(text)))).alias("g")).groupBy(
        key, F.col("g.a").alias("a"), F.col("g.b").alias("b")
    ).agg(F.count("*").alias("k"))
    seen = materialize(seen, "seen")
    pairs = lookup(seen, bigrams, ["a", "b"], "c_ab").groupBy(key).agg(
        F.sum("k").cast("long").alias("n_bigrams"),
        F.sum(F.col("k") * F.ln(F.coalesce("c_ab", F.lit(0)) + 1)).alias("_up"),
    )
    firsts = seen.groupBy(key, "a").agg(F.sum("k").alias("k"))
    firsts = lookup(firsts, unigrams, ["a"], "c_a").groupBy(key).agg(
        F.sum(F.col("k") * F.ln(F.coalesce("c_a", F.lit(0)) + size)).alias("_down")
    )
    return pairs.join(firsts, key).select(
        key, "n_bigrams", F.exp((F.col("_down") - F.col("_up")) / F.col("n_bigrams")).alias("perplexity")
    )
