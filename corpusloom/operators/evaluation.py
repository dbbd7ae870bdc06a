"""Corpus metrics of generated text against references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words

MAX_ORDER = 4

# The public "13a" tokenizer rules, in order.
_REPLACED = (("<skipped>", ""), ("-\n", ""), ("\n", " "),
             ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_SPACED = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "), (r"([^0-9])([\.,])", r"$1 $2 "),
           (r"([\.,])([^0-9])", r" $1 $2"), (r"([0-9])(-)", r"$1 $2 "))


def tokens_13a(text: Column) -> Column:
    for old, new in _REPLACED:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, spaced in _SPACED:
        text = F.regexp_replace(text, pattern, spaced)
    return words(text)


def tokens_rouge(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return words(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


# -- pairing ----------------------------------------------------------------


def pair(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Predictions and references of the same key."""
    return predictions.join(references, key)


def unpaired(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """``(side, n)``: keys that only one side has."""
    left = predictions.select(key, F.lit(1).alias("p"))
    right = references.select(key, F.lit(1).alias("r"))
    side = F.when(F.col("r").isNull(), "prediction_only").when(F.col("p").isNull(), "reference_only").otherwise("both")
    return left.join(right, key, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


# -- n-gram counts ----------------------------------------------------------


def clipped_matches(texts: Sequence[Sequence[str]], orders: Sequence[int]) -> np.ndarray:
    """Clipped n-gram matches per pair (rows) and order (columns).

    ``texts`` alternates prediction and reference tokens of one pair after the other.
    N-grams are numbered from the numbers of shorter ones, so equal numbers mean equal
    n-grams; a match counts as often as both sides have it.
    """
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    pairs = len(texts) // 2
    out = np.zeros((pairs, len(orders)), dtype=np.int64)
    words_, vocabulary = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words_))  # words up to the text's end
    grams = words_.astype(np.int64)
    for n in range(1, max(orders) + 1):
        if n > 1:
            grams = pd.factorize(grams[:-1] * (len(vocabulary) + 1) + words_[n - 1:])[0]
        if n not in orders or not len(grams):
            continue
        inside = left[:len(grams)] >= n
        text = text_of[:len(grams)][inside]
        width = int(grams.max()) + 1
        found, keys = pd.factorize((text // 2) * width + grams[inside])
        predicted = np.bincount(found[text % 2 == 0], minlength=len(keys))
        referred = np.bincount(found[text % 2 == 1], minlength=len(keys))
        out[:, orders.index(n)] = np.bincount(keys // width, np.minimum(predicted, referred), minlength=pairs)[:pairs]
    return out


PAIRS_AT_ONCE = 256


def _match_udf(orders: Sequence[int]):
    orders = list(orders)

    @F.arrow_udf("array<long>")
    def matches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Only the texts of some pairs at a time become Python objects, however large Spark's batches are.
        for predictions, references in batches:
            for first in range(0, len(predictions), PAIRS_AT_ONCE):
                part = (side.slice(first, PAIRS_AT_ONCE).to_pylist() for side in (predictions, references))
                texts = [t.split(" ") if t else [] for pair_ in zip(*part, strict=True) for t in pair_]
                yield pa.array(list(clipped_matches(texts, orders)), pa.list_(pa.int64()))

    # Declared non-deterministic so that the optimizer never copies the call.
    return matches.asNondeterministic()


def gram_stats(pairs: DataFrame, key: str, prediction: Column, reference: Column,
               orders: Sequence[int]) -> DataFrame:
    """``(key, n, matches, total, ref_total)`` per pair and order.

    A pair is one row that holds both texts, so its n-grams are counted where the
    row is: n-grams, many times larger than the texts, never exist as rows and
    never cross the network. Only the counts of a pair leave its task.
    """
    tokens = pairs.select(key, prediction.alias("p"), reference.alias("r"))
    counted = tokens.select(
        key, F.size("p").alias("np"), F.size("r").alias("nr"),
        _match_udf(orders)(F.array_join("p", " "), F.array_join("r", " ")).alias("m"),
    )
    per_order = F.array(*[
        F.struct(
            F.lit(n).alias("n"),
            F.get("m", F.lit(i)).alias("matches"),
            F.greatest(F.col("np") - (n - 1), F.lit(0)).cast("long").alias("total"),
            F.greatest(F.col("nr") - (n - 1), F.lit(0)).cast("long").alias("ref_total"),
        )
        for i, n in enumerate(orders)
    ])
    return counted.select(key, F.explode(per_order).alias("s")).select(key, "s.*")


def corpus_stats(stats: DataFrame) -> DataFrame:
    """``(n, matches, total, ref_total)`` over the corpus; one partial sum per task and order."""
    return stats.groupBy("n").agg(*[
        F.sum(c).cast("long").alias(c) for c in ("matches", "total", "ref_total")
    ])


# -- BLEU -------------------------------------------------------------------


def _wide(stats: DataFrame) -> DataFrame:
    """One row with ``m1..m4``, ``t1..t4`` and both lengths."""
    cells = []
    for n in range(1, MAX_ORDER + 1):
        at = F.col("n") == n
        cells.append(F.coalesce(F.max(F.when(at, F.col("matches"))), F.lit(0)).alias(f"m{n}"))
        cells.append(F.coalesce(F.max(F.when(at, F.col("total"))), F.lit(0)).alias(f"t{n}"))
    length = F.coalesce(F.max(F.when(F.col("n") == 1, F.col("ref_total"))), F.lit(0))
    return stats.agg(*cells, length.alias("ref_len")).withColumn("pred_len", F.col("t1"))


def _brevity() -> Column:
    ratio = F.col("pred_len") / F.nullif("ref_len", F.lit(0))
    shorter = F.when(F.col("pred_len") > 0, F.exp(1 - F.col("ref_len") / F.nullif("pred_len", F.lit(0)))).otherwise(0.0)
    return F.when(ratio > 1, F.lit(1.0)).otherwise(shorter)


def _product(precisions: Sequence[Column]) -> Column:
    logs = [F.ln(p) for p in precisions]
    return F.exp(sum(logs[1:], logs[0]) / MAX_ORDER)


def bleu(stats: DataFrame) -> DataFrame:
    """One row: corpus BLEU in 0..1 with its parts."""
    wide = _wide(stats)
    p = {n: F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.nullif(f"t{n}", F.lit(0))).otherwise(0.0)
         for n in range(1, MAX_ORDER + 1)}
    score = F.when(F.least(*[F.col(f"m{n}") for n in p]) > 0, _brevity() * _product(list(p.values()))).otherwise(0.0)
    return wide.select(
        score.alias("bleu"),
        *[col.alias(f"precision_{n}") for n, col in p.items()],
        _brevity().alias("brevity_penalty"),
        F.coalesce(F.col("pred_len") / F.nullif("ref_len", F.lit(0)), F.lit(0.0)).alias("length_ratio"),
        F.col("pred_len").alias("translation_length"),
        F.col("ref_len").alias("reference_length"),
    )


def sacrebleu(stats: DataFrame) -> DataFrame:
    """One row: BLEU in 0..100; an order without a match counts 1/2, 1/4, ... instead."""
    wide = _wide(stats)
    precisions = []
    for n in range(1, MAX_ORDER + 1):
        zeros = sum([F.when(F.col(f"m{i}") == 0, 1).otherwise(0) for i in range(1, n + 1)], F.lit(0))
        total = F.nullif(f"t{n}", F.lit(0))
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * total)
        exact = F.lit(100.0) * F.col(f"m{n}") / total
        precisions.append(F.coalesce(F.when(F.col(f"m{n}") > 0, exact).otherwise(smoothed), F.lit(0.0)))
    any_match = F.greatest(*[F.col(f"m{n}") for n in range(1, MAX_ORDER + 1)]) > 0
    complete = F.least(*[F.col(f"t{n}") for n in range(1, MAX_ORDER + 1)]) > 0
    score = F.when(any_match & complete, _brevity() * _product(precisions)).otherwise(0.0)
    return wide.select(
        score.alias("score"),
        *[F.col(f"m{n}").alias(f"counts_{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.col(f"t{n}").alias(f"totals_{n}") for n in range(1, MAX_ORDER + 1)],
        *[p.alias(f"precision_{n}") for n, p in enumerate(precisions, 1)],
        _brevity().alias("bp"),
        F.col("pred_len").alias("sys_len"),
        F.col("ref_len").alias("ref_len"),
    )


# -- ROUGE ------------------------------------------------------------------


def rouge_n(stats: DataFrame, key: str) -> DataFrame:
    """``(key, n, f)`` per pair; 0 when both sides are empty."""
    both = F.nullif(F.col("total") + F.col("ref_total"), F.lit(0))
    return stats.select(key, "n", F.coalesce(2 * F.col("matches") / both, F.lit(0.0)).alias("f"))


def _token_bits(ref: list[str]) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, token in enumerate(ref):
        places[token] = places.get(token, 0) | (1 << i)
    return places


def _lcs_steps(v: int, can: list[str], places: dict[str, int], full: int) -> Iterator[int]:
    """Bit-vector LCS: after each candidate token, a zero bit marks a step in the reference."""
    for token in can:
        u = v & places.get(token, 0)
        if u:
            v = ((v + u) | (v - u)) & full
        yield v


def lcs_length(ref: list[str], can: list[str]) -> int:
    shared = min(len(ref), len(can))
    start = next((i for i in range(shared) if ref[i] != can[i]), shared)
    end = next((i for i in range(shared - start) if ref[-1 - i] != can[-1 - i]), shared - start)
    inner = ref[start:len(ref) - end]
    v = full = (1 << len(inner)) - 1
    for v in _lcs_steps(full, can[start:len(can) - end], _token_bits(inner), full):
        pass
    return start + end + len(inner) - v.bit_count()


def lcs_positions(ref: list[str], can: list[str]) -> set[int]:
    """Reference positions of one LCS; ties leave the reference token out.

    Only tokens that both sides have are looked at; ``gaps`` keeps the places in the candidate where others were left out, as ties
    are settled there too. Only about the square root of the candidate's rows is kept; the rows between are computed again, a stretch
    at a time, on the way back. So memory grows with length times square root of length, not with the product of both lengths.
    """
    bag, words = set(can), set(ref)
    at = [i for i, token in enumerate(ref) if token in bag]
    if len(at) < 2:
        return set(at)
    ref, kept, gaps = [ref[i] for i in at], [], set()
    for token in can:
        if token in words:
            kept.append(token)
        else:
            gaps.add(len(kept))
    places, full = _token_bits(ref), (1 << len(ref)) - 1
    stretch = math.isqrt(len(kept)) + 1
    marks = [full]
    for done, v in enumerate(_lcs_steps(full, kept, places, full), 1):
        if done % stretch == 0:
            marks.append(v)
    i, j, found = len(ref), len(kept), set()
    while i and j:
        first = (j - 1) // stretch * stretch
        rows = [marks[first // stretch], *_lcs_steps(marks[first // stretch], kept[first:j], places, full)]
        arrived = True
        while i and j > first:
            tie = rows[j - first] >> (i - 1) & 1
            if arrived and j in gaps and tie:
                i -= 1
                continue
            arrived = False
            if ref[i - 1] == kept[j - 1]:
                found.add(at[i - 1])
                i, j, arrived = i - 1, j - 1, True
            elif tie:
                i -= 1
            else:
                j, arrived = j - 1, True
    return found


def _f(hits: int, n_pred: int, n_ref: int) -> float:
    return 2 * hits / (n_pred + n_ref) if hits else 0.0


def summary_hits(refs: list[list[str]], cans: list[list[str]]) -> int:
    """Union of the LCS positions over candidate sentences, clipped by token counts. Equal lines are compared once.

    A token counts as often as it is in unions, but no more often than in the candidate. So every line meets the candidate line it
    shares most with first, and others only while they could add a token that is still wanted.
    """
    wanted = Counter(t for s in cans for t in s)
    different = list(dict.fromkeys(map(tuple, cans)))
    bags = [set(c) for c in different]
    lines: dict[str, list[int]] = {}
    for k, bag in enumerate(bags):
        for token in bag:
            lines.setdefault(token, []).append(k)
    # Positions that no union has yet.
    left = {ref: {i for i, token in enumerate(ref) if token in lines} for ref in map(tuple, refs)}
    times, hits = Counter(map(tuple, refs)), 0
    for first in (True, False):
        for ref, open_ in left.items():
            if not any(wanted[ref[i]] > 0 for i in open_):
                continue
            shared, count = Counter(k for token in set(ref) for k in lines.get(token, ())), times[ref]
            for k, _ in shared.most_common(1 if first else None):
                if any(wanted[ref[i]] > 0 and ref[i] in bags[k] for i in open_):
                    new = set(open_) if different[k] == ref else lcs_positions(ref, different[k]) & open_
                    open_ -= new
                    for i in new:
                        hits += max(min(count, wanted[ref[i]]), 0)
                        wanted[ref[i]] -= count
    return hits


def score_lines(prediction: str, reference: str) -> tuple[float, float]:
    """ROUGE-L and ROUGE-Lsum of one pair of normalized texts, one sentence per line."""
    p_lines = [w for w in map(str.split, prediction.split("\n")) if w]
    r_lines = [w for w in map(str.split, reference.split("\n")) if w]
    p = [t for s in p_lines for t in s]
    r = [t for s in r_lines for t in s]
    lcs = lcs_length(r, p)
    # With one sentence on each side the union is the LCS itself.
    union = lcs if len(p_lines) == len(r_lines) == 1 else summary_hits(r_lines, p_lines)
    return _f(lcs, len(p), len(r)), _f(union, len(p), len(r))


#: Lower-case ASCII letters, digits and line breaks stay; any other byte of a UTF-8 text becomes a blank.
_LINE_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))


def rouge_lines(lowered: str | None) -> str:
    """Lower-cased text with blanks for all but ASCII letters and digits; how many blanks stand for a run does not matter."""
    return (lowered or "").encode().translate(_LINE_BYTES).decode()


def _rouge_l_udf():
    @F.pandas_udf("struct<rouge_l:double,rouge_lsum:double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for predictions, references in batches:
            rows = [score_lines(rouge_lines(p), rouge_lines(r)) for p, r in zip(predictions, references)]
            yield pd.DataFrame(rows, columns=["rouge_l", "rouge_lsum"])

    return score.asNondeterministic()


def rouge_l(pairs: DataFrame, key: str, prediction: Column, reference: Column) -> DataFrame:
    """``(key, rouge_l, rouge_lsum)`` per pair; each pair is one row, nothing moves."""
    scored = pairs.select(key, _rouge_l_udf()(F.lower(prediction), F.lower(reference)).alias("s"))
    return scored.select(key, "s.rouge_l", "s.rouge_lsum")


# -- suites -----------------------------------------------------------------


def long_form(row: DataFrame, suite: str) -> DataFrame:
    """One wide metric row to ``(suite, metric, value)`` with prefixed names."""
    cells = F.array(*[
        F.struct(F.lit(f"{suite}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ])
    return row.select(F.lit(suite).alias("suite"), F.explode(cells).alias("m")).select("suite", "m.metric", "m.value")


def combine(*suites: tuple[str, DataFrame]) -> DataFrame:
    """Metric rows of several suites in one long table."""
    parts = [long_form(row, name) for name, row in suites]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Columns of :func:`long_form`.
METRIC_ROWS = "suite string, metric string, value double"


def log_metrics(metrics: DataFrame, path: str, run: str, step: int) -> None:
    """Write one evaluation into the metric history, in place of an earlier one of the same run and step.

    A repeated or resumed evaluation therefore counts once. The history has a folder a run and step; others are not touched.
    """
    if not run:
        raise ValueError("a run needs a name")
    rows = metrics.withColumn("run", F.lit(run)).withColumn("step", F.lit(step))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(path)


def metric_log(spark: SparkSession, path: str, rows: str = METRIC_ROWS) -> DataFrame:
    """The metric history; ``rows`` are the columns of the logged metrics. Names of runs stay strings, ``007`` too."""
    return spark.read.schema(f"{rows}, run string, step int").parquet(path)
