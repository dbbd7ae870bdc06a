"""Vocabulary, token ids, padding and training labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import elements
from corpusloom.functions.text import BOS, EOS, INST_CLOSE, words
from corpusloom.plans.ranking import with_rank
from corpusloom.session import materialize

# Special ids and the label of positions that do not count.
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
FIRST_ID = 3
IGNORE = -100
MAX_GENERATED = 1000
SPECIALS = (BOS, EOS)

#: Bound on the vocabulary entries that are sent to every task: those that make up at least one part in so many of all tokens.
HEAD_ROWS = 20_000
_MARKERS = r"(<s>|</s>|\[INST\]|\[/INST\])"


def prompt_tokens(prompt: Column) -> Column:
    """Whitespace tokens; prompt markers are tokens of their own."""
    return words(F.regexp_replace(prompt, _MARKERS, " $1 "))


def vocabulary(rows: DataFrame, tokens: str) -> DataFrame:
    """``(token, n, token_id)``: ids from 3 by falling count, then by token; a written table, as it is read several times."""
    counts = rows.select(F.explode(elements(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = counts.where(~F.col("token").isin(*SPECIALS))
    ranked = with_rank(counts, [F.col("n").desc(), "token"])
    return materialize(ranked.select("token", "n", (F.col("rank") + (FIRST_ID - 1)).cast("int").alias("token_id")), "vocabulary")


def _with_tail(rows: DataFrame, key: str, values: str, vocab: DataFrame, source: str, target: str,
               fixed: dict) -> tuple[DataFrame, object]:
    """Rows with ``_from`` and ``_to``, what their own rare values map to, and the broadcast map of the common ones.

    The common entries are few by definition, however large the vocabulary. Each row's distinct rare values are joined with the
    vocabulary and come back as one small array per key, so no key is hot and no occurrence becomes a row of its own.
    """
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    head = vocab.where(F.col("n") * HEAD_ROWS >= total).select(source, target)
    found = head.toArrow()
    common = {**dict(zip(found[source].to_pylist(), found[target].to_pylist(), strict=True)), **fixed}
    distinct = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct(elements(values))).alias(source))
    rare = distinct.where(~F.col(source).isin(*fixed)) if fixed else distinct
    # The head is bounded by its definition, so broadcasting it is.
    rare = rare.join(F.broadcast(head.select(source)), source, "left_anti")
    known = rare.join(vocab.select(source, target), source).groupBy("_key").agg(
        F.collect_list(F.struct(F.col(source).alias("f"), F.col(target).alias("t"))).alias("_known")
    )
    joined = rows.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
    mapped = joined.select(*rows.columns, F.col("_known.f").alias("_from"), F.col("_known.t").alias("_to"))
    return mapped, rows.sparkSession.sparkContext.broadcast(common)


def _mapped(values: pa.Array, common: tuple[pa.Array, pa.Array], rare: pa.Array, targets: pa.Array) -> pa.Array:
    """What the elements of a list array map to, null where neither map knows one.

    Rare maps are parts of one vocabulary, so those of all rows of a batch serve as one.
    """
    flat = values.flatten()
    at = pc.index_in(flat, value_set=common[0])
    return pc.coalesce(common[1].take(at), targets.flatten().take(pc.index_in(flat, value_set=rare.flatten())))


def _lists(like: pa.Array, flat: pa.Array, lengths: np.ndarray) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(ends, flat, mask=like.is_null())


def encode(rows: DataFrame, key: str, tokens: str, vocab: DataFrame, append_end: bool = False) -> DataFrame:
    """Add ``input_ids`` for a token array; unknown tokens become 0, a null array stays null, other columns stay.

    ``key`` tells rows apart; rows that repeat one share their tokens' ids, each by its own array.
    """
    mapped, shared = _with_tail(rows, key, tokens, vocab, "token", "token_id", {BOS: BOS_ID, EOS: EOS_ID})

    @F.arrow_udf("array<int>")
    def code(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        common = pa.array(shared.value.keys(), pa.string()), pa.array(shared.value.values(), pa.int32())
        for words, rare, codes in parts:
            ids = _mapped(words, common, rare, codes).fill_null(UNK_ID)
            yield _lists(words, ids, pc.list_value_length(words).fill_null(0).to_numpy())

    # Declared non-deterministic so that the optimizer never copies the call.
    out = mapped.withColumn("input_ids", code.asNondeterministic()(F.col(tokens), F.col("_from"), F.col("_to"))).drop("_from", "_to")
    if append_end:
        out = out.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(EOS_ID))))
    return out


def pad_batches(rows: DataFrame, batch: str = "batch", ids: str = "input_ids") -> DataFrame:
    """Right-pad with the unknown id to the longest row of the batch."""
    # A batch is a handful of rows, so this window is small however many batches there are.
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    wide = rows.withColumn("padded_len", longest)
    pad = F.array_repeat(F.lit(UNK_ID), F.col("padded_len") - F.size(ids))
    return wide.withColumn("padded_ids", F.concat(ids, pad))


def completion_labels(prompt: Column, ids: Column) -> Column:
    """Ids with everything outside answers replaced by -100.

    An answer runs from after ``[/INST]`` to before the next ``[INST]``. The text is
    cut at instruction markers, so the whole mask is linear in the row's length.
    """
    def mask(segment: Column, i: Column) -> Column:
        total = F.size(prompt_tokens(segment)) + F.when(i == 0, 0).otherwise(1)
        answer = F.size(prompt_tokens(F.substring_index(segment, INST_CLOSE, -1)))
        # Repeated closing markers inside one answer are prompt format, not answer.
        trained = F.when(F.contains(segment, F.lit(INST_CLOSE)), answer).otherwise(0)
        return F.concat(F.array_repeat(F.lit(False), (total - trained).cast("int")),
                        F.array_repeat(F.lit(True), trained.cast("int")))

    segments = F.split(prompt, r"\[INST\]")
    flags = F.flatten(F.transform(segments, mask))
    return F.zip_with(ids, flags, lambda t, keep: F.when(keep, t).otherwise(F.lit(IGNORE)))


def trained_share(labels: Column) -> Column:
    kept = F.size(F.filter(labels, lambda x: x != IGNORE))
    return F.when(F.size(labels) > 0, kept / F.size(labels)).otherwise(F.lit(0.0))


def decode(rows: DataFrame, key: str, labels: str, vocab: DataFrame, glue: str = " ") -> DataFrame:
    """Add ``text``: -100, special and unknown ids are skipped, other ids become words put together by ``glue``; a null array stays null."""
    mapped, shared = _with_tail(rows, key, labels, vocab, "token_id", "token", {})

    @F.arrow_udf("string")
    def name(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        named = {i: word for i, word in shared.value.items() if i >= FIRST_ID and word}
        common = pa.array(named.keys(), pa.int32()), pa.array(named.values(), pa.string())
        for ids, rare, words in parts:
            found = _mapped(ids, common, rare, words)
            kept = pc.and_(found.is_valid(), pc.greater_equal(ids.flatten(), FIRST_ID).fill_null(False))
            row = pc.list_parent_indices(ids).filter(kept).to_numpy()
            yield pc.binary_join(_lists(ids, found.filter(kept), np.bincount(row, minlength=len(ids))), glue)

    return mapped.withColumn("text", name.asNondeterministic()(F.col(labels), F.col("_from"), F.col("_to"))).drop("_from", "_to")


def truncate(text: Column, longest: int = MAX_GENERATED) -> Column:
    """At most ``longest`` whitespace tokens."""
    return F.array_join(F.slice(words(text), 1, longest), " ")


def length_status(text: Column) -> Column:
    return F.when(F.size(words(text)) < 1, F.lit("too_short")).otherwise(F.lit("ok"))


def tokens_by(text: Column, make_tokenizer: Callable[[], Callable[[str], list[str]]]) -> Column:
    """Token array by a tokenizer of the caller's, made once a task; tokens may hold blanks, a null text stays null."""
    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = make_tokenizer()
        for texts in parts:
            yield pd.Series([None if t is None else list(tokenize(t)) for t in texts], dtype=object)

    return cut.asNondeterministic()(text)


def collate_batches(rows: DataFrame, collate: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: str = "batch") -> DataFrame:
    """What ``collate`` makes of the rows of each batch, in place of :func:`pad_batches`; the order of a batch's rows is its own affair.

    A batch is a handful of rows by definition, so each fits a task; rows move once, by batch.
    """
    return rows.groupBy(batch).applyInPandas(lambda part: collate(part), schema)
