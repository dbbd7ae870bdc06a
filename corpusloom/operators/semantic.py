"""Semantic chunking: break a document where the meaning of neighbouring units jumps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import elements
from corpusloom.functions.text import words
from corpusloom.operators.splitting import bound_sizes, buffered, runs, units

_WORD = re.compile(r"\w+")  # letters, digits, underscore; the same set as BAG_WORD
BAG_WORD = r"[\p{L}\p{N}_]+"

PERCENTILE = 0.9
DIGITS = 9
#: Documents whose units are Python objects at the same time.
DOCS_AT_ONCE = 64


# -- encoders ---------------------------------------------------------------


def unit_rows(docs: DataFrame, mode: str = "sentence", radius: int = 1) -> DataFrame:
    """``(doc_id, pos, unit, context)``, one row per unit with its buffered context."""
    split = docs.select("doc_id", units(F.col("text"), mode).alias("u"))
    return split.select("doc_id", F.posexplode(F.arrays_zip(F.col("u").alias("unit"), buffered(F.col("u")).alias("context")))
                        .alias("pos", "z")).select("doc_id", "pos", "z.unit", "z.context")


def encode_batches(rows: DataFrame, text: str, make_encoder: Callable[[], Callable[[pd.Series], list]]) -> DataFrame:
    """Add ``embedding`` with any encoder; it is built once per task, then fed batches of texts. Other columns stay in Arrow."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            vectors = float_lists(encode(batch.column(text).to_pandas()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def float_lists(vectors) -> pa.Array:
    """Vectors as Arrow lists; a two-dimensional array crosses whole, without an object for each row."""
    if isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        ends = np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(vectors.shape[1])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel().astype(np.float32)))
    return pa.array([v.astype(np.float32) if isinstance(v, np.ndarray) else v for v in vectors], pa.list_(pa.float32()))


def bag_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(BAG_WORD), 0)


def word_counts(contexts: DataFrame) -> DataFrame:
    """Default encoder: ``(doc_id, pos, word, n)``, counted in the row that holds the context, so nothing moves."""
    @F.arrow_udf("array<struct<word: string, n: bigint>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            split = pc.split_pattern(texts.fill_null(""), " ")
            row = pc.list_parent_indices(split).to_numpy()
            found = split.flatten().dictionary_encode()
            kept = pc.not_equal(split.flatten(), "").to_numpy(zero_copy_only=False)
            width = max(len(found.dictionary), 1)
            keys, n = np.unique(row[kept] * width + found.indices.to_numpy()[kept], return_counts=True)
            ends = np.cumsum(np.bincount(keys // width, minlength=len(texts)))
            counted = pa.StructArray.from_arrays([found.dictionary.take(pa.array(keys % width)), pa.array(n, pa.int64())], ["word", "n"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), counted)

    # Words are found by Spark and cross as one string: they hold no blanks. Non-deterministic, so that the call is not repeated.
    found = F.array_join(bag_words(F.col("context")), " ")
    counted = contexts.select("doc_id", "pos", count.asNondeterministic()(found).alias("c"))
    return counted.select("doc_id", "pos", F.explode(elements("c")).alias("c")).select("doc_id", "pos", "c.word", "c.n")


def distances(counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(doc_id, pos, distance)`` between unit ``pos`` and the next: 1 - cosine.

    The relational form, for counts that are already a table; contexts without words
    are at distance 1. Each count is listed for the pair on its left and on its right; grouping by word
    puts the two sides together, so no self-join is needed.
    """
    sides = counts.select(
        "doc_id", "word",
        F.explode(F.array(
            F.struct(F.col("pos").alias("pair"), F.col("n").alias("l"), F.lit(0).cast("long").alias("r")),
            F.struct((F.col("pos") - 1).alias("pair"), F.lit(0).cast("long").alias("l"), F.col("n").alias("r")),
        )).alias("s"),
    ).select("doc_id", "word", "s.*")
    per_word = sides.groupBy("doc_id", "pair", "word").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    per_pair = per_word.groupBy("doc_id", "pair").agg(
        F.sum(F.col("l") * F.col("r")).alias("dot"),
        F.sum(F.col("l") * F.col("l")).alias("ll"),
        F.sum(F.col("r") * F.col("r")).alias("rr"),
    )
    pairs = contexts.where("pos > 0").select("doc_id", (F.col("pos") - 1).alias("pair"))
    cosine = F.col("dot") / F.nullif(F.sqrt(F.col("ll") * F.col("rr").cast("double")), F.lit(0.0))
    return pairs.join(per_pair, ["doc_id", "pair"], "left").select(
        "doc_id", F.col("pair").alias("pos"), F.round(1 - F.coalesce(cosine, F.lit(0.0)), DIGITS).alias("distance")
    )


# -- chunking ---------------------------------------------------------------


def bag_distances(units_: list[str], radius: int = 1) -> np.ndarray:
    """Consecutive distances of one document's buffered units under the word-count encoder.

    A bag is the sum of its units' counts, so a product of two bags is a sum of products of single units; these are counted once
    for each of the few distances between units that occur.
    """
    n = len(units_)
    if n < 2:
        return np.empty(0)
    found = [_WORD.findall(u.lower()) for u in units_]
    numbers: dict[str, int] = {}
    words_ = np.array([numbers.setdefault(w, len(numbers)) for unit in found for w in unit], np.int64)
    width = max(len(numbers), 1)
    keys, counts = np.unique(np.repeat(np.arange(n), [len(unit) for unit in found]) * width + words_, return_counts=True)
    at = keys // width
    products = np.zeros((2 * radius + 2, n + 2 * radius))  # between unit i and i + step, in place i + radius
    for step in range(len(products) if len(keys) else 0):
        place = np.minimum(np.searchsorted(keys, keys + step * width), len(keys) - 1)
        both = keys[place] == keys + step * width
        products[step, radius:radius + n] = np.bincount(at, counts * counts[place] * both, minlength=n)

    def dots(step: int, m: int) -> np.ndarray:
        """Products of the first ``m`` bags with those ``step`` further on."""
        total = np.zeros(m)
        for a in range(2 * radius + 1):
            for b in range(step, step + 2 * radius + 1):
                total += products[abs(a - b), min(a, b):min(a, b) + m]
        return total

    norms = dots(0, n)
    scale = np.sqrt(norms[:-1] * norms[1:])
    return np.round(1 - np.divide(dots(1, n - 1), scale, out=np.zeros(n - 1), where=scale > 0), DIGITS)


def encoder_distances(encode: Callable[[list[str]], np.ndarray], radius: int = 1):
    """Distance function for ``chunk_starts`` from any encoder of texts to vectors."""
    def distances_of(units_: list[str]) -> np.ndarray:
        contexts = [" ".join(units_[max(i - radius, 0):i + radius + 1]) for i in range(len(units_))]
        v = np.asarray(encode(contexts), dtype=np.float64)
        norms = np.linalg.norm(v, axis=1)
        scale = norms[:-1] * norms[1:]
        dots = np.einsum("ij,ij->i", v[:-1], v[1:])
        return np.round(1 - np.divide(dots, scale, out=np.ones_like(dots), where=scale > 0), DIGITS)

    return distances_of


def some_documents(batches: Iterator[pa.Array]) -> Iterator[list[list[str] | None]]:
    """Units of a few documents at a time, however large Spark's batches are."""
    for found in batches:
        for first in range(0, len(found), DOCS_AT_ONCE):
            yield found.slice(first, DOCS_AT_ONCE).to_pylist()


def chunk_starts(distance_fn: Callable[[list[str]], np.ndarray] = bag_distances, percentile: float = PERCENTILE, errors: bool = True):
    """Arrow UDF: array of units to ``(starts, error)``, the positions where chunks start.

    A break follows a unit whose distance to the next is strictly over the document's
    percentile. One Arrow pass per document; no shuffle. Pass it a plain column.
    With ``errors`` a document the encoder fails on has the error and null starts, for callers that read
    the error; without, its exception ends the job.
    """
    def starts(found: list[str]) -> list[int]:
        if not found:
            return []
        d = distance_fn(found)
        if not len(d):
            return [0]
        limit = np.round(np.quantile(d, percentile), DIGITS)
        return [0, *(np.flatnonzero(d > limit) + 1).tolist()]

    def guarded(found) -> tuple[list[int] | None, str | None]:
        """With ``errors``, a document the encoder fails on carries the error; the other documents go on."""
        try:
            return (None if found is None else starts(list(found))), None
        except Exception as exc:
            if not errors:
                raise
            return None, f"{type(exc).__name__}: {exc}"

    @F.arrow_udf("struct<starts:array<int>,error:string>")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in some_documents(batches):
            starts_, errors = zip(*map(guarded, found), strict=True)
            yield pa.StructArray.from_arrays([pa.array(starts_, pa.list_(pa.int32())), pa.array(errors, pa.string())], ["starts", "error"])

    # Declared non-deterministic so that the optimizer never copies the call.
    return assign.asNondeterministic()


def distance_rows(docs: DataFrame, mode: str = "sentence",
                  distance_fn: Callable[[list[str]], np.ndarray] = bag_distances) -> DataFrame:
    """``(doc_id, pos, distance)`` between neighbouring units, one Arrow pass per document."""
    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in some_documents(batches):
            yield pa.array([None if u is None else distance_fn(u) for u in found], pa.list_(pa.float64()))

    # A UDF reads a plain column; using it twice keeps the projection below the call.
    split = docs.select("doc_id", units(F.col("text"), mode).alias("_units")).withColumn("_n", F.size("_units"))
    measured = split.withColumn("_d", measure.asNondeterministic()("_units"))
    return measured.select("doc_id", F.posexplode(elements("_d")).alias("pos", "distance"))


def join_units(units_: str, starts: str) -> Column:
    """Array of chunk texts from a column of units and a column of chunk starts.

    Both are columns, not expressions: a Python result must be a column of its own
    before an array function may use it.
    """
    u, s = F.col(units_), F.col(starts)
    return F.transform(s, lambda first, i: F.array_join(runs(u, s, first, i), " "))


def semantic_chunks(docs: DataFrame, mode: str = "sentence", assign=None, bounded: bool = False,
                    minimum: int = 100, maximum: int = 256, errors: bool = False) -> DataFrame:
    """Documents with ``chunks``, the array of their chunk texts.

    ``errors`` adds ``chunk_error``, the reason why a document has none; without it, a document that fails ends the job.
    ``assign`` may be another ``chunk_starts(...)`` with a real encoder's distances. It decides by its own ``errors`` whether the job
    goes on; if it does, failed documents have null chunks, which explode to no rows, so ask for ``errors`` here too.
    """
    assign = assign or chunk_starts(errors=errors)
    split = docs.withColumn("_units", units(F.col("text"), mode))
    numbered = split.withColumn("_s", assign("_units"))
    out = numbered.withColumn("chunks", join_units("_units", "_s.starts"))
    if errors:
        out = out.withColumn("chunk_error", F.col("_s.error"))
    if bounded:
        sized = bound_sizes(F.transform("chunks", words), minimum, maximum)
        out = out.withColumn("chunks", F.transform(sized, lambda t: F.array_join(t, " ")))
    return out.drop("_units", "_s")
