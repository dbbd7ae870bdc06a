"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task holds as Python values at once; longer Arrow batches are cut.
ROWS_AT_ONCE = 256

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Words whose hashes a task remembers.
_KNOWN_WORDS = 60_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hash_of = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a document by id and content, so that repeated or missing ids cannot mix texts."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.sha2(text_of(text), 256))


def give_back() -> None:
    """Return unused Arrow memory at the end of a task; Python workers live on and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, schema: str, work: Callable[..., list], rows: int = ROWS_AT_ONCE, finish: Callable[[], None] | None = None
) -> DataFrame:
    """Run ``work(*columns) -> columns`` on slices of Arrow batches.

    Columns are Python lists; what ``work`` returns may be shorter or longer than its
    input. A task holds one Arrow batch and one slice as Python values, and calls ``finish`` at its end.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = work(*(column.to_pylist() for column in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(out, arrow, strict=True)], schema=arrow
                )
        if finish is not None:
            finish()
        give_back()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document key is in ``kept(doc_key)``; columns as in ``docs``."""
    keys = kept.select(F.col("doc_key").alias("__kept_key"))
    return docs.join(keys, document_key().eqNullSafe(F.col("__kept_key")), "left_semi")
