"""Exact de-duplication by skew-safe combining.

1. Each task merges the equal texts of one Arrow batch (compared as texts).
2. What is left is grouped by (digest, salt, text); the salt follows the batch, so a text that makes up
   a third of all rows is spread over ``salts`` groups of already merged rows.
3. The winner of each salt is combined by (digest, text).

Texts are compared in full at every stage; the digest only routes them. Ids travel in arrays no longer
than a batch, and are never gathered by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import document_key, give_back, text_of

SALTS = 16
#: Rows merged at once in a task, and so the longest array of ids.
LOCAL_ROWS = 4096

_LOCAL = "digest binary, salt int, text string, ids array<bigint>"


def _merge_locally(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, LOCAL_ROWS):
                ids, texts = batch.slice(start, LOCAL_ROWS).columns
                coded = texts.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                digests = [hashlib.sha256(value.as_buffer()).digest() for value in coded.dictionary]
                yield pa.RecordBatch.from_arrays([
                    pa.array(digests, pa.binary()),
                    pa.array(np.full(len(digests), turn % salts, np.int32)),
                    coded.dictionary.cast(pa.string()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), ids.take(pa.array(order))
                    ),
                ], names=["digest", "salt", "text", "ids"])
                turn += 1
        give_back()

    return run


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Null text counts as empty. The largest doc_id of a text stays; a null doc_id loses to any other. If rows
    repeat a doc_id with the same text, one of them is kept. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Dealt out once for both uses below: their plans agree up to here, so Spark reuses the exchange.
    local = source.mapInArrow(_merge_locally(salts), _LOCAL).repartition("digest", "salt", "text")
    best = F.array_max("ids")
    within = Window.partitionBy("digest", "salt", "text").orderBy(F.col("best").desc_nulls_last())
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    salted = local.withColumn("best", best).select(
        "digest", "salt", "text", "ids", "best",
        F.row_number().over(within).alias("salt_rank"),
        F.max("best").over(whole).alias("salt_best"),
        F.sum(F.size("ids")).over(whole).alias("salt_rows"),
    )
    across = Window.partitionBy("digest", "text").orderBy(F.col("salt_best").desc_nulls_last(), "salt")
    total = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    combined = salted.where("salt_rank = 1").select(
        "digest", "salt", "salt_best",
        F.row_number().over(across).alias("rank"),
        F.max("salt_best").over(total).alias("keep_id"),
        F.sum("salt_rows").over(total).alias("group_size"),
    )
    w, s = combined.alias("w"), salted.drop("text").alias("s")
    joined = s.join(
        w, F.col("s.digest").eqNullSafe(F.col("w.digest")) & F.col("s.salt").eqNullSafe(F.col("w.salt"))
        & F.col("s.salt_best").eqNullSafe(F.col("w.salt_best")),
    )
    rows = joined.select(
        "s.digest", "keep_id", "group_size", ((F.col("rank") == 1) & (F.col("salt_rank") == 1)).alias("winner"),
        F.coalesce(F.array_position("ids", F.col("best")), F.lit(1)).alias("at"), F.posexplode("ids").alias("pos", "doc_id"),
    )
    return rows.select(
        "doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("pos") + 1 == F.col("at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns; of rows equal in doc_id and text, one."""
    kept = exact_groups(docs, salts).where("kept").select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_sha256")).alias("__kept_key")
    )
    marked = docs.withColumn("__key", document_key()).join(kept, F.col("__key") == F.col("__kept_key"))
    first = Window.partitionBy("__key").orderBy("__key")
    return marked.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)
