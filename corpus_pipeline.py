"""From documents to encoded training data: quality, exact and near copies, benchmark passages, sub-word ids.

Each stage takes what its predecessor kept, as a written table. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table
from corpusloom.llm.decontamination import decontaminate
from corpusloom.llm.exact_dedup import drop_exact_copies
from corpusloom.llm.merge_dropout import encode
from corpusloom.llm.minhash import drop_near_duplicates
from corpusloom.llm.quality import keep_quality
from corpusloom.session import scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of an Arrow batch: what a task holds of long texts, in the executor and again in its Python worker.
BATCH_BYTES = "8m"


def _prepare(spark: SparkSession) -> None:
    """Python tasks get the package, and batches of bounded size unless the session says how large."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject."""
    _prepare(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    _prepare(spark)
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies, the document with the smallest doc_id."""
    _prepare(spark)
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``benchmark``; documents that are mostly such passages go."""
    _prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids, lossless)``: ids as packed 32-bit integers, checked by decoding them."""
    _prepare(spark)
    return encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: A trained classifier and keyed merges have no SQL form; tests check the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    _prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
