"""Document reads: whole text files, or tables that already hold text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import elements
from corpusloom.sources.listing import folder_order, parent_folder


def read_text_files(spark: SparkSession, root: str, folders: Sequence[str] = (), pattern: str = "*",
                    folder_of: Callable[[Column], Column] = parent_folder) -> DataFrame:
    """One row per file: ``(doc_id, file_name, folder, folder_ord, text)``, ready for the corpus build.

    ``file_name`` is the whole path, as listings have it; ``doc_id`` is a hash of it. A text may end in the line break that its
    file ends in.
    """
    files = (
        spark.read
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_name"), F.col("value").alias("text"))
    )
    folder = folder_of(F.col("file_name"))
    return files.select(
        F.xxhash64("file_name").alias("doc_id"), "file_name", folder.alias("folder"),
        folder_order(folder, folders).alias("folder_ord"), "text",
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, file_name, folder, folder_ord, text)`` from the documents table."""
    raw = table(spark, root, "documents")
    return raw.select(
        "doc_id",
        F.concat(F.lit("pdf/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_name"),
        F.col("source").alias("folder"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("folder_ord"),
        "text",
    )


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, path, folder, folder_ord, bytes)``: sizes without the text."""
    docs = documents(spark, root)
    return docs.select(
        "doc_id", F.col("file_name").alias("path"), "folder", "folder_ord",
        F.octet_length("text").cast("long").alias("bytes"),
    )


def prompt_matrix(rows: DataFrame, key: str, prompts: str) -> DataFrame:
    """Ragged lists of prompts to ``(conversation, turn, text)``, turns from 0."""
    return rows.select(F.col(key).alias("conversation"), F.posexplode(elements(prompts)).alias("turn", "text"))
