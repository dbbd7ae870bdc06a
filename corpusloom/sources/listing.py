"""File listings: from storage and from manifest tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def folder_order(folder: Column, folders: Sequence[str]) -> Column:
    """Place of a folder in the argument list; folders that are not named come last."""
    if not folders:
        return F.lit(0)
    place = F.array_position(F.array(*map(F.lit, folders)), folder).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(folders))


def list_files(spark: SparkSession, root: str, folders: Sequence[str] = (), pattern: str = "*",
               folder_of: Callable[[Column], Column] = parent_folder) -> DataFrame:
    """``(path, folder, folder_ord, bytes)`` of every file under ``root``; contents are not read.

    The whole path is a file's identity, as in :func:`corpusloom.sources.documents.read_text_files`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    )
    folder = folder_of(F.col("path"))
    return files.select("path", folder.alias("folder"), folder_order(folder, folders).alias("folder_ord"), "bytes")


def folder_position(path: Column, prefix: str, folders: Sequence[str]) -> Column:
    """Index of the first folder argument that is a string prefix of the path, else NULL."""
    tests = [F.when(F.startswith(path, F.lit(f"{prefix}/{name}")), F.lit(i)) for i, name in enumerate(folders)]
    return F.coalesce(*tests)


def list_prefix(manifest: DataFrame, prefix: str, folders: Sequence[str]) -> DataFrame:
    """Files whose path starts with ``prefix/folder`` for one of the folders.

    The match is on the string, so "2403" also takes "24031/...". A path that fits
    several arguments is listed once, under the first of them.
    """
    listed = manifest.withColumn("folder_ord", folder_position(F.col("path"), prefix, folders))
    return listed.where(F.col("folder_ord").isNotNull())


def folder_inventory(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes")
    )
