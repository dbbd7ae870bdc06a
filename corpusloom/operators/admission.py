"""Which files of a listing a run takes, and in which batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.ranking import with_rank


def limit_per_folder(manifest: DataFrame, n: int, folder: str = "folder", order: Sequence[str] = ("path",)) -> DataFrame:
    """First ``n`` files of each folder.

    Spark turns the rank filter into a group limit before the shuffle: a task sends
    at most ``n`` rows of a folder, so a very large folder does not fill one task.
    """
    w = Window.partitionBy(folder).orderBy(*order)
    return manifest.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def limit_total(manifest: DataFrame, n: int, order: Sequence[str] = ("folder_ord", "path")) -> DataFrame:
    """First ``n`` files, folders in argument order."""
    return manifest.orderBy(*order).limit(n)


def admit(manifest: DataFrame, per_folder: int | None = None, total: int | None = None,
          failed: DataFrame | None = None) -> DataFrame:
    """Both limits; finished files must be removed before, so that they do not count.

    Files of ``failed(path)`` come after all others, so that a limited run always gets to new ones.
    """
    if failed is None:
        tried, first = manifest, []
    else:
        again = failed.select("path", F.lit(1).alias("_again"))
        tried = manifest.join(again, "path", "left").withColumn("_again", F.coalesce("_again", F.lit(0)))
        first = ["_again"]
    if per_folder is not None:
        tried = limit_per_folder(tried, per_folder, order=[*first, "path"])
    if total is not None:
        tried = limit_total(tried, total, [*first, "folder_ord", "path"])
    return tried.select(*manifest.columns)


def assign_batches(manifest: DataFrame, size: int) -> DataFrame:
    """Add ``batch``: consecutive files in listing order, ``size`` per batch."""
    ranked = with_rank(manifest, ["folder_ord", "path"])
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank")


def row_with(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key, for inspection."""
    return rows.where(F.col(key) == F.lit(value))


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Small subset for a trial run: the ``n`` smallest keys, the same on every run."""
    return rows.orderBy(key).limit(n)
