"""Exact numbering of rows without a single-partition window.

A plain ``row_number`` over everything, or over one very large group, sorts that
group in one task. Here Spark range-partitions by (group, order): a large group
spans many partitions, each numbers its own rows, and a table with one row per
(partition, group) turns local numbers into exact ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

_PART_BITS = 33


def sorted_positions(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Sort by (group, order), add ``_part`` and ``_pos`` (0-based, per partition and group).

    The order must be unique inside a group. The result is a written table: the
    positions are fixed once and survive lost executors.
    """
    placed = df.orderBy(*group, *order).withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_row", _PART_BITS)).withColumn(
        "_at", F.col("_row").bitwiseAND((1 << _PART_BITS) - 1)
    )
    return materialize(placed.drop("_row"), "positions")


def with_rank(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Add the exact 1-based rank of each row, globally or per group.

    Pass only keys and ordering columns; join wide columns back on the key.
    """
    placed = sorted_positions(df, group, order)
    keys = ["_part", *group]
    local = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row per partition and group: bounded by partitions + groups, so this window is small.
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.join(offsets, keys)
    return ranked.withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop(
        "_part", "_at", "_first", "_offset"
    )
