"""Spreading work when a scan has too few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Repartition only if the scan yields fewer partitions than there are cores.

    A large table has more splits than cores and passes through without a shuffle;
    a small one would otherwise run its per-document work in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
