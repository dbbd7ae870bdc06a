"""Published datasets: Parquet folders partitioned by shard number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(rows: DataFrame, path: str, shard: str = "shard", base: int = 0, mode: str = "overwrite") -> None:
    """Write rows under ``shard=<number + base>``; rewriting a shard replaces only that shard.

    Rows are spread by shard so that a shard does not end in one small file per task;
    the writer rolls files, and AQE splits a shard that is far larger than the others.
    """
    out = rows.withColumn(shard, (F.col(shard) + F.lit(base)).cast("int")).hint("rebalance", F.col(shard))
    (
        out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(shard)
        .parquet(path)
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_shard(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One shard; the filter prunes folders, other shards are not opened."""
    return read_dataset(spark, path).where(F.col("shard") == number)


def split_encodable(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantined)``: rows whose text is valid UTF-8, and the others with a reason.

    The quarantined text is kept as bytes so that nothing is lost on the way to disk.
    """
    valid = F.coalesce(F.is_valid_utf8(text), F.lit(False))
    clean = rows.where(valid)
    bad = (
        rows.where(~valid)
        .withColumn("raw", F.col(text).cast("binary"))
        .drop(text)
        .withColumn("error", F.lit("not valid UTF-8"))
    )
    return clean, bad
