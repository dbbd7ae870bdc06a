"""Resume ledger: which files were processed, with what result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, or an empty one before the first run."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append after the shard itself is on disk; :func:`latest` reduces repeated rows to one per path."""
    rows.select(*SCHEMA.names).write.mode("append").parquet(path)


def latest(ledger: DataFrame) -> DataFrame:
    """One row per path: done before empty before failed, then the smallest shard."""
    rank = F.when(F.col("status") == "done", 0).when(F.col("status") == "empty", 1).otherwise(2)
    best = ledger.groupBy("path").agg(F.min(F.struct(rank.alias("rank"), "shard", "status", "error")).alias("best"))
    return best.select("path", "best.shard", "best.status", "best.error")


def done(ledger: DataFrame) -> DataFrame:
    """Paths that need no further run: published files and files without text, not failed ones."""
    return ledger.where(F.col("status").isin("done", "empty")).select("path").distinct()


def failed(ledger: DataFrame) -> DataFrame:
    """Paths whose only entries are failures."""
    return latest(ledger).where(F.col("status") == "failed").select("path")


def next_shard(ledger: DataFrame) -> int:
    """Number after the last published shard."""
    last = ledger.where(F.col("status") == "done").agg(F.max("shard").alias("last")).first()["last"]
    return 0 if last is None else last + 1


def unprocessed(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifest rows without a finished ledger entry.

    No broadcast hint: the ledger grows with the corpus, AQE picks the join by size.
    """
    return manifest.join(done(ledger), "path", "left_anti")


def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Set union of two ledgers' paths."""
    return ledger.select("path").unionByName(batch.select("path")).distinct()
