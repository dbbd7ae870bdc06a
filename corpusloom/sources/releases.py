"""Datasets published by atomic commits: shards and ledger rows of a run become visible together, or not at all.

Layout under the root of a dataset::

    data/run=<id>/part=<n>/   rows of a run; parts are numbered within the run
    ledger/run=<id>/          what the run did with each file
    _commits/<version>.json   one record a version: the run, the number of its first shard, its counters

A run writes its folders first; nobody reads folders that no record names. It is published by creating the record of the next version,
which fails if that record is there already. The loser of such a race looks at what was published meanwhile and tries
again with the version after that. Its shards need not be written again to get other numbers: shard = part + base.
"""

from __future__ import annotations

import json
import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.pages import NO_VALUE, opened

RECORD = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("run", T.StringType()),
    T.StructField("base", T.IntegerType()),
    T.StructField("shards", T.IntegerType()),
    *(T.StructField(name, T.LongType()) for name in ("done", "empty", "failed", "chunks", "bytes")),
])
#: Tasks move their files to the run's folder themselves; nobody reads it before the commit, so the driver need not move them one by one.
_IN_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
_ENTRY = "path string, part int, status string, error string, run string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, unless there is one; whether this call made it.

    The content is written aside and renamed, which the store must refuse if the target exists (as HDFS does). On a local
    disk, where Hadoop's rename does not, a hard link does the same.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if target.toUri().getScheme() == "file":
            os.link(*(urllib.parse.unquote(p.toUri().getRawPath()) for p in (aside, target)))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            options = spark.sparkContext._gateway.new_array(rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)
    except FileExistsError:
        return False
    except Py4JJavaError as exc:
        if not exc.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    finally:
        fs.delete(aside, False)
    return True


def history(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Commit records, one row a published run, up to ``version``; no rows before the first."""
    if not _exists(spark, f"{root}/_commits"):
        return spark.createDataFrame([], RECORD)
    records = spark.read.schema(RECORD).json(f"{root}/_commits")
    return records if version is None else records.where(F.col("version") <= version)


def head(spark: SparkSession, root: str) -> tuple[int, int]:
    """Latest version (0 before the first) and the number after the last shard."""
    row = history(spark, root).agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("version"),
        F.coalesce(F.max(F.col("base") + F.col("shards")), F.lit(0)).alias("following"),
    ).first()
    return row["version"], row["following"]


class _PartFile:
    """Rows of one part from one task. The file gets its name when it is whole, so that a second attempt cannot mix with it."""

    def __init__(self, store: fs.FileSystem, folder: str, schema: pa.Schema) -> None:
        task = TaskContext.get()
        store.create_dir(folder, recursive=True)
        self.store, self.name = store, f"{folder}/rows-{task.partitionId():05d}.parquet"
        self.aside = f"{folder}/.rows-{task.partitionId():05d}.{task.taskAttemptId()}"
        self.stream = store.open_output_stream(self.aside)
        self.writer = pq.ParquetWriter(self.stream, schema)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()
        try:
            self.store.move(self.aside, self.name)
        except OSError:
            # Some stores do not rename onto a file, which then is that of another attempt: the same rows.
            if self.store.get_file_info(self.name).type != fs.FileType.File:
                raise
            self.store.delete_file(self.aside)


def _part_writer(folder: str) -> Callable:
    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        file, now = None, None
        for batch in batches:
            at = batch.schema.get_field_index("part")
            parts, rows = batch.column(at).fill_null(-1).to_numpy(), pa.Table.from_batches([batch]).remove_column(at)
            size = pc.sum(pc.binary_length(rows["text"])).as_py() or 0
            starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for start, end in zip(starts, np.append(starts[1:], len(parts)), strict=True):
                if file is None or parts[start] != now:
                    if file is not None:
                        file.close()
                    now = parts[start]
                    file = _PartFile(store, f"{base}/part={NO_VALUE if now < 0 else now}", rows.schema)
                file.writer.write_table(rows.slice(start, end - start))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in (len(parts), size)], ["chunks", "bytes"])
        if file is not None:
            file.close()

    return write_batches


def _write_parts(rows: DataFrame, folder: str) -> dict:
    """Write rows below ``folder`` as ``part=<n>/``, in the tasks that hold them; their number and the bytes of their texts.

    Rows are spread by part so that a part does not end in one small file per task; AQE splits one that is far larger than the
    others. Spark's own writer starts a process for each folder and file on a local disk, which took nine tenths of its time
    where parts are small; it stays in use where Python cannot open the store.
    """
    spread = rows.hint("rebalance", "part")
    try:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
    except (OSError, ImportError, pa.ArrowException):
        written = Observation()
        out = spread.observe(written, F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))
        out.write.options(**_IN_TASKS).partitionBy("part").parquet(folder)
        return written.get
    told = spread.sortWithinPartitions("part").mapInArrow(_part_writer(folder), "chunks long, bytes long")
    return told.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in told.columns)).first().asDict()


def write_run(rows: DataFrame | None, entries: DataFrame, root: str, shard: str = "shard") -> dict:
    """Write a run's rows (with ``shard`` from 0) and ledger entries ``(path, shard, status, error)``; what a commit needs to know.

    Counters are taken from the rows as they are written; nothing is read again.
    """
    run = f"r{uuid.uuid4().hex}"
    told, sums = Observation(), {"chunks": 0, "bytes": 0}
    if rows is not None:
        sums = _write_parts(rows.withColumnRenamed(shard, "part"), f"{root}/data/run={run}")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("done", "empty", "failed")]
    shards = (F.coalesce(F.max("part"), F.lit(-1)) + 1).alias("shards")
    listed = entries.select("path", F.col(shard).cast("int").alias("part"), "status", "error").observe(told, *counts, shards)
    listed.write.options(**_IN_TASKS).parquet(f"{root}/ledger/run={run}")
    return {"run": run, **told.get, **sums}


def adopt(entries: DataFrame, root: str) -> None:
    """Publish ledger entries of files that were processed elsewhere; their shard numbers stay as they are."""
    run = write_run(None, entries, root)
    spark = entries.sparkSession
    while not commit(spark, root, head(spark, root)[0] + 1, run, 0):
        pass


def commit(spark: SparkSession, root: str, version: int, run: dict, base: int) -> bool:
    """Publish a written run as ``version``; false if another run got that version first."""
    record = {"version": version, **run, "base": base}
    return put_if_absent(spark, f"{root}/_commits/{version:010d}.json", json.dumps(record, sort_keys=True))


def entries(spark: SparkSession, root: str, version: int | None = None, after: int = 0) -> DataFrame:
    """Ledger ``(path, shard, status, error)`` of the published runs up to ``version``, and only those ``after`` one."""
    runs = history(spark, root, version).where(F.col("version") > after)
    there = _exists(spark, f"{root}/ledger")
    told = spark.read.schema(_ENTRY).parquet(f"{root}/ledger") if there else spark.createDataFrame([], _ENTRY)
    # A record a run: the join also prunes the folders of runs that are not published.
    joined = told.join(F.broadcast(runs.select("run", "base")), "run")
    return joined.select("path", (F.col("part") + F.col("base")).alias("shard"), "status", "error")


def read_release(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Published rows as of ``version`` (the latest by default), with their ``shard``."""
    rows = spark.read.parquet(f"{root}/data")
    joined = rows.join(F.broadcast(history(spark, root, version).select("run", "base")), "run")
    return joined.select(*(c for c in rows.columns if c not in ("run", "part")), (F.col("part") + F.col("base")).cast("int").alias("shard"))


def read_release_shard(spark: SparkSession, root: str, number: int) -> DataFrame:
    """One published shard; other folders are not listed. No rows if there is no such shard."""
    of = history(spark, root).where((F.col("base") <= number) & (F.col("base") + F.col("shards") > number) & (F.col("chunks") > 0)).first()
    if of is None:
        return read_release(spark, root).where(F.lit(False))
    folder = f"{root}/data/run={of['run']}"
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/part={number - of['base']}")
    return rows.drop("part").withColumn("shard", F.lit(number))
