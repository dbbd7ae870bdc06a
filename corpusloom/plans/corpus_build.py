"""Corpus build: admit files, chunk, pack, publish, remember what is done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import elements
from corpusloom.functions.text import clean_utf8, utf8_bytes
from corpusloom.operators.admission import admit
from corpusloom.operators.packing import global_numbers, pack
from corpusloom.operators.semantic import semantic_chunks
from corpusloom.operators.splitting import node_id
from corpusloom.session import materialize
from corpusloom.sources.ledger import done, failed, latest, unprocessed
from corpusloom.sources.releases import commit, entries, head, history, write_run


@dataclass(frozen=True)
class BuildOptions:
    shard_bytes: int = 100_000_000
    per_folder: int | None = None
    total: int | None = None
    base_shard: int | None = None
    unit_mode: str = "window"
    bounded: bool = True
    assign: object = None


def chunk_table(docs: DataFrame, options: BuildOptions) -> DataFrame:
    """``(path, folder, folder_ord, chunk_no, text, bytes, file_name, node_id, status, error)``.

    A file without any chunk keeps one row: ``failed`` if splitting raised an error, ``empty`` if there was nothing to split.
    """
    clean = docs.withColumn("text", clean_utf8(F.col("text")))
    split = semantic_chunks(clean, options.unit_mode, options.assign, options.bounded, errors=True)
    ok = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    kept = split.withColumn("_c", F.when(ok, F.col("chunks")).otherwise(F.array(F.lit(None).cast("string"))))
    rows = kept.select(
        F.col("file_name").alias("path"), "folder", "folder_ord", "doc_id", "file_name", "chunk_error",
        F.posexplode(elements("_c")).alias("chunk_no", "text"),
    )
    return rows.select(
        "path", "folder", "folder_ord", "chunk_no", "text", utf8_bytes(F.col("text")).alias("bytes"), "file_name",
        node_id(F.col("doc_id"), F.col("chunk_no")).alias("node_id"),
        F.when(F.col("text").isNotNull(), "done").when(F.col("chunk_error").isNull(), "empty").otherwise("failed").alias("status"),
        F.when(F.col("text").isNull(), F.col("chunk_error")).alias("error"),
    )


@dataclass(frozen=True)
class Pending:
    """Chunks of a run that is not published yet, and the version whose ledger it started from."""

    chunks: DataFrame
    version: int
    options: BuildOptions


def prepare(spark: SparkSession, manifest: DataFrame, docs: DataFrame, out: str, options: BuildOptions = BuildOptions()) -> Pending:
    """Admit files that no published run has finished, and chunk them."""
    version, _ = head(spark, out)
    ledger = entries(spark, out, version)
    todo = admit(unprocessed(manifest, ledger), options.per_folder, options.total, failed(ledger))
    wanted = docs.join(todo.select(F.col("path").alias("file_name")), "file_name", "left_semi")
    # Chunks are used twice (sizes, then rows), so they are computed once and written.
    return Pending(materialize(chunk_table(wanted, options), "chunks"), version, options)


def publish(spark: SparkSession, pending: Pending, out: str) -> int | None:
    """Pack, write and commit a prepared run; its version, or None if other runs have finished all its files.

    Runs may overlap in time and in files. If another run commits first, files that it finished are left out here (the rest is
    packed anew), and shards are numbered after its own.
    """
    chunks, seen, run = pending.chunks, pending.version, None
    while True:
        version, following = head(spark, out)
        if version > seen:
            finished = done(entries(spark, out, version, after=seen))
            if not chunks.join(finished, "path", "left_semi").isEmpty():
                chunks, run = chunks.join(finished, "path", "left_anti"), None
            seen = version
        run = run or _write(chunks, out, pending.options)
        if not run["done"] + run["empty"] + run["failed"]:
            return None
        base = following if pending.options.base_shard is None else pending.options.base_shard
        _refuse_collision(spark, out, base, run["shards"])
        if commit(spark, out, version + 1, run, base):
            return version + 1


def build_corpus(spark: SparkSession, manifest: DataFrame, docs: DataFrame, out: str, options: BuildOptions = BuildOptions()) -> int | None:
    """One resumable run; the version it published, if there was anything to do.

    Shards are numbered after the published ones, unless ``base_shard`` is given; a base that would replace a published
    shard is refused. Shards, ledger and counters become visible by one commit. What a crash leaves behind is never read,
    and the next run starts from the last commit.
    """
    return publish(spark, prepare(spark, manifest, docs, out, options), out)


def _write(chunks: DataFrame, out: str, options: BuildOptions) -> dict:
    published = chunks.where("status = 'done'")
    sizes = published.groupBy("path", "folder", "folder_ord").agg(F.sum("bytes").alias("bytes"))
    packed = global_numbers(pack(sizes, options.shard_bytes, "folder"), "folder", "folder_ord")
    packed = materialize(packed.select("path", "shard"), "packed")
    rows = published.join(packed, "path").select("text", "file_name", "node_id", "shard")
    finished = packed.select("path", "shard", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    others = chunks.where("status <> 'done'").select("path", F.lit(None).cast("int").alias("shard"), "status", "error")
    return write_run(rows, finished.unionByName(others), out)


def _refuse_collision(spark: SparkSession, out: str, base: int, shards: int) -> None:
    taken = history(spark, out).where((F.col("base") < base + shards) & (F.col("base") + F.col("shards") > base))
    if not taken.isEmpty():
        raise ValueError(f"shards {base} to {base + shards - 1} would replace published ones")


def run_summary(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counters over all runs: each file of the manifest once, by its final status; files without an entry are ``pending``."""
    joined = manifest.join(latest(ledger).select("path", "status"), "path", "left")
    return joined.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(
        F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes")
    )
