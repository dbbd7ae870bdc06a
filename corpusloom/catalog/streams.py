"""Structured Streaming jobs, run over everything present and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import MODEL, WINDOWS, sql_words, turns
from corpusloom.catalog.chat import SQL_REQUEST
from corpusloom.functions.payloads import chat_payload
from corpusloom.operators.splitting import explode_chunks, window_units
from corpusloom.session import scratch_path
from corpusloom.sources.documents import table
from corpusloom.streaming import chat_state
from corpusloom.streaming.ingest import ingest, ingested


@query("str_ingest_chunks", f"WITH {WINDOWS} SELECT doc_id, chunk_no, chunk FROM windows")
def str_ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    landing, out, offsets = (scratch_path(spark, name) for name in ("landing", "stream", "offsets"))
    raw = table(spark, sf, "documents").select("doc_id", "text")
    raw.repartition(6).write.parquet(landing)

    def chunk(batch: DataFrame) -> DataFrame:
        return explode_chunks(batch, window_units(F.col("text")))

    # The second run finds nothing new; it must not add rows.
    for _ in range(2):
        ingest(spark, landing, raw.schema, chunk, out, offsets, files_per_batch=2).awaitTermination()
    return ingested(spark, out).select("doc_id", "chunk_no", "chunk")


def _sql_state(part: str) -> str:
    """Requests of user turns, with a history that starts anew in each ``part`` of a conversation."""
    window = f"(PARTITION BY conv_id, {part} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"WITH sized AS (SELECT conv_id, turn, role, text, len({sql_words('text')}) AS n FROM conversations), "
        f"state AS (SELECT *, coalesce(list({{'role': role, 'content': text}}) OVER {window}, []) AS history, "
        f"coalesce(sum(n) OVER {window}, 0) AS context_tokens FROM sized) "
        "SELECT conv_id, turn, len(history) + 1 AS n_messages, context_tokens::BIGINT AS context_tokens, 'ok' AS status, "
        f"{SQL_REQUEST} AS payload FROM state WHERE role = 'user'"
    )


def _requests(spark: SparkSession, raw: DataFrame, border: int) -> DataFrame:
    landing, out, offsets = (scratch_path(spark, name) for name in ("turns", "requests", "offsets"))
    # Early turns land first; files are read in the order they arrive.
    raw.where(F.col("turn") < border).repartition(4).write.mode("append").parquet(landing)
    raw.where(F.col("turn") >= border).repartition(4).write.mode("append").parquet(landing)
    chat_state.run(spark, landing, raw.schema, out, offsets, files_per_batch=4).awaitTermination()
    return _payloads(spark, out)


def _payloads(spark: SparkSession, out: str) -> DataFrame:
    messages = F.from_json("messages", "array<struct<role:string,content:string>>")
    return spark.read.schema(chat_state.OUTPUT).parquet(out).select(
        "conv_id", "turn", "n_messages", "context_tokens", "status", chat_payload(messages, F.lit(MODEL)).alias("payload")
    )


@query("str_chat_state", _sql_state("0"))
def str_chat_state(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, turns(spark, sf).select("conv_id", "turn", "role", "text"), 3)


@query("str_chat_reset", _sql_state("turn >= 4"))
def str_chat_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation forgets what came before its turn 4."""
    doubled = turns(spark, sf).select("conv_id", (F.col("turn") * 2).alias("turn"), "role", "text")
    marks = doubled.select("conv_id").distinct().select(
        "conv_id", F.lit(7).cast("long").alias("turn"), F.lit(chat_state.RESET).alias("role"), F.lit("").alias("text")
    )
    return _requests(spark, doubled.unionByName(marks), 6).withColumn("turn", F.expr("turn div 2"))


@query("str_chat_shuffled", _sql_state("0"))
def str_chat_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that arrive in any order, over several batches, give the requests of the ordered conversation."""
    landing, out, offsets = (scratch_path(spark, name) for name in ("turns", "requests", "offsets"))
    raw = turns(spark, sf).select("conv_id", "turn", "role", "text")
    raw.repartition(6, F.xxhash64("turn", "conv_id")).write.parquet(landing)
    chat_state.run(spark, landing, raw.schema, out, offsets, files_per_batch=2, patience_ms=3_600_000).awaitTermination()
    return _payloads(spark, out)
