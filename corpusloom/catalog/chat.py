"""Chat histories, request bodies, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import INSTRUCTION_ROWS, MODEL, SYSTEM_TEXT, docs, instruction_rows, sql_text, sql_words, turns
from corpusloom.functions.payloads import (
    all_choices, chat_payload, completion_payload, first_chat_choice, first_text_choice, message, serving_payload,
)
from corpusloom.functions.prompts import test_prompt
from corpusloom.operators.conversation import request_messages, successful, with_context_size, with_first_system, with_history
from corpusloom.operators.generation import status_column
from corpusloom.sources.documents import table

_HISTORY = (
    "hist AS (SELECT conv_id, turn, role, text, coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history FROM conversations)"
)


@query("chat_history", f"WITH {_HISTORY} SELECT conv_id, turn, role, len(history)::INT AS n_messages, to_json(history)::VARCHAR AS history FROM hist")
def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_history(turns(spark, sf))
    return rows.select("conv_id", "turn", "role", F.size("history").alias("n_messages"), F.to_json("history").alias("history"))


#: Turns as sparse numbers that begin below zero.
SPARSE = "(turn * 1000003 - 3000000)"


@query("chat_history_sparse", f"WITH {_HISTORY} SELECT conv_id, {SPARSE} AS turn, len(history)::INT AS n_messages, "
                              "to_json(history)::VARCHAR AS history FROM hist")
def chat_history_sparse(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_history(turns(spark, sf).withColumn("turn", F.expr(SPARSE)))
    return rows.select("conv_id", "turn", F.size("history").alias("n_messages"), F.to_json("history").alias("history"))


_REPEATED = "SELECT conv_id, turn, role, text || ' (again)' FROM conversations WHERE role = 'user'"


@query("chat_history_repeated", f"WITH twice AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_REPEATED}), "
       "hist AS (SELECT conv_id, turn, text, coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn, role, "
       "text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history FROM twice) "
       "SELECT conv_id, turn, text, len(history)::INT AS n_messages, to_json(history)::VARCHAR AS history FROM hist")
def chat_history_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """User turns that were sent twice: every row stays, in the order of its text."""
    rows = turns(spark, sf).select("conv_id", "turn", "role", "text")
    again = rows.where("role = 'user'").withColumn("text", F.concat("text", F.lit(" (again)")))
    kept = with_history(rows.unionByName(again))
    return kept.select("conv_id", "turn", "text", F.size("history").alias("n_messages"), F.to_json("history").alias("history"))


# Exchanges of an assistant turn longer than 1,000 characters count as failed here.
@query("chat_history_failed", "WITH kept AS (SELECT * FROM conversations WHERE NOT (role = 'assistant' AND len(text) > 1000)), "
       "hist AS (SELECT conv_id, turn, coalesce(list({'role': role, 'content': text}) OVER (PARTITION BY conv_id ORDER BY turn "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history FROM kept) "
       "SELECT conv_id, turn, len(history)::INT AS n_messages, to_json(history)::VARCHAR AS history FROM hist")
def chat_history_failed(spark: SparkSession, sf: str) -> DataFrame:
    failed = (F.col("role") == "assistant") & (F.char_length("text") > 1000)
    rows = turns(spark, sf).withColumn("status", F.when(failed, 500).otherwise(200))
    kept = with_history(successful(rows))
    return kept.select("conv_id", "turn", F.size("history").alias("n_messages"), F.to_json("history").alias("history"))


_TAIL = "'frequency_penalty': 0.0::DOUBLE, 'presence_penalty': 0.0::DOUBLE, 'stop': ['[/INST]', '</s>'], 'repetition_penalty': 1, 'top_k': 50"


#: Request body of a user turn, from its history.
SQL_REQUEST = (
    f"to_json({{'model': '{MODEL}', 'messages': list_append(history, {{'role': 'user', 'content': text}}), "
    f"'temperature': 0.7::DOUBLE, 'max_tokens': 1000, 'top_p': 0.7::DOUBLE, {_TAIL}}})::VARCHAR"
)


@query("chat_payload_json", f"WITH {_HISTORY} SELECT conv_id, turn, {SQL_REQUEST} AS payload FROM hist WHERE role = 'user'")
def chat_payload_json(spark: SparkSession, sf: str) -> DataFrame:
    users = with_history(turns(spark, sf)).where("role = 'user'")
    body = chat_payload(request_messages(F.col("history"), F.col("text")), F.lit(MODEL))
    return users.select("conv_id", "turn", body.alias("payload"))


_PROMPT = "'<s>[INST] ' || instruction || chr(10) || input || ' [/INST]'"


@query("cmp_payload_json", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, to_json({{'model': '{MODEL}', 'prompt': {_PROMPT}, 'temperature': 0.7::DOUBLE, "
                           "'max_tokens': 1000, 'top_p': 0.7::DOUBLE, 'stop': ['</s>'], 'repetition_penalty': 1, 'top_k': 50})::VARCHAR AS payload FROM rows")
def cmp_payload_json(spark: SparkSession, sf: str) -> DataFrame:
    prompt = test_prompt(F.col("instruction"), F.col("input"))
    return instruction_rows(spark, sf).select("doc_id", completion_payload(prompt, F.lit(MODEL)).alias("payload"))


@query("srv_payload_json", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, to_json({{'messages': [{{'role': 'user', 'content': request}}], 'n': 1, "
                           "'temperature': 0.9::DOUBLE, 'max_tokens': 1000, 'min_tokens': 1, "
                           f"'model': '{MODEL}', 'skip_special_tokens': true, 'top_k': 50, 'SamplingParams': "
                           "{'min_tokens': 1, 'skip_special_tokens': true, 'top_k': 50}})::VARCHAR AS payload FROM rows")
def srv_payload_json(spark: SparkSession, sf: str) -> DataFrame:
    return instruction_rows(spark, sf).select("doc_id", serving_payload(F.col("request"), F.lit(MODEL)).alias("payload"))


@query("rsp_parse_json", "SELECT doc_id, text AS chat_text, text AS completion_text, 2 AS n_choices, text || ' ' AS second_choice FROM documents")
def rsp_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    chat = F.to_json(F.struct(F.array(
        F.struct(message(F.lit("assistant"), text).alias("message")),
        F.struct(message(F.lit("assistant"), F.concat(text, F.lit(" "))).alias("message")),
    ).alias("choices")))
    plain = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices")))
    bodies = docs(spark, sf).select("doc_id", chat.alias("chat"), plain.alias("plain"))
    return bodies.select(
        "doc_id", first_chat_choice(F.col("chat")).alias("chat_text"), first_text_choice(F.col("plain")).alias("completion_text"),
        F.size(all_choices(F.col("chat"))).alias("n_choices"), F.get(all_choices(F.col("chat")), F.lit(1)).alias("second_choice"),
    )


@query("rsp_status_route", "WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT d.doc_id, "
                           "CASE WHEN b.doc_id IS NULL THEN 200 ELSE 429 END AS http_status, "
                           "CASE WHEN b.doc_id IS NULL THEN d.text END AS answer, "
                           "CASE WHEN b.doc_id IS NOT NULL THEN 'Error 429: slow down' END AS error FROM documents d LEFT JOIN bad b USING (doc_id)")
def rsp_status_route(spark: SparkSession, sf: str) -> DataFrame:
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(429).alias("code")).distinct()
    good = F.to_json(F.struct(F.array(F.struct(message(F.lit("assistant"), F.col("text")).alias("message"))).alias("choices")))
    raw = docs(spark, sf).select("doc_id", "text").join(bad, "doc_id", "left").select(
        "doc_id", F.coalesce("code", F.lit(200)).alias("http_status"),
        F.when(F.col("code").isNull(), good).otherwise(F.lit("slow down")).alias("body"),
    )
    answer, error = status_column(F.col("http_status"), F.col("body"))
    return raw.select("doc_id", "http_status", answer.alias("answer"), error.alias("error"))


@query("chat_system_first", f"SELECT conv_id, turn, role, text, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN {sql_text(SYSTEM_TEXT)} END "
                            "AS system FROM conversations WHERE role = 'user'")
def chat_system_first(spark: SparkSession, sf: str) -> DataFrame:
    return with_first_system(turns(spark, sf).where("role = 'user'"), SYSTEM_TEXT).select("conv_id", "turn", "role", "text", "system")


@query("chat_context_size", f"WITH sized AS (SELECT conv_id, turn, role, len({sql_words('text')}) AS n FROM conversations) "
                            "SELECT conv_id, turn, role, n::BIGINT AS n_tokens, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn "
                            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS context_tokens FROM sized")
def chat_context_size(spark: SparkSession, sf: str) -> DataFrame:
    return with_context_size(turns(spark, sf)).select("conv_id", "turn", "role", "n_tokens", "context_tokens")
