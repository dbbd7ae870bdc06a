"""Calls to a text model. No model is at hand, so stand-in clients answer; these queries check the calls, not a model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import (
    INSTRUCTION_ROWS, MODEL, SYSTEM_TEXT, TEMPLATES, WINDOWS, instruction_rows, sql_choice, sql_words, turns,
)
from corpusloom.catalog.instructions import _CHUNK_KEY, window_chunks
from corpusloom.functions.payloads import chat_payload, completion_payload, message
from corpusloom.functions.prompts import test_prompt
from corpusloom.functions.text import words
from corpusloom.operators.generation import Client, call_model, multi_turn, per_model, with_answer
from corpusloom.plans.instruction_build import build_instructions
from corpusloom.plans.model_eval import held_out_predictions

_PROMPT = "'<s>[INST] ' || instruction || chr(10) || input || ' [/INST]'"


STUB_WORDS = 20


def echo_client() -> Client:
    """Answers with the first words of the last message."""
    def call(request: str) -> tuple[int, str]:
        body = json.loads(request)
        if "messages" in body:
            text = " ".join(body["messages"][-1]["content"].split()[:STUB_WORDS])
            return 200, json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]})
        text = " ".join(body["prompt"].split()[:STUB_WORDS])
        return 200, json.dumps({"choices": [{"text": text}]})

    return call


def counting_client() -> Client:
    """Answers with the number of messages in the request and the first words of the last."""
    def call(request: str) -> tuple[int, str]:
        messages = json.loads(request)["messages"]
        text = " ".join([f"{len(messages)}:", *messages[-1]["content"].split()[:STUB_WORDS]])
        return 200, json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]})

    return call


def faulty_client() -> Client:
    """As :func:`counting_client`; texts of an odd length get no usable answer: an error, or a body without choices."""
    good = counting_client()

    def call(request: str) -> tuple[int, str]:
        size = len(json.loads(request)["messages"][-1]["content"])
        if size % 4 == 1:
            return 500, "no"
        return (200, "{}") if size % 4 == 3 else good(request)

    return call


def _first20(x: str) -> str:
    return f"array_to_string({sql_words(x)}[1:20], ' ')"


@query("gen_completion", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, 200 AS http_status, 'ok' AS status, {_first20(_PROMPT)} AS generated_text FROM rows")
def gen_completion(spark: SparkSession, sf: str) -> DataFrame:
    prompt = test_prompt(F.col("instruction"), F.col("input"))
    rows = instruction_rows(spark, sf).select("doc_id", completion_payload(prompt, F.lit(MODEL)).alias("payload"))
    return with_answer(call_model(rows, "payload", echo_client), "completion").select("doc_id", "http_status", "status", "generated_text")


@query("gen_instruct", f"WITH {TEMPLATES}, {WINDOWS} SELECT w.doc_id, w.chunk_no, t.instruction, w.chunk AS input, "
                       f"{_first20(chr(40) + 't.instruction || chr(32) || w.chunk' + chr(41))} AS output, 'ok' AS status FROM windows w "
                       f"JOIN templates t ON t.template_id = {sql_choice(_CHUNK_KEY, 3)}")
def gen_instruct(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_instructions(window_chunks(spark, sf), F.concat_ws("/", "doc_id", "chunk_no"), MODEL, echo_client)
    return rows.select("doc_id", "chunk_no", "instruction", "input", "output", "status")


@query("gen_batch", f"WITH {INSTRUCTION_ROWS}, ranked AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) AS r, "
                    f"count(*) OVER () AS n FROM rows) SELECT doc_id, {_PROMPT} AS prompt, {_first20(_PROMPT)} AS generated_text, "
                    "output AS reference_text, 'ok' AS status FROM ranked WHERE r <= ceil(round(n * 0.05, 9))")
def gen_batch(spark: SparkSession, sf: str) -> DataFrame:
    return held_out_predictions(instruction_rows(spark, sf), "doc_id", MODEL, echo_client)


@query("gen_multi_turn", "WITH asked AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations "
                         "WHERE role = 'user') SELECT conv_id, turn, (2 * rn)::INT AS n_messages, 200 AS http_status, "
                         f"(2 * rn)::VARCHAR || ': ' || {_first20('text')} AS answer, NULL::VARCHAR AS error FROM asked")
def gen_multi_turn(spark: SparkSession, sf: str) -> DataFrame:
    return multi_turn(turns(spark, sf).where("role = 'user'"), MODEL, counting_client, system=SYSTEM_TEXT)


@query("gen_multi_turn_failures", "WITH asked AS (SELECT conv_id, turn, text, len(text) % 4 AS m, coalesce(sum(CASE WHEN len(text) % 2 = 0 THEN 1 "
                                  "ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good "
                                  "FROM conversations WHERE role = 'user') SELECT conv_id, turn, (2 * good + 2)::INT AS n_messages, "
                                  "CASE WHEN m = 1 THEN 500 ELSE 200 END AS http_status, CASE WHEN m IN (0, 2) THEN (2 * good + 2)::VARCHAR || ': ' "
                                  f"|| {_first20('text')} END AS answer, CASE m WHEN 1 THEN 'Error 500: no' WHEN 3 THEN 'malformed answer' END AS error FROM asked")
def gen_multi_turn_failures(spark: SparkSession, sf: str) -> DataFrame:
    return multi_turn(turns(spark, sf).where("role = 'user'"), MODEL, faulty_client, system=SYSTEM_TEXT)


MODELS = ["base-model", "tuned-model"]


@query("gen_compare", "SELECT m.model, count(*) AS n_prompts, sum(len(" + sql_words("text") + "[1:20]))::BIGINT AS answer_words FROM conversations, "
                      "(VALUES ('base-model'), ('tuned-model')) m(model) WHERE role = 'user' GROUP BY m.model")
def gen_compare(spark: SparkSession, sf: str) -> DataFrame:
    asked = per_model(turns(spark, sf).where("role = 'user'"), MODELS)
    body = chat_payload(F.array(message(F.lit("user"), F.col("text"))), F.col("model"))
    answered = with_answer(call_model(asked.withColumn("payload", body).select("model", "payload"), "payload", echo_client))
    return answered.groupBy("model").agg(
        F.count("*").alias("n_prompts"), F.sum(F.size(words(F.col("generated_text")))).cast("long").alias("answer_words")
    )
