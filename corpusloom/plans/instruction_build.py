"""Instruction data: one generated row per chunk, failures routed aside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.payloads import INSTRUCTION_SAMPLING, chat_payload, message
from corpusloom.operators.generation import call_model, with_answer
from corpusloom.operators.instructions import assign_template, requests


def build_instructions(chunks: DataFrame, key: Column, model: str, make_client, seed: int = 3,
                       sampling: Mapping[str, object] = INSTRUCTION_SAMPLING, **call_options) -> DataFrame:
    """Chunks to ``instruction, input, output`` with status; narrow from end to end."""
    rows = requests(assign_template(chunks, key, seed))
    body = chat_payload(F.array(message(F.lit("user"), F.col("request"))), F.lit(model), sampling)
    answered = with_answer(call_model(rows.withColumn("payload", body), "payload", make_client, **call_options))
    return answered.withColumn("output", F.col("generated_text")).drop(
        "payload", "request", "response", "generated_text"
    )
