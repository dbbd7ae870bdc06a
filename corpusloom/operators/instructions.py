"""Instruction rows: a task template for each chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import choice
from corpusloom.functions.prompts import TASK_TEMPLATES, request_text


def template_table(df: DataFrame, templates: Sequence[tuple] = TASK_TEMPLATES) -> DataFrame:
    """The template list as a table; its size is the length of the argument."""
    return df.sparkSession.createDataFrame(
        list(templates), "template_id int, task string, instruction string, placeholder string"
    )


def all_templates(chunks: DataFrame, text: str = "text", templates: Sequence[tuple] = TASK_TEMPLATES) -> DataFrame:
    """Every template applied to every chunk."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("template_id"), F.lit(task).alias("task"), F.lit(instruction).alias("instruction"),
                 F.lit(out).alias("output"))
        for i, task, instruction, out in templates
    ])
    return chunks.withColumn("_t", F.explode(rows)).select(
        *[c for c in chunks.columns if c != text], "_t.template_id", "_t.task", "_t.instruction",
        F.col(text).alias("input"), "_t.output",
    )


def assign_template(chunks: DataFrame, key: Column, seed: int = 3, text: str = "text",
                    templates: Sequence[tuple] = TASK_TEMPLATES) -> DataFrame:
    """One template per chunk, chosen by a seeded hash of its key; a map-side lookup."""
    chosen = chunks.withColumn("template_id", choice(seed, key, len(templates)))
    # The template table is the argument list itself, so broadcasting it is bounded.
    joined = chosen.join(F.broadcast(template_table(chunks, templates)), "template_id")
    return joined.select(
        *[c for c in chunks.columns if c != text], "template_id", "task", "instruction",
        F.col(text).alias("input"), F.col("placeholder").alias("output"),
    )


def requests(rows: DataFrame) -> DataFrame:
    """Add ``request``, the text of the single user message."""
    return rows.withColumn("request", request_text(F.col("instruction"), F.col("input")))
