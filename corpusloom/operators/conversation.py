"""Chat histories and their request bodies.

A conversation of any length is cut into segments of consecutive turns, so no
task holds more than one history plus one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.payloads import message
from corpusloom.functions.text import words
from corpusloom.plans.ranking import with_rank

SEGMENT = 64


def successful(turns: DataFrame, status: str = "status") -> DataFrame:
    """Failed exchanges leave no trace in the history."""
    return turns.where(F.col(status) == 200)


def with_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", segment: int = SEGMENT) -> DataFrame:
    """Add ``history``: all earlier messages of the conversation, in turn order.

    Only the order of a turn counts, so gaps, negative numbers and time stamps do. Rows that repeat a turn number (retries, a log
    written twice) all stay, in the order of role and text, and each sees those before it.
    """
    ranked = with_rank(turns, [turn, "role", "text"], [conv], "_rank")
    rows = ranked.withColumn("_seg", F.floor((F.col("_rank") - 1) / segment))
    inside = Window.partitionBy(conv, "_seg").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.collect_list(message(F.col("role"), F.col("text"))).over(inside))

    # Whole earlier segments are only collected where a conversation has several.
    last = rows.groupBy(conv).agg(F.max("_seg").alias("_last")).where("_last > 0")
    blocks = (
        rows.join(last, conv).where("_seg < _last")
        .groupBy(conv, "_seg", "_last")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", message(F.col("role"), F.col("text")).alias("m")))).alias("b"))
    )
    copies = blocks.select(
        conv, F.col("_seg").alias("_from"), F.col("b.m").alias("m"),
        F.explode(F.sequence(F.col("_seg") + 1, F.col("_last"))).alias("_seg"),
    )
    far = copies.groupBy(conv, "_seg").agg(F.array_sort(F.collect_list(F.struct("_from", "m"))).alias("f"))
    far = far.select(conv, "_seg", F.flatten(F.col("f.m")).alias("_far"))

    joined = near.join(far, [conv, "_seg"], "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    return joined.withColumn(
        "history", F.concat(F.coalesce("_far", none), F.col("_near"))
    ).select(*turns.columns, "history")


def with_context_size(turns: DataFrame, size: Column | None = None, conv: str = "conv_id", turn: str = "turn",
                      segment: int = SEGMENT) -> DataFrame:
    """Add ``context_tokens``: tokens of all earlier messages.

    Running sums inside segments plus the totals of earlier segments; the second
    window sees one row per segment. Rows that repeat a turn number follow each other, the shorter one first.
    """
    rows = turns.withColumn("_n", size if size is not None else F.size(words(F.col("text"))).cast("long"))
    rows = rows.withColumn("_seg", F.floor(F.col(turn) / segment))
    earlier = Window.partitionBy(conv).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(conv, "_seg").agg(F.sum("_n").alias("_t"))
    totals = totals.select(conv, "_seg", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(conv, "_seg").orderBy(turn, "_n").rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return (
        rows.withColumn("_near", near).join(totals, [conv, "_seg"])
        .withColumn("context_tokens", F.col("_base") + F.col("_near"))
        .withColumnRenamed("_n", "n_tokens").drop("_seg", "_near", "_base")
    )


def request_messages(history: Column, user_input: Column, system: Column | None = None) -> Column:
    """History and the new user message, after an optional system message."""
    body = F.concat(history, F.array(message(F.lit("user"), user_input)))
    if system is None:
        return body
    return F.when(system.isNull(), body).otherwise(F.concat(F.array(message(F.lit("system"), system)), body))


def with_first_system(turns: DataFrame, system: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add ``system``: the text on the first turn of each conversation, NULL elsewhere.

    The join is on conversation *and* turn, so a long conversation stays spread out.
    """
    first = turns.groupBy(conv).agg(F.min(turn).alias(turn)).withColumn("system", F.lit(system))
    return turns.join(first, [conv, turn], "left")
