import json

from pyspark.sql import functions as F

from corpusloom.functions.payloads import chat_payload
from corpusloom.operators.conversation import (
    request_messages, successful, with_context_size, with_first_system, with_history,
)


def turns(spark, n, conv=1):
    rows = [(conv, i, "user" if i % 2 == 0 else "assistant", f"m{i} x") for i in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_history_over_segments(spark):
    frame = turns(spark, 23).unionByName(turns(spark, 2, conv=2))
    for r in with_history(frame, segment=5).collect():
        assert [m.content for m in r.history] == [f"m{i} x" for i in range(r.turn)]


def test_context_over_segments(spark):
    for r in with_context_size(turns(spark, 23), segment=4).collect():
        assert (r.n_tokens, r.context_tokens) == (2, 2 * r.turn)


def test_failed_turns_leave_no_trace(spark):
    frame = turns(spark, 4).withColumn("status", F.when(F.col("turn").isin(2, 3), 500).otherwise(200))
    last = with_history(successful(frame)).orderBy(F.col("turn").desc()).first()
    assert (last.turn, len(last.history)) == (1, 1)


def test_new_conversation_starts_empty(spark):
    frame = turns(spark, 3).unionByName(turns(spark, 1, conv=2))
    assert with_history(frame).where("conv_id = 2").first().history == []


def test_system_only_first(spark):
    frame = with_first_system(turns(spark, 6), "be kind")
    assert {(r.turn, r.system) for r in frame.collect() if r.system} == {(0, "be kind")}


def test_payload(spark):
    frame = with_first_system(with_history(turns(spark, 3)), "S")
    body = chat_payload(request_messages(F.col("history"), F.col("text"), F.col("system")), F.lit("m"))
    got = {r.turn: json.loads(r.b) for r in frame.select("turn", body.alias("b")).collect()}
    assert [m["role"] for m in got[0]["messages"]] == ["system", "user"]
    assert [m["content"] for m in got[2]["messages"]] == ["m0 x", "m1 x", "m2 x"]
    assert got[2]["stop"] == ["[/INST]", "</s>"] and got[2]["top_k"] == 50


def test_repeated_turns_all_stay(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 2, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for segment in (2, 64):
        got = sorted((r.turn, [m.content for m in r.history]) for r in with_history(frame, segment=segment).collect())
        assert got == [(0, []), (0, ["a"]), (1, ["a", "b"]), (1, ["a", "b", "x"]), (2, ["a", "b", "x", "x"])]
    sizes = with_context_size(frame, F.coalesce(F.length("text"), F.lit(0)).cast("long"), segment=2)
    assert sorted(r.context_tokens for r in sizes.collect()) == [0, 1, 2, 3, 4]
