import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.functions.payloads import chat_payload, message
from corpusloom.operators.generation import call_model, multi_turn, per_model, route, with_answer

# Workers cannot import the test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def requests(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    return frame.withColumn("payload", chat_payload(F.array(message(F.lit("user"), F.col("text"))), F.lit("m")))


def flaky_client():
    calls = {}

    def call(request):
        text = json.loads(request)["messages"][-1]["content"]
        calls[text] = calls.get(text, 0) + 1
        if text == "raise":
            raise OSError("down")
        if text == "busy":
            return 429, "slow down"
        if text == "second" and calls[text] == 1:
            return 503, "again"
        if text == "hang":
            time.sleep(3)
        return 200, json.dumps({"choices": [{"message": {"content": "" if text == "empty" else f" {text}! "}}]})

    return call


@pytest.fixture(scope="module")
def answers(spark):
    texts = ["hello", "raise", "busy", "second", "hang", "empty"]
    done = with_answer(call_model(requests(spark, texts), "payload", flaky_client, timeout=1.0, attempts=2, parallel=2))
    done = done.persist()
    return {r.text: r for r in done.collect()}, done


def test_every_row_has_a_status(answers):
    rows, _ = answers
    assert {t: r.status for t, r in rows.items()} == {
        "hello": "ok", "raise": "failed", "busy": "failed", "second": "ok", "hang": "timeout", "empty": "too_short",
    }
    assert rows["hello"].generated_text == "hello!"
    assert rows["raise"].error == "OSError: down"
    assert (rows["busy"].http_status, rows["busy"].error) == (429, "Error 429: slow down")


def test_routing_keeps_all_rows(answers):
    rows, done = answers
    accepted, rejected = route(done)
    assert accepted.count() + rejected.count() == len(rows)


def test_multi_turn_history_and_failures(spark):
    def client():
        def call(request):
            messages = json.loads(request)["messages"]
            if messages[-1]["content"] == "fail":
                return 500, "no"
            return 200, json.dumps({"choices": [{"message": {"content": "/".join(m["content"] for m in messages)}}]})

        return call

    frame = spark.createDataFrame(
        [(1, 0, "a"), (1, 2, "fail"), (1, 4, "b"), (2, 0, "c")], "conv_id long, turn long, text string"
    )
    got = {(r.conv_id, r.turn): r for r in multi_turn(frame, "m", client, system="S").collect()}
    assert got[1, 0].answer == "S/a"
    assert got[1, 2].answer is None and got[1, 2].error == "Error 500: no"
    assert got[1, 4].answer == "S/a/S/a/b"
    assert got[2, 0].answer == "S/c"


def test_per_model(spark):
    frame = per_model(spark.range(4), ["x", "y"])
    assert frame.groupBy("model").count().orderBy("model").collect() == [("x", 4), ("y", 4)]
