import pytest
from pyspark.sql import functions as F

from corpusloom.operators.vocabulary import (
    IGNORE, completion_labels, decode, encode, length_status, pad_batches, prompt_tokens, trained_share, truncate, vocabulary,
)


def rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    return frame.withColumn("tokens", prompt_tokens(F.col("prompt")))


def test_ids_by_count_then_token(spark):
    vocab = vocabulary(rows(spark, ["b a b c", "</s> c c"]), "tokens")
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("c", 3), ("b", 4), ("a", 5)]


@pytest.fixture(params=[20_000, 3, 1])
def head(request, monkeypatch):
    """From all of a small vocabulary on the map side to hardly any."""
    monkeypatch.setattr("corpusloom.operators.vocabulary.HEAD_ROWS", request.param)


def test_encoding_is_the_same_for_any_head(spark, head):
    data = rows(spark, ["b a b c <s>", "", "z z a", "c </s>"]).withColumn("other", F.lit(7))
    vocab = vocabulary(rows(spark, ["b a b c", "c c"]), "tokens")
    got = encode(data, "id", "tokens", vocab)
    assert got.columns == [*data.columns, "input_ids"]
    assert {r.id: r.input_ids for r in got.collect()} == {0: [4, 5, 4, 3, 1], 1: [], 2: [0, 0, 5], 3: [3, 2]}
    ended = encode(data, "id", "tokens", vocab, append_end=True).where("id = 1").first()
    assert ended.input_ids == [2]


def test_nulls_repeated_keys_and_tokens_with_spaces(spark, head):
    schema = "id int, tokens array<string>"
    vocab = vocabulary(spark.createDataFrame([(0, ["a b", "a b", "c", "c", "c", "d"])], schema), "tokens")
    data = spark.createDataFrame([(1, ["a b", "d"]), (1, ["c", "x"]), (None, ["d"]), (2, None), (3, ["a", "b"])], schema)
    coded = encode(data, "id", "tokens", vocab)
    want = [(1, [4, 5]), (1, [3, 0]), (None, [5]), (2, None), (3, [0, 0])]
    assert sorted(((r.id, r.input_ids) for r in coded.collect()), key=str) == sorted(want, key=str)
    texts = decode(coded.select("id", F.col("input_ids").alias("labels")), "id", "labels", vocab)
    assert sorted(((r.id, r.text) for r in texts.collect()), key=str) == sorted(
        [(1, "a b d"), (1, "c"), (None, "d"), (2, None), (3, "")], key=str)


def test_padding(spark):
    frame = spark.createDataFrame([(0, 0, [3, 4, 2]), (1, 0, [3, 2]), (2, 1, [2])], "id int, batch int, input_ids array<int>")
    padded = {r.id: r.padded_ids for r in pad_batches(frame).collect()}
    assert padded == {0: [3, 4, 2], 1: [3, 2, 0], 2: [2]}


def labels_of(spark, prompt):
    frame = rows(spark, [prompt]).withColumn("input_ids", F.transform("tokens", lambda t, i: (i + 10).cast("int")))
    got = frame.select("tokens", completion_labels(F.col("prompt"), F.col("input_ids")).alias("labels")).first()
    return [t for t, x in zip(got.tokens, got.labels) if x != IGNORE], got.labels


def test_labels_single_turn(spark):
    kept, labels = labels_of(spark, "<s>[INST] q q [/INST]\na b </s>")
    assert kept == ["a", "b", "</s>"]
    assert labels[:5] == [IGNORE] * 5


def test_labels_many_turns(spark):
    kept, _ = labels_of(spark, "<s>[INST] q [/INST] a </s><s>[INST] r [/INST] b </s>")
    assert kept == ["a", "</s>", "<s>", "b", "</s>"]


def test_labels_without_marker(spark):
    kept, labels = labels_of(spark, "just text here")
    assert kept == [] and labels == [IGNORE] * 3
    assert labels_of(spark, "[/INST] [INST] q")[0] == []


def test_decode_skips_specials(spark, head):
    vocab = vocabulary(rows(spark, ["b a b c", "c c"]), "tokens")
    frame = spark.createDataFrame([(0, [IGNORE, 3, 0, 5, 2]), (1, [IGNORE])], "id int, labels array<int>")
    assert {r.id: r.text for r in decode(frame, "id", "labels", vocab).collect()} == {0: "c a", 1: ""}


def test_share_and_truncate(spark):
    frame = spark.createDataFrame([([IGNORE, 1, 2, IGNORE], "a b c", " ")], "l array<int>, t string, e string")
    got = frame.select(
        trained_share(F.col("l")).alias("s"), truncate(F.col("t"), 2).alias("t"), length_status(F.col("e")).alias("e")
    ).first()
    assert tuple(got) == (0.5, "a b", "too_short")
