from pyspark.sql import functions as F

from corpusloom.functions import prompts
from corpusloom.functions.hashing import choice
from corpusloom.functions.payloads import all_choices, first_chat_choice, first_text_choice
from corpusloom.functions.text import (
    COMPLETION_STOPS, clean_utf8, cut_at_stop, extract_response, response_status, strip, words,
)


def value(spark, column, **cells):
    frame = spark.createDataFrame([tuple(cells.values())], list(cells))
    return frame.select(column.alias("v")).first().v


def test_clean_drops_bad_bytes_only(spark):
    raw = F.unhex(F.lit("61ff62eda080c3a9")).cast("string")
    assert value(spark, clean_utf8(raw), x=1) == "abé"
    assert value(spark, F.octet_length(clean_utf8(raw)), x=1) == 4


def test_clean_keeps_genuine_replacement_character(spark):
    assert value(spark, clean_utf8(F.lit("a�b")), x=1) == "a�b"
    mixed = F.concat(F.lit("a�\u001a1").cast("binary"), F.unhex(F.lit("ff")), F.lit("z").cast("binary")).cast("string")
    assert value(spark, clean_utf8(mixed), x=1) == "a�\u001a1z"


def test_strip_is_unicode_aware(spark):
    assert value(spark, strip(F.col("x")), x=" \t a b  \n") == "a b"


def test_words_skip_empty(spark):
    assert value(spark, words(F.col("x")), x="  a\n b ") == ["a", "b"]
    assert value(spark, words(F.col("x")), x="   ") == []


def test_extract_response(spark):
    assert value(spark, extract_response(F.col("x")), x="a [INST] b [/INST] c </s>") == "c"
    many = "[INST] a [/INST] b </s>[INST] c [/INST]  d </s> </s>"
    assert value(spark, extract_response(F.col("x")), x=many) == "d"
    assert value(spark, extract_response(F.col("x")), x="no marker") is None
    assert value(spark, response_status(F.col("x")), x="[/INST] a [INST] b") == "no_marker"


def test_stops(spark):
    assert value(spark, cut_at_stop(F.col("x")), x="a [/INST] b </s>") == "a "
    assert value(spark, cut_at_stop(F.col("x"), COMPLETION_STOPS), x="a [/INST] b </s> c") == "a [/INST] b "
    assert value(spark, cut_at_stop(F.col("x")), x="plain") == "plain"


def test_prompt_shapes(spark):
    i, x, o = F.lit("I"), F.lit("X"), F.lit("O")
    assert value(spark, prompts.train_prompt(i, x, o), a=1) == "<s>[INST] I\nX [/INST]\nO </s>"
    assert value(spark, prompts.test_prompt(i, x), a=1) == "<s>[INST] I\nX [/INST]"
    assert value(spark, prompts.train_prompt(i, x, o, "S"), a=1) == "<s>[INST]<<SYS>> S <</SYS>>\n    I\n    X [/INST]\n    O </s>"
    assert value(spark, prompts.test_prompt(i, x, "S"), a=1) == "<s>[INST]<<SYS>> S <</SYS>>\n    I\n    X [/INST]"
    assert value(spark, prompts.completion_prompt(i, x), a=1) == "\n  <s>[INST] I\n  X [/INST]\n  "


def test_prompt_fields_may_contain_braces(spark):
    assert value(spark, prompts.test_prompt(F.lit("{input}"), F.lit("{x}")), a=1) == "<s>[INST] {input}\n{x} [/INST]"


def test_choice_is_uniform_and_stable(spark):
    picked = spark.range(3000).select(choice(3, F.col("id"), 3).alias("c"))
    counts = {r.c: r["count"] for r in picked.groupBy("c").count().collect()}
    assert set(counts) == {0, 1, 2} and min(counts.values()) > 900
    again = spark.range(3000).repartition(7).select(choice(3, F.col("id"), 3).alias("c"))
    assert {r.c: r["count"] for r in again.groupBy("c").count().collect()} == counts


def test_responses(spark):
    chat = '{"choices":[{"message":{"role":"assistant","content":"a"}},{"message":{"content":"b"}}]}'
    assert value(spark, first_chat_choice(F.col("x")), x=chat) == "a"
    assert value(spark, all_choices(F.col("x")), x=chat) == ["a", "b"]
    assert value(spark, first_text_choice(F.col("x")), x='{"choices":[{"text":"t"}]}') == "t"
    assert value(spark, first_chat_choice(F.col("x")), x="not json") is None
