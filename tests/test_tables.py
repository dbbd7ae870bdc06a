import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import QUERIES
from corpusloom.functions.tables import blank_words, register_tables
from corpusloom.operators.splitting import explode_chunks, window_units
from corpusloom.operators.vocabulary import collate_batches, decode, encode, pad_batches, tokens_by, vocabulary
from tests.conftest import plan_of

SF = "/root/testdata/sf0.001"


def test_table_function_equals_the_columns(spark):
    got = QUERIES["sql_chunk_table"](spark, SF).drop("n_tokens")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = explode_chunks(docs, window_units(F.col("text")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def windows(tokens, size, overlap):
    out, at = [], 0
    while tokens and (at == 0 or at + overlap < len(tokens)):
        out.append(tokens[at:at + size])
        at += size - overlap
    return out


def test_pieces_in_any_order_nulls_and_a_tokenizer_of_the_callers(spark):
    register_tables(spark, "pair_table", tokenize=lambda t: [t[i:i + 2] for i in range(0, len(t), 2)], join="|".join)
    texts = {1: ["ab c", None, "de f g h"], 2: ["", "  "], 3: [None], 4: ["x" * 4_001, "y z"], None: ["n"]}
    rows = [(k, n, t, "other") for k, parts in texts.items() for n, t in enumerate(parts)]
    pieces = spark.createDataFrame(rows[::-1], "`a key` int, line_no int, body string, chunk string").repartition(5)
    for size, overlap in ((3, 1), (5, 0), (1, 0), (256, 20)):
        got = spark.sql(f"SELECT * FROM pair_table(TABLE({{pieces}}), 'a key', 'line_no', 'body', {size}, {overlap})", pieces=pieces)
        assert got.columns == ["a key", "chunk_no", "chunk", "n_tokens"]
        want = set()
        for k, parts in texts.items():
            tokens = [t[i:i + 2] for t in parts if t for i in range(0, len(t), 2)]
            want |= {(k, n, "|".join(w), len(w)) for n, w in enumerate(windows(tokens, size, overlap))}
        assert {tuple(r) for r in got.collect()} == want
    assert spark.sql("SELECT * FROM pair_table(TABLE({p}), 'a key', 'line_no', 'body')", p=pieces.limit(0)).count() == 0
    # The function names the columns it reads, so the others are not sent.
    assert "other" not in plan_of(got) and blank_words(" a\tb\n\nc ") == ["a", "b", "c"]


@pytest.mark.parametrize("arguments", ["'no', 'line_no', 'body'", "'doc_id', 'line_no', 'body', 5, 5"])
def test_wrong_arguments_are_named(spark, arguments):
    register_tables(spark)
    pieces = spark.createDataFrame([(1, 0, "a")], "doc_id int, line_no int, body string")
    with pytest.raises(Exception, match="no column no|smaller than the size"):
        spark.sql(f"SELECT * FROM chunk_table(TABLE({{pieces}}), {arguments})", pieces=pieces).collect()


def test_tokens_with_blanks_round_trip(spark):
    texts = [(1, "a b c d"), (2, "a b a b a"), (3, ""), (4, None)]
    pairs = lambda: lambda t: [t[i:i + 3] for i in range(0, len(t), 3)]
    rows = spark.createDataFrame(texts, "k int, body string").withColumn("tokens", tokens_by(F.col("body"), pairs))
    vocab = vocabulary(rows, "tokens")
    assert " " in "".join(r.token for r in vocab.collect())
    coded = encode(rows, "k", "tokens", vocab)
    assert {r.k: r.text for r in decode(coded, "k", "input_ids", vocab, glue="").collect()} == dict(texts)


def test_a_collator_of_the_callers(spark):
    rows = spark.createDataFrame([(k, k // 3, list(range(3, 3 + k % 4))) for k in range(20)], "k int, batch int, input_ids array<int>")

    def collate(part: pd.DataFrame) -> pd.DataFrame:
        longest = int(part["input_ids"].map(len).max())
        part["padded_len"], part["padded_ids"] = longest, [list(i) + [0] * (longest - len(i)) for i in part["input_ids"]]
        return part

    got = collate_batches(rows, collate, "k int, batch int, input_ids array<int>, padded_len int, padded_ids array<int>")
    want = pad_batches(rows)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
