"""Vocabulary, ids, padding, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import INSTRUCTION_ROWS, docs, instruction_rows, sql_words
from corpusloom.functions.prompts import train_prompt
from corpusloom.functions.text import words
from corpusloom.operators.sampling import length_batches
from corpusloom.operators.vocabulary import (
    IGNORE, completion_labels, decode, encode, length_status, pad_batches, prompt_tokens, trained_share, truncate, vocabulary,
)
from corpusloom.session import materialize

_VOCAB = (
    "vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 2)::INT AS token_id FROM "
    "(SELECT unnest(t) AS token, count(*) AS n FROM toks GROUP BY 1) WHERE token NOT IN ('<s>', '</s>'))"
)
_DOC_TOKENS = f"toks AS (SELECT doc_id, {sql_words('text')} AS t FROM documents)"
_CODED = (
    "flat AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks), "
    "coded AS (SELECT f.doc_id, f.pos, CASE f.token WHEN '<s>' THEN 1 WHEN '</s>' THEN 2 ELSE coalesce(v.token_id, 0) END AS id "
    "FROM flat f LEFT JOIN vocab v USING (token))"
)
_PROMPT_TOKENS = (
    f"{INSTRUCTION_ROWS}, prompts AS (SELECT doc_id, '<s>[INST] ' || instruction || chr(10) || input || ' [/INST]' || chr(10) "
    "|| output || ' </s>' AS prompt FROM rows), "
    "toks AS (SELECT doc_id, " + sql_words("regexp_replace(prompt, '(<s>|</s>|\\[INST\\]|\\[/INST\\])', ' \\1 ', 'g')") + " AS t FROM prompts)"
)


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", words(F.col("text")).alias("tokens"))


def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = instruction_rows(spark, sf)
    prompt = train_prompt(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select("doc_id", prompt.alias("prompt")).withColumn("tokens", prompt_tokens(F.col("prompt")))


@query("tok_vocab", f"WITH {_DOC_TOKENS}, {_VOCAB} SELECT token, n, token_id FROM vocab")
def tok_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(doc_tokens(spark, sf), "tokens")


@query("tok_encode", f"WITH {_PROMPT_TOKENS}, {_VOCAB}, {_CODED} SELECT doc_id, count(*)::INT AS n_tokens, "
                     "string_agg(id::VARCHAR, ' ' ORDER BY pos) AS input_ids FROM coded GROUP BY doc_id")
def tok_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompt_rows(spark, sf)
    coded = encode(rows, "doc_id", "tokens", vocabulary(rows, "tokens"))
    return coded.select(
        "doc_id", F.size("input_ids").alias("n_tokens"), F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids")
    )


@query("tok_pad_batch", f"WITH {_DOC_TOKENS}, {_VOCAB}, {_CODED}, "
       "ids AS (SELECT doc_id, list_append(list(id ORDER BY pos), 2) AS ids FROM coded GROUP BY doc_id), "
       "placed AS (SELECT doc_id, ids, len(ids) AS n, row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) - 1 AS position FROM ids), "
       "batched AS (SELECT *, position // 200 * 50 + (row_number() OVER (PARTITION BY position // 200 ORDER BY n DESC, position) - 1) // 4 AS batch FROM placed) "
       "SELECT doc_id, batch, n::INT AS n_tokens, (max(n) OVER (PARTITION BY batch))::INT AS padded_len, "
       "list_sum(ids)::BIGINT AS id_sum, (max(n) OVER (PARTITION BY batch) - n)::INT AS n_pad FROM batched")
def tok_pad_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = doc_tokens(spark, sf)
    # The ids feed the batch order and the padding; they are written once.
    coded = encode(rows, "doc_id", "tokens", vocabulary(rows, "tokens"), append_end=True)
    coded = materialize(coded.select("doc_id", "input_ids"), "ids")
    batches = length_batches(coded.select("doc_id", F.size("input_ids").alias("n_tokens")), "doc_id", "n_tokens")
    padded = pad_batches(coded.join(batches.select("doc_id", "batch"), "doc_id"))
    return padded.select(
        "doc_id", "batch", F.size("input_ids").alias("n_tokens"), F.size("padded_ids").alias("padded_len"),
        F.aggregate("padded_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.size(F.filter("padded_ids", lambda x: x == 0)).alias("n_pad"),
    )


_LABELS = (
    "ends AS MATERIALIZED (SELECT doc_id, list_position(t, '[/INST]') AS e FROM toks), "
    "labels_ AS (SELECT c.doc_id, c.pos, CASE WHEN c.pos <= e.e THEN -100 ELSE c.id END AS label FROM coded c JOIN ends e USING (doc_id))"
)


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = prompt_rows(spark, sf)
    vocab = vocabulary(rows, "tokens")
    coded = encode(rows, "doc_id", "tokens", vocab)
    return coded.withColumn("labels", completion_labels(F.col("prompt"), F.col("input_ids"))), vocab


@query("tok_labels", f"WITH {_PROMPT_TOKENS}, {_VOCAB}, {_CODED}, {_LABELS} SELECT doc_id, "
                     "string_agg(label::VARCHAR, ' ' ORDER BY pos) AS labels FROM labels_ GROUP BY doc_id")
def tok_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = labelled(spark, sf)
    return rows.select("doc_id", F.array_join(F.col("labels").cast("array<string>"), " ").alias("labels"))


@query("tok_label_stats", f"WITH {_PROMPT_TOKENS}, {_VOCAB}, {_CODED}, {_LABELS} SELECT doc_id, count(*)::INT AS n_tokens, "
                          "(count(*) FILTER (label <> -100))::INT AS n_trained, "
                          "round((count(*) FILTER (label <> -100)) / count(*), 9) AS trained_share FROM labels_ GROUP BY doc_id")
def tok_label_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = labelled(spark, sf)
    labels = F.col("labels")
    return rows.select(
        "doc_id", F.size(labels).alias("n_tokens"),
        F.size(F.filter(labels, lambda x: x != IGNORE)).alias("n_trained"),
        F.round(trained_share(labels), 9).alias("trained_share"),
    )


@query("tok_decode", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, array_to_string({sql_words('output')}, ' ') AS text FROM rows")
def tok_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows, vocab = labelled(spark, sf)
    # The labels are read twice (rare ids, then rows).
    return decode(materialize(rows.select("doc_id", "labels"), "labels"), "doc_id", "labels", vocab).select("doc_id", "text")


@query("tok_truncate", f"SELECT doc_id, 'text' AS source_column, 'ok' AS status, len({sql_words('text')}[1:1000])::INT AS n_tokens, "
                       f"array_to_string({sql_words('text')}[1:1000], ' ') AS text FROM documents "
                       "UNION ALL SELECT doc_id, 'blank', 'too_short', 0, '' FROM documents")
def tok_truncate(spark: SparkSession, sf: str) -> DataFrame:
    generated = docs(spark, sf).select("doc_id", F.explode(F.array(
        F.struct(F.lit("text").alias("source_column"), F.col("text").alias("t")),
        F.struct(F.lit("blank").alias("source_column"), F.lit(" \n").alias("t")),
    )).alias("g")).select("doc_id", "g.source_column", F.col("g.t").alias("raw"))
    cut = generated.select("doc_id", "source_column", length_status(F.col("raw")).alias("status"), truncate(F.col("raw")).alias("text"))
    return cut.withColumn("n_tokens", F.size(words(F.col("text"))))
