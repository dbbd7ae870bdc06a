"""Templates, prompts, response clean-up, splits and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import (
    INSTRUCTION_ROWS, SEED, SYSTEM_TEXT, TEMPLATES, WINDOWS, docs, instruction_rows, sql_choice, sql_strip, sql_text, sql_words,
)
from corpusloom.functions import prompts
from corpusloom.functions.text import cut_at_stop, extract_response, response_status, strip, words
from corpusloom.operators.instructions import all_templates, assign_template, requests
from corpusloom.operators.sampling import length_batches, shuffled, with_split
from corpusloom.operators.splitting import explode_chunks, window_units
from corpusloom.operators.vocabulary import prompt_tokens
from corpusloom.session import materialize

SYSTEM = sql_text(SYSTEM_TEXT)


@query("ins_templates", f"WITH {TEMPLATES} SELECT d.doc_id, t.template_id, t.task, t.instruction, d.text AS input, "
                        "t.placeholder AS output FROM documents d, templates t")
def ins_templates(spark: SparkSession, sf: str) -> DataFrame:
    return all_templates(docs(spark, sf).select("doc_id", "text"))


def window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = explode_chunks(docs(spark, sf).select("doc_id", "text"), window_units(F.col("text")))
    return chunks.select("doc_id", "chunk_no", F.col("chunk").alias("text"))


_CHUNK_KEY = "(w.doc_id::VARCHAR || '/' || w.chunk_no::VARCHAR)"


@query("ins_assign_template", f"WITH {TEMPLATES}, {WINDOWS} SELECT w.doc_id, w.chunk_no, t.template_id, t.task, t.instruction, "
                              "w.chunk AS input, t.placeholder AS output FROM windows w JOIN templates t "
                              f"ON t.template_id = {sql_choice(_CHUNK_KEY, 3)}")
def ins_assign_template(spark: SparkSession, sf: str) -> DataFrame:
    return assign_template(window_chunks(spark, sf), F.concat_ws("/", "doc_id", "chunk_no"))


@query("ins_request", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, template_id, request FROM rows")
def ins_request(spark: SparkSession, sf: str) -> DataFrame:
    rows = assign_template(docs(spark, sf).select("doc_id", "text"), F.col("doc_id"))
    return requests(rows).select("doc_id", "template_id", "request")


def _prompt_query(name: str, sql: str, build) -> None:
    @query(name, f"WITH {INSTRUCTION_ROWS} SELECT doc_id, {sql} AS prompt FROM rows")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = instruction_rows(spark, sf)
        return rows.select("doc_id", build(F.col("instruction"), F.col("input"), F.col("output")).alias("prompt"))


_PAD = "chr(10) || '    '"
_prompt_query("prm_train_plain", "'<s>[INST] ' || instruction || chr(10) || input || ' [/INST]' || chr(10) || output || ' </s>'",
              lambda i, x, o: prompts.train_prompt(i, x, o))
_prompt_query("prm_test_plain", "'<s>[INST] ' || instruction || chr(10) || input || ' [/INST]'",
              lambda i, x, o: prompts.test_prompt(i, x))
_prompt_query("prm_train_sys", f"'<s>[INST]<<SYS>> ' || {SYSTEM} || ' <</SYS>>' || {_PAD} || instruction || {_PAD} || input || "
                               f"' [/INST]' || {_PAD} || output || ' </s>'",
              lambda i, x, o: prompts.train_prompt(i, x, o, SYSTEM_TEXT))
_prompt_query("prm_test_sys", f"'<s>[INST]<<SYS>> ' || {SYSTEM} || ' <</SYS>>' || {_PAD} || instruction || {_PAD} || input || ' [/INST]'",
              lambda i, x, o: prompts.test_prompt(i, x, SYSTEM_TEXT))
_prompt_query("prm_completion", "chr(10) || '  <s>[INST] ' || instruction || chr(10) || '  ' || input || ' [/INST]' || chr(10) || '  '",
              lambda i, x, o: prompts.completion_prompt(i, x))


@query("txt_strip", f"SELECT doc_id, {sql_strip('chr(10) || chr(9) || text || chr(32) || chr(10)')} AS text FROM documents")
def txt_strip(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\n\t"), F.col("text"), F.lit(" \n"))
    return docs(spark, sf).select("doc_id", strip(padded).alias("text"))


@query("txt_extract_response", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, 'decoded' AS kind, 'ok' AS status, "
                               f"{sql_strip('output')} AS response FROM rows "
                               "UNION ALL SELECT doc_id, 'bare', 'no_marker', NULL FROM rows")
def txt_extract_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = instruction_rows(spark, sf)
    whole = prompts.train_prompt(F.col("instruction"), F.col("input"), F.col("output"))
    decoded = rows.select("doc_id", F.explode(F.array(
        F.struct(F.lit("decoded").alias("kind"), whole.alias("text")),
        F.struct(F.lit("bare").alias("kind"), F.col("output").alias("text")),
    )).alias("d")).select("doc_id", "d.kind", "d.text")
    return decoded.select(
        "doc_id", "kind", response_status(F.col("text")).alias("status"), extract_response(F.col("text")).alias("response")
    )


@query("txt_apply_stop", "SELECT doc_id, text || ' ' AS text FROM documents")
def txt_apply_stop(spark: SparkSession, sf: str) -> DataFrame:
    generated = F.concat(F.col("text"), F.lit(" </s> and [/INST] more"))
    return docs(spark, sf).select("doc_id", cut_at_stop(generated).alias("text"))


# -- split, shuffle, batches ------------------------------------------------

_SPLIT = (
    "ranked AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents), "
    "split AS (SELECT doc_id, text, r - 1 AS position, CASE WHEN r <= ceil(round(n * 0.05, 9)) THEN 'test' ELSE 'train' END AS split FROM ranked)"
)


@query("split_train_test", f"WITH {_SPLIT} SELECT doc_id, split FROM split")
def split_train_test(spark: SparkSession, sf: str) -> DataFrame:
    return with_split(docs(spark, sf), "doc_id").select("doc_id", "split")


@query("agg_split_shape", f"WITH {_SPLIT} SELECT split, count(*) AS n_rows, sum(len({sql_words('text')}))::BIGINT AS n_tokens FROM split GROUP BY split")
def agg_split_shape(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_split(docs(spark, sf), "doc_id")
    return rows.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum(F.size(words(F.col("text")))).cast("long").alias("n_tokens")
    )


@query("split_shuffle", f"WITH {_SPLIT} SELECT doc_id, position FROM split")
def split_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled(docs(spark, sf).select("doc_id"), "doc_id")


@query("batch_by_length", f"WITH {_SPLIT}, sized AS (SELECT doc_id, position, len({sql_words('text')})::INT AS n_tokens, "
                          "position // 200 AS mega FROM split) SELECT doc_id, n_tokens, position, mega, "
                          "mega * 50 + (row_number() OVER (PARTITION BY mega ORDER BY n_tokens DESC, position) - 1) // 4 AS batch FROM sized")
def batch_by_length(spark: SparkSession, sf: str) -> DataFrame:
    sized = docs(spark, sf).select("doc_id", F.size(words(F.col("text"))).alias("n_tokens"))
    return length_batches(sized, "doc_id", "n_tokens", SEED)


# -- flagship ---------------------------------------------------------------


@query("corpus_split_summary", f"WITH {TEMPLATES}, {WINDOWS}, keyed AS (SELECT w.*, {_CHUNK_KEY} AS k FROM windows w), "
       "ranked AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || k), k) AS r, count(*) OVER () AS n FROM keyed), "
       f"rows AS (SELECT k, r, n, t.task, '<s>[INST] ' || t.instruction || chr(10) || chunk || ' [/INST]' || chr(10) || "
       f"array_to_string({sql_words('chunk')}[1:20], ' ') || ' </s>' AS prompt FROM ranked JOIN templates t "
       f"ON t.template_id = {sql_choice('k', 3)}) "
       "SELECT CASE WHEN r <= ceil(round(n * 0.05, 9)) THEN 'test' ELSE 'train' END AS split, task, count(*) AS n_rows, "
       "sum(len(" + sql_words("regexp_replace(prompt, '(<s>|</s>|\\[INST\\]|\\[/INST\\])', ' \\1 ', 'g')") + "))::BIGINT AS n_tokens FROM rows GROUP BY ALL")
def corpus_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    # The split looks at the keys several times; chunks are written once and only keys re-read.
    chunks = window_chunks(spark, sf).withColumn("k", F.concat_ws("/", "doc_id", "chunk_no"))
    chunks = materialize(chunks, "chunks")
    rows = with_split(assign_template(chunks, F.col("k")), "k")
    output = F.array_join(F.slice(words(F.col("input")), 1, 20), " ")
    prompt = prompts.train_prompt(F.col("instruction"), F.col("input"), output)
    return rows.groupBy("split", "task").agg(
        F.count("*").alias("n_rows"), F.sum(F.size(prompt_tokens(prompt))).cast("long").alias("n_tokens")
    )
