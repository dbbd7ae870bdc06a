"""Text splitting, encoders, distances, semantic chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import BAGS, BUFFER, DISTANCES, SEMANTIC, SENTENCES, WINDOW_UNITS, WINDOWS, docs, sql_words
from corpusloom.functions.tables import register_tables
from corpusloom.functions.text import words
from corpusloom.operators import semantic
from corpusloom.operators.splitting import explode_chunks, nodes, sentence_units, window_units


@query("chunk_token_window", f"WITH {WINDOWS} SELECT doc_id, chunk_no, chunk, n_tokens FROM windows")
def chunk_token_window(spark: SparkSession, sf: str) -> DataFrame:
    chunks = explode_chunks(docs(spark, sf).select("doc_id", "text"), window_units(F.col("text")))
    return chunks.withColumn("n_tokens", F.size(words(F.col("chunk"))))


@query("sql_chunk_table", f"WITH {WINDOWS} SELECT doc_id, chunk_no, chunk, n_tokens FROM windows")
def sql_chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of whole documents, put together in SQL from one row a line."""
    register_tables(spark)
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return spark.sql("SELECT * FROM chunk_table(TABLE({lines}), 'doc_id', 'line_no', 'line')", lines=lines)


@query("chunk_node_ids", f"WITH {WINDOWS} SELECT w.doc_id, w.chunk_no, w.chunk AS text, 'pdf/' || d.source || '/' || w.doc_id::VARCHAR "
                         "AS file_name, sha256(w.doc_id::VARCHAR || '|' || w.chunk_no::VARCHAR) AS node_id "
                         "FROM windows w JOIN documents d USING (doc_id)")
def chunk_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(explode_chunks(docs(spark, sf).select("doc_id", "file_name", "text"), window_units(F.col("text"))))


@query("chunk_sentences", f"WITH {SENTENCES} SELECT doc_id, pos, unit FROM units")
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return explode_chunks(docs(spark, sf).select("doc_id", "text"), sentence_units(F.col("text")), "pos", "unit")


@query("chunk_buffer", f"WITH {SENTENCES}, {BUFFER} SELECT doc_id, pos, unit, context FROM buffered")
def chunk_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.unit_rows(docs(spark, sf))


@query("emb_bow", f"WITH {SENTENCES}, {BAGS} SELECT doc_id, pos, word, n FROM bags")
def emb_bow(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.word_counts(semantic.unit_rows(docs(spark, sf)))


def digit_encoder():
    """Small hashing encoder: 16 counts by the first hex digit of each word's MD5, taken once a batch for equal words."""
    import hashlib

    def encode(texts):
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        flat, rows = split.flatten(), pc.list_parent_indices(split)
        kept = pc.not_equal(flat, "")
        found = flat.filter(kept).dictionary_encode()
        digits = np.array([int(hashlib.md5(word.encode()).hexdigest()[0], 16) for word in found.dictionary.to_pylist()], np.int64)
        places = rows.filter(kept).to_numpy() * 16 + digits[found.indices.to_numpy()]
        return np.bincount(places, minlength=16 * len(texts)).reshape(-1, 16)

    return encode


@query("emb_batch", f"WITH {SENTENCES}, {BUFFER}, w AS (SELECT doc_id, pos, md5(unnest({sql_words('context')}))[1] AS h FROM buffered) "
                    "SELECT doc_id, pos, " + ", ".join(f"count(*) FILTER (h = '{h}') AS d{h}" for h in "0123456789abcdef")
                    + " FROM w GROUP BY doc_id, pos")
def emb_batch(spark: SparkSession, sf: str) -> DataFrame:
    contexts = semantic.unit_rows(docs(spark, sf)).select("doc_id", "pos", "context")
    coded = semantic.encode_batches(contexts, "context", digit_encoder)
    return coded.select("doc_id", "pos", *[
        F.get("embedding", F.lit(i)).cast("long").alias(f"d{h}") for i, h in enumerate("0123456789abcdef")
    ])


@query("chunk_distances", f"WITH {SENTENCES}, {DISTANCES} SELECT doc_id, pos, distance FROM dist")
def chunk_distances(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.distance_rows(docs(spark, sf).select("doc_id", "text"))


@query("chunk_semantic", f"WITH {SENTENCES}, {SEMANTIC} SELECT doc_id, chunk_no, chunk FROM chunks")
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return explode_chunks(semantic.semantic_chunks(docs(spark, sf).select("doc_id", "text")), "chunks")


@query("chunk_semantic_window", f"WITH {WINDOW_UNITS}, {SEMANTIC} SELECT doc_id, chunk_no, chunk FROM chunks")
def chunk_semantic_window(spark: SparkSession, sf: str) -> DataFrame:
    return explode_chunks(semantic.semantic_chunks(docs(spark, sf).select("doc_id", "text"), "window"), "chunks")


@query("chunk_semantic_bounded", f"WITH RECURSIVE {SENTENCES}, {SEMANTIC}, "
       f"sized AS (SELECT doc_id, chunk_no, chunk, len({sql_words('chunk')}) AS n FROM chunks), "
       "merged AS (SELECT doc_id, chunk_no, n, n AS grp_size, 0 AS grp FROM sized WHERE chunk_no = 0 UNION ALL "
       "SELECT s.doc_id, s.chunk_no, s.n, CASE WHEN s.n < 100 AND m.grp_size < 100 THEN m.grp_size + s.n ELSE s.n END, "
       "m.grp + CASE WHEN s.n < 100 AND m.grp_size < 100 THEN 0 ELSE 1 END "
       "FROM merged m JOIN sized s ON s.doc_id = m.doc_id AND s.chunk_no = m.chunk_no + 1), "
       f"groups AS (SELECT m.doc_id, m.grp, {sql_words(chr(39) + chr(39) + ' || string_agg(s.chunk, chr(32) ORDER BY s.chunk_no)')} AS t "
       "FROM merged m JOIN sized s USING (doc_id, chunk_no) GROUP BY ALL), "
       "cuts AS (SELECT doc_id, grp, t, unnest(range(0, greatest(0, ceil((len(t) - 256) / 256.0))::BIGINT + 1)) AS k FROM groups) "
       "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, k) - 1)::INT AS chunk_no, "
       "array_to_string(t[k * 256 + 1 : k * 256 + 256], ' ') AS chunk FROM cuts")
def chunk_semantic_bounded(spark: SparkSession, sf: str) -> DataFrame:
    chunked = semantic.semantic_chunks(docs(spark, sf).select("doc_id", "text"), bounded=True)
    return explode_chunks(chunked, "chunks")
