"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.prompts import TASK_TEMPLATES
from corpusloom.functions.text import words
from corpusloom.operators.instructions import assign_template, requests
from corpusloom.plans.parallelism import spread
from corpusloom.sources import documents as src

SHARD_BYTES = 100_000
SEED = 3
MODEL = "base-model"
#: An arbitrary system message of more than one line.
SYSTEM_TEXT = "Reply in plain words.\nName the part of the text that you rely on."


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(src.documents(spark, sf))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return src.manifest(spark, sf)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "conversations")


def instruction_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One instruction row per document; output = first 20 words of the request."""
    rows = requests(assign_template(docs(spark, sf).select("doc_id", "text"), F.col("doc_id")))
    return rows.withColumn("output", F.array_join(F.slice(words(F.col("request")), 1, 20), " "))


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_text(value: str) -> str:
    """SQL literal; newlines are written as chr(10)."""
    quoted = value.replace("'", "''")
    return "(" + " || chr(10) || ".join(f"'{line}'" for line in quoted.split("\n")) + ")"


def sql_choice(key: str, n: int, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT % {n})::INT"


DOCS = (
    "docs AS (SELECT doc_id, 'pdf/' || source || '/' || doc_id::VARCHAR AS file_name, source AS folder, "
    "regexp_extract(source, '(\\d+)$', 1)::INT AS folder_ord, text, strlen(text)::BIGINT AS bytes FROM documents)"
)

TEMPLATES = "templates(template_id, task, instruction, placeholder) AS (VALUES " + ", ".join(
    f"({i}, {sql_text(task)}, {sql_text(instruction)}, {sql_text(out)})" for i, task, instruction, out in TASK_TEMPLATES
) + ")"

#: doc_id, template_id, task, instruction, input, request, output
INSTRUCTION_ROWS = (
    f"{TEMPLATES}, ins AS (SELECT d.doc_id, t.template_id, t.task, t.instruction, d.text AS input, "
    "t.instruction || ' ' || d.text AS request FROM documents d JOIN templates t "
    f"ON t.template_id = {sql_choice('d.doc_id', len(TASK_TEMPLATES))}), "
    f"rows AS (SELECT *, array_to_string({sql_words('request')}[1:20], ' ') AS output FROM ins)"
)

#: doc_id, chunk_no, chunk: 256-token windows with 20 tokens of overlap
WINDOWS = (
    f"tok AS (SELECT doc_id, {sql_words('text')} AS t FROM documents), "
    "starts AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((len(t) - 256) / 236.0))::BIGINT + 1)) AS k FROM tok), "
    "windows AS (SELECT doc_id, k::INT AS chunk_no, array_to_string(t[k * 236 + 1 : k * 236 + 256], ' ') AS chunk, "
    "len(t[k * 236 + 1 : k * 236 + 256])::INT AS n_tokens FROM starts WHERE len(t[k * 236 + 1 : k * 236 + 256]) > 0)"
)

#: doc_id, pos, unit
SENTENCES = (
    "pieces AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', "
    f"'\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '') AS u FROM documents), "
    "units AS (SELECT doc_id, generate_subscripts(u, 1)::INT - 1 AS pos, unnest(u) AS unit FROM pieces)"
)

WINDOW_UNITS = f"{WINDOWS}, units AS (SELECT doc_id, chunk_no AS pos, chunk AS unit FROM windows)"

#: from units: buffered context, word counts, distances, chunk numbers
BUFFER = (
    "buffered AS (SELECT doc_id, pos, unit, concat_ws(' ', lag(unit) OVER w, unit, lead(unit) OVER w) AS context "
    "FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
)
BAGS = (
    f"{BUFFER}, bags AS (SELECT doc_id, pos, word, count(*) AS n FROM (SELECT doc_id, pos, "
    "unnest(regexp_extract_all(lower(context), '[\\p{L}\\p{N}_]+')) AS word FROM buffered) GROUP BY ALL), "
    "norms AS (SELECT doc_id, pos, sum(n * n)::DOUBLE AS nn FROM bags GROUP BY ALL)"
)
DISTANCES = (
    f"{BAGS}, dots AS (SELECT a.doc_id, a.pos, sum(a.n * b.n)::DOUBLE AS dot FROM bags a JOIN bags b "
    "ON a.doc_id = b.doc_id AND a.word = b.word AND b.pos = a.pos + 1 GROUP BY ALL), "
    "dist AS (SELECT u.doc_id, u.pos - 1 AS pos, round(1 - coalesce(d.dot / nullif(sqrt(x.nn * y.nn), 0), 0), 9) AS distance "
    "FROM buffered u LEFT JOIN norms x ON x.doc_id = u.doc_id AND x.pos = u.pos - 1 "
    "LEFT JOIN norms y ON y.doc_id = u.doc_id AND y.pos = u.pos "
    "LEFT JOIN dots d ON d.doc_id = u.doc_id AND d.pos = u.pos - 1 WHERE u.pos > 0)"
)
SEMANTIC = (
    f"{DISTANCES}, lim AS (SELECT doc_id, round(quantile_cont(distance, 0.9), 9) AS q FROM dist GROUP BY doc_id), "
    "brk AS (SELECT d.doc_id, d.pos + 1 AS pos FROM dist d JOIN lim USING (doc_id) WHERE d.distance > q), "
    "numbered AS (SELECT u.doc_id, u.pos, u.unit, (sum(CASE WHEN b.pos IS NULL THEN 0 ELSE 1 END) OVER "
    "(PARTITION BY u.doc_id ORDER BY u.pos))::INT AS chunk_no FROM units u "
    "LEFT JOIN brk b ON b.doc_id = u.doc_id AND b.pos = u.pos), "
    "chunks AS (SELECT doc_id, chunk_no, string_agg(unit, ' ' ORDER BY pos) AS chunk FROM numbered GROUP BY ALL)"
)

#: per-folder greedy packing; needs f(scope, rn, path, bytes)
def sql_pack(files: str, limit: int) -> str:
    return (
        f"f AS ({files}), packed AS (SELECT scope, rn, path, bytes, bytes AS cur, 0 AS shard FROM f WHERE rn = 1 "
        "UNION ALL SELECT f.scope, f.rn, f.path, f.bytes, "
        f"CASE WHEN p.cur > 0 AND p.cur + f.bytes > {limit} THEN f.bytes ELSE p.cur + f.bytes END, "
        f"p.shard + CASE WHEN p.cur > 0 AND p.cur + f.bytes > {limit} THEN 1 ELSE 0 END "
        "FROM packed p JOIN f ON f.scope = p.scope AND f.rn = p.rn + 1)"
    )


FOLDER_FILES = (
    "SELECT folder AS scope, folder_ord, row_number() OVER (PARTITION BY folder ORDER BY file_name) AS rn, "
    "file_name AS path, bytes FROM docs"
)
#: path, shard: one number sequence over the folders
PACKED_DOCS = (
    f"{DOCS}, {sql_pack(FOLDER_FILES, SHARD_BYTES)}, "
    "bases AS (SELECT scope, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base "
    "FROM (SELECT p.scope, max(p.shard) + 1 AS n, min(f.folder_ord) AS o FROM packed p JOIN f USING (path) GROUP BY p.scope)), "
    "numbered_files AS (SELECT p.scope AS folder, p.path, p.bytes, (p.shard + base)::INT AS shard FROM packed p JOIN bases USING (scope))"
)
