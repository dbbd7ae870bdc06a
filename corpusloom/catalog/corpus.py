"""Listing, admission, packing, sinks, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.catalog import query
from corpusloom.catalog.base import (
    DOCS, FOLDER_FILES, INSTRUCTION_ROWS, PACKED_DOCS, SEMANTIC, SHARD_BYTES, WINDOW_UNITS, WINDOWS, docs,
    instruction_rows, manifest, sql_pack,
)
from corpusloom.functions.text import clean_utf8, utf8_bytes
from corpusloom.operators.admission import admit, assign_batches, first_n, limit_per_folder, row_with
from corpusloom.operators.packing import global_numbers, pack, packing_summary
from corpusloom.operators.splitting import explode_chunks, window_units
from corpusloom.plans.corpus_build import BuildOptions, build_corpus, prepare, publish as publish_run, run_summary
from corpusloom.session import scratch_path
from corpusloom.sources import documents as src
from corpusloom.sources.jsonl import parsed, read_jsonl, write_jsonl
from corpusloom.sources.ledger import merge, unprocessed
from corpusloom.sources.documents import read_text_files
from corpusloom.sources.listing import folder_inventory, list_files, list_prefix
from corpusloom.sources.pages import last_page, list_pages, read_pages, write_text_files
from corpusloom.sources.releases import adopt, entries, history, read_release
from corpusloom.sources.shards import read_dataset, read_shard, split_encodable, write_shards

# String prefixes that together cover every folder, in argument order.
FOLDER_ARGS = ["src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9", "src0"]


@query("src_list_prefix", "WITH " + DOCS + " SELECT file_name AS path, folder, bytes, (CASE " + " ".join(
    f"WHEN starts_with(file_name, 'pdf/{name}') THEN {i}" for i, name in enumerate(FOLDER_ARGS)
) + " END)::INT AS folder_ord FROM docs")
def src_list_prefix(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest(spark, sf).select("path", "folder", "bytes")
    return list_prefix(files, "pdf", FOLDER_ARGS)


@query("src_folder_inventory", f"WITH {DOCS} SELECT folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM docs GROUP BY folder")
def src_folder_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return folder_inventory(manifest(spark, sf))


@query("src_documents", f"WITH {DOCS} SELECT doc_id, file_name, folder, folder_ord, text, bytes FROM docs")
def src_documents(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).withColumn("bytes", utf8_bytes(F.col("text")))


@query("src_prompt_matrix", "SELECT doc_id AS conversation, (generate_subscripts(l, 1) - 1)::INT AS turn, unnest(l) AS text "
                            "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def src_prompt_matrix(spark: SparkSession, sf: str) -> DataFrame:
    lists = docs(spark, sf).select("doc_id", F.split("text", "\n").alias("prompts"))
    return src.prompt_matrix(lists, "doc_id", "prompts")


@query("lim_first_n", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def lim_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return first_n(src.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100)


@query("lim_row_with", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 9")
def lim_row_with(spark: SparkSession, sf: str) -> DataFrame:
    """The tenth row, looked up by key."""
    return row_with(src.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", 9)


@query("lim_per_folder", f"WITH {DOCS} SELECT file_name AS path, folder, bytes FROM docs "
                         "QUALIFY row_number() OVER (PARTITION BY folder ORDER BY file_name) <= 20")
def lim_per_folder(spark: SparkSession, sf: str) -> DataFrame:
    return limit_per_folder(manifest(spark, sf).select("path", "folder", "bytes"), 20)


@query("lim_total", f"WITH {DOCS}, first_files AS (SELECT file_name AS path, folder, folder_ord, bytes FROM docs "
                    "QUALIFY row_number() OVER (PARTITION BY folder ORDER BY file_name) <= 20) "
                    "SELECT * FROM first_files ORDER BY folder_ord, path LIMIT 250")
def lim_total(spark: SparkSession, sf: str) -> DataFrame:
    return admit(manifest(spark, sf).drop("doc_id"), per_folder=20, total=250)


@query("batch_assign", f"WITH {DOCS} SELECT file_name AS path, folder, bytes, "
                       "((row_number() OVER (ORDER BY folder_ord, file_name) - 1) // 64)::INT AS batch FROM docs")
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assign_batches(manifest(spark, sf).drop("doc_id"), 64).drop("folder_ord")


@query("shard_greedy", f"WITH RECURSIVE {DOCS}, {sql_pack(FOLDER_FILES, SHARD_BYTES)} "
                       "SELECT scope AS folder, path, bytes, shard::INT AS shard FROM packed")
def shard_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return pack(manifest(spark, sf).select("folder", "path", "bytes"), SHARD_BYTES)


#: A shard spans several of these small blocks of the listing.
LARGE_SHARD_BYTES = 40_000
SMALL_BLOCK = 5


@query("shard_greedy_large_limit", f"WITH RECURSIVE {DOCS}, {sql_pack(FOLDER_FILES, LARGE_SHARD_BYTES)} "
                                   "SELECT scope AS folder, path, bytes, shard::INT AS shard FROM packed")
def shard_greedy_large_limit(spark: SparkSession, sf: str) -> DataFrame:
    return pack(manifest(spark, sf).select("folder", "path", "bytes"), LARGE_SHARD_BYTES, block_rows=SMALL_BLOCK)


@query("shard_greedy_global", f"WITH RECURSIVE {DOCS}, " + sql_pack(
    "SELECT '' AS scope, row_number() OVER (ORDER BY folder_ord, file_name) AS rn, file_name AS path, bytes FROM docs", SHARD_BYTES
) + " SELECT path, bytes, shard::INT AS shard FROM packed")
def shard_greedy_global(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest(spark, sf).select("folder_ord", "path", "bytes")
    return pack(files, SHARD_BYTES, scope=None, order=("folder_ord", "path")).drop("folder_ord")


@query("shard_summary", f"WITH RECURSIVE {DOCS}, {sql_pack(FOLDER_FILES, SHARD_BYTES)} "
                        "SELECT scope AS folder, shard::INT AS shard, count(*) AS files, sum(bytes)::BIGINT AS bytes "
                        "FROM packed GROUP BY ALL")
def shard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing_summary(shard_greedy(spark, sf), "folder")


def publish(spark: SparkSession, sf: str, base: int) -> str:
    """Documents packed by folder and written as numbered shards."""
    files = manifest(spark, sf).select("folder", "folder_ord", "path", "bytes")
    packed = global_numbers(pack(files, SHARD_BYTES), "folder", "folder_ord").select("path", "shard")
    rows = src.documents(spark, sf).withColumnRenamed("file_name", "path").join(packed, "path")
    out = scratch_path(spark, "published")
    write_shards(rows.select("doc_id", F.col("path").alias("file_name"), "text", "shard"), out, base=base)
    return out


@query("sink_sharded", f"WITH RECURSIVE {PACKED_DOCS} SELECT (shard + 4)::INT AS shard, count(*) AS files, "
                       "sum(bytes)::BIGINT AS bytes FROM numbered_files GROUP BY shard")
def sink_sharded(spark: SparkSession, sf: str) -> DataFrame:
    return read_dataset(spark, publish(spark, sf, base=4)).groupBy("shard").agg(
        F.count("*").alias("files"), F.sum(utf8_bytes(F.col("text"))).cast("long").alias("bytes")
    )


@query("src_shard_read", f"WITH RECURSIVE {PACKED_DOCS} SELECT d.doc_id, d.file_name, d.text, (n.shard + 4)::INT AS shard "
                         "FROM numbered_files n JOIN docs d ON d.file_name = n.path WHERE n.shard + 4 = 5")
def src_shard_read(spark: SparkSession, sf: str) -> DataFrame:
    return read_shard(spark, publish(spark, sf, base=4), 5)


@query("src_dataset_read", f"WITH RECURSIVE {PACKED_DOCS} SELECT d.doc_id, d.file_name, d.bytes, n.shard "
                           "FROM numbered_files n JOIN docs d ON d.file_name = n.path")
def src_dataset_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_dataset(spark, publish(spark, sf, base=0))
    return rows.select("doc_id", "file_name", utf8_bytes(F.col("text")).alias("bytes"), "shard")


_ROW = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])


@query("src_jsonl_roundtrip", f"WITH {INSTRUCTION_ROWS} SELECT doc_id, instruction, input, output FROM rows")
def src_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    write_jsonl(instruction_rows(spark, sf).select(*_ROW.names), path)
    return parsed(read_jsonl(spark, path, _ROW))


@query("sink_instructions", f"WITH {INSTRUCTION_ROWS} SELECT instruction, count(*) AS n_rows, sum(strlen(input))::BIGINT AS "
                            "input_bytes, sum(strlen(output))::BIGINT AS output_bytes FROM rows GROUP BY instruction")
def sink_instructions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "instructions")
    instruction_rows(spark, sf).select("instruction", "input", "output").write.parquet(path)
    return read_dataset(spark, path).groupBy("instruction").agg(
        F.count("*").alias("n_rows"),
        F.sum(utf8_bytes(F.col("input"))).alias("input_bytes"),
        F.sum(utf8_bytes(F.col("output"))).alias("output_bytes"),
    )


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents; those labelled toxic get two bytes that are not UTF-8."""
    toxic = src.table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad"))
    rows = docs(spark, sf).select("doc_id", "text").join(toxic, "doc_id", "left")
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFC3"))).cast("string")
    return rows.select("doc_id", F.when(F.col("bad"), broken).otherwise(F.col("text")).alias("text"))


@query("sink_quarantine", "WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT d.doc_id, "
                          "CASE WHEN b.doc_id IS NULL THEN 'clean' ELSE 'quarantine' END AS sink, "
                          "(strlen(d.text) + CASE WHEN b.doc_id IS NULL THEN 0 ELSE 2 END)::BIGINT AS bytes, "
                          "CASE WHEN b.doc_id IS NOT NULL THEN 'not valid UTF-8' END AS error "
                          "FROM documents d LEFT JOIN bad b USING (doc_id)")
def sink_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    clean, bad = split_encodable(damaged(spark, sf), "text")
    good_path, bad_path = scratch_path(spark, "clean"), scratch_path(spark, "quarantine")
    clean.write.parquet(good_path)
    bad.write.parquet(bad_path)
    kept = spark.read.parquet(good_path).select(
        "doc_id", F.lit("clean").alias("sink"), utf8_bytes(F.col("text")).alias("bytes"), F.lit(None).cast("string").alias("error")
    )
    aside = spark.read.parquet(bad_path).select(
        "doc_id", F.lit("quarantine").alias("sink"), F.octet_length("raw").cast("long").alias("bytes"), "error"
    )
    return kept.unionByName(aside)


@query("txt_clean_utf8", "SELECT doc_id, (strlen(text) + 3)::BIGINT AS raw_bytes, (strlen(text) + 1)::BIGINT AS bytes, "
                         "text || 'b' AS text FROM documents")
def txt_clean_utf8(spark: SparkSession, sf: str) -> DataFrame:
    raw = docs(spark, sf).select("doc_id", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF62C3"))).cast("string").alias("raw"))
    cleaned = raw.select("doc_id", utf8_bytes(F.col("raw")).alias("raw_bytes"), clean_utf8(F.col("raw")).alias("text"))
    return cleaned.withColumn("bytes", utf8_bytes(F.col("text")))


@query("agg_file_bytes", f"WITH {WINDOWS} SELECT doc_id, count(*) AS chunks, sum(strlen(chunk))::BIGINT AS bytes FROM windows GROUP BY doc_id")
def agg_file_bytes(spark: SparkSession, sf: str) -> DataFrame:
    chunks = explode_chunks(docs(spark, sf).select("doc_id", "text"), window_units(F.col("text")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(utf8_bytes(F.col("chunk"))).alias("bytes"))


# -- resume -----------------------------------------------------------------


def labelled_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger of an earlier run that finished the labelled documents."""
    seen = src.table(spark, sf, "labels").select("doc_id").distinct()
    return manifest(spark, sf).join(seen, "doc_id", "left_semi").select(
        "path", F.lit(0).alias("shard"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")
    )


_SEEN = "seen AS (SELECT d.* FROM docs d WHERE d.doc_id IN (SELECT doc_id FROM labels))"


@query("ckpt_anti_join", f"WITH {DOCS} SELECT file_name AS path, folder, bytes FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ckpt_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return unprocessed(manifest(spark, sf).select("path", "folder", "bytes"), labelled_ledger(spark, sf))


@query("ckpt_union", f"WITH {DOCS}, {_SEEN} SELECT file_name AS path FROM seen UNION SELECT file_name FROM docs WHERE bytes > 1000")
def ckpt_union(spark: SparkSession, sf: str) -> DataFrame:
    batch = manifest(spark, sf).where("bytes > 1000").select("path")
    return merge(labelled_ledger(spark, sf), batch)


@query("agg_run_summary", f"WITH {DOCS} SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'pending' END AS status, "
                          "count(*) AS files, sum(bytes)::BIGINT AS bytes FROM docs GROUP BY 1")
def agg_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return run_summary(manifest(spark, sf), labelled_ledger(spark, sf))


_TODO_CHUNKS = (
    f"{DOCS}, {WINDOW_UNITS}, {SEMANTIC}, sizes AS (SELECT d.file_name, d.folder, d.folder_ord, sum(strlen(c.chunk))::BIGINT AS bytes "
    "FROM chunks c JOIN docs d USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL), "
    + sql_pack("SELECT folder AS scope, folder_ord, row_number() OVER (PARTITION BY folder ORDER BY file_name) AS rn, "
               "file_name AS path, bytes FROM sizes", SHARD_BYTES)
    + ", bases AS (SELECT scope, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base "
    "FROM (SELECT p.scope, max(p.shard) + 1 AS n, min(f.folder_ord) AS o FROM packed p JOIN f USING (path) GROUP BY p.scope)), "
    "fresh AS (SELECT p.path, (p.shard + base + 1)::INT AS shard FROM packed p JOIN bases USING (scope))"
)


def resumed(spark: SparkSession, sf: str) -> str:
    """Run the corpus build on top of an earlier ledger; returns the dataset's path."""
    out = scratch_path(spark, "corpus")
    adopt(labelled_ledger(spark, sf), out)
    files = manifest(spark, sf).drop("doc_id")
    build_corpus(spark, files, docs(spark, sf), out, BuildOptions(shard_bytes=SHARD_BYTES, bounded=False))
    return out


@query("agg_run_summary_retried", f"WITH {DOCS} SELECT CASE WHEN bytes > 1000 THEN 'done' WHEN doc_id IN (SELECT doc_id FROM labels) "
                                  "THEN 'failed' ELSE 'pending' END AS status, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM docs GROUP BY 1")
def agg_run_summary_retried(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled files failed first; long files were then published twice, as after a lost ledger write."""
    tried = labelled_ledger(spark, sf).select("path", F.lit(None).cast("int").alias("shard"), F.lit("failed").alias("status"), "error")
    published = manifest(spark, sf).where("bytes > 1000").select(
        "path", F.lit(0).alias("shard"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")
    )
    return run_summary(manifest(spark, sf), tried.unionByName(published).unionByName(published))


@query("ckpt_resume", f"WITH RECURSIVE {_TODO_CHUNKS} SELECT path, shard, 'done' AS status FROM fresh "
                      "UNION ALL SELECT file_name, 0, 'done' FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)")
def ckpt_resume(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, resumed(spark, sf)).select("path", "shard", "status")


@query("corpus_build", f"WITH RECURSIVE {_TODO_CHUNKS} SELECT f.shard, d.file_name, c.chunk AS text, "
                       "sha256(d.doc_id::VARCHAR || '|' || c.chunk_no::VARCHAR) AS node_id FROM chunks c JOIN docs d USING (doc_id) "
                       "JOIN fresh f ON f.path = d.file_name")
def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    return read_release(spark, resumed(spark, sf)).select("shard", "file_name", "text", "node_id")


def two_runs(spark: SparkSession, sf: str, docs_of, per_folder: int) -> str:
    """Two default runs, each limited to ``per_folder`` files of every folder; returns the dataset's path."""
    out = scratch_path(spark, "corpus")
    files, rows = manifest(spark, sf).drop("doc_id"), docs_of(spark, sf)
    for _ in range(2):
        build_corpus(spark, files, rows, out, BuildOptions(shard_bytes=SHARD_BYTES, per_folder=per_folder, bounded=False))
    return out


def _sql_run(n: int, chosen: str) -> str:
    """Packing of one run over files f(folder, folder_ord, path, bytes) named by ``chosen``."""
    files = (f"SELECT folder AS scope, folder_ord, row_number() OVER (PARTITION BY folder ORDER BY path) AS rn, path, bytes FROM sizes WHERE {chosen}")
    return (
        sql_pack(files, SHARD_BYTES).replace("f AS (", f"f{n} AS (").replace("packed AS", f"packed{n} AS")
        .replace("FROM f WHERE", f"FROM f{n} f WHERE").replace("FROM packed p JOIN f ON", f"FROM packed{n} p JOIN f{n} f ON")
        + f", run{n} AS (SELECT p.path, p.bytes, p.shard + base AS shard FROM packed{n} p JOIN (SELECT scope, coalesce(sum(k) OVER "
        "(ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT p.scope, max(p.shard) + 1 AS k, "
        f"min(f.folder_ord) AS o FROM packed{n} p JOIN f{n} f USING (path) GROUP BY p.scope)) USING (scope))"
    )


def _two_runs_sql(first: str, second: str) -> str:
    return (
        f"{DOCS}, {WINDOW_UNITS}, {SEMANTIC}, sizes AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS turn FROM "
        "(SELECT d.file_name AS path, d.folder, d.folder_ord, count(*) AS n, sum(strlen(c.chunk))::BIGINT AS bytes "
        "FROM chunks c JOIN docs d USING (doc_id) GROUP BY ALL)), "
        + _sql_run(1, first) + ", " + _sql_run(2, second)
        + ", both_runs AS (SELECT path, shard FROM run1 UNION ALL SELECT path, shard + (SELECT max(shard) + 1 FROM run1) FROM run2)"
    )


_TWO_RUNS = _two_runs_sql("turn <= 12", "turn > 12 AND turn <= 24")
_OVERLAP = _two_runs_sql("folder_ord >= 3", "folder_ord < 3")


@query("corpus_two_runs", f"WITH RECURSIVE {_TWO_RUNS} SELECT b.shard::INT AS shard, count(*) AS files, sum(s.n)::BIGINT AS chunks, "
                          "sum(s.bytes)::BIGINT AS bytes FROM both_runs b JOIN sizes s USING (path) GROUP BY b.shard")
def corpus_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Limits are the feature here: the second run must go on where the first one stopped, in files and in shard numbers."""
    return shard_sums(read_release(spark, two_runs(spark, sf, docs, 12)))


def shard_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(
        F.count_distinct("file_name").alias("files"), F.count("*").alias("chunks"),
        F.sum(utf8_bytes(F.col("text"))).cast("long").alias("bytes"),
    )


def overlapping_runs(spark: SparkSession, sf: str) -> str:
    """Two builds that overlap in time and in files: the first takes folders 0 to 5 and is still at work when the second takes
    folders 3 to 9 and publishes; then the first publishes what is left for it."""
    out, files, rows = scratch_path(spark, "corpus"), manifest(spark, sf).drop("doc_id"), docs(spark, sf)
    options = BuildOptions(shard_bytes=SHARD_BYTES, bounded=False)
    slow = prepare(spark, files.where("folder_ord < 6"), rows, out, options)
    build_corpus(spark, files.where("folder_ord >= 3"), rows, out, options)
    publish_run(spark, slow, out)
    return out


@query("corpus_overlapping_runs", f"WITH RECURSIVE {_OVERLAP} SELECT b.shard::INT AS shard, count(*) AS files, sum(s.n)::BIGINT AS chunks, "
                                  "sum(s.bytes)::BIGINT AS bytes FROM both_runs b JOIN sizes s USING (path) GROUP BY b.shard")
def corpus_overlapping_runs(spark: SparkSession, sf: str) -> DataFrame:
    return shard_sums(read_release(spark, overlapping_runs(spark, sf)))


@query("agg_run_counters", f"WITH RECURSIVE {_OVERLAP}, named AS (SELECT 1 AS version, path, shard FROM run1 UNION ALL SELECT 2, path, "
                           "shard + (SELECT max(shard) + 1 FROM run1) FROM run2) SELECT version::INT AS version, min(shard)::INT AS base, "
                           "count(DISTINCT shard)::INT AS shards, count(*) AS done, 0::BIGINT AS empty, 0::BIGINT AS failed, "
                           "sum(s.n)::BIGINT AS chunks, sum(s.bytes)::BIGINT AS bytes FROM named JOIN sizes s USING (path) GROUP BY version")
def agg_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each run as its commit holds them."""
    return history(spark, overlapping_runs(spark, sf)).drop("run")


def blanked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents; those labelled low in quality have only white space."""
    low = src.table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("low")).distinct()
    rows = docs(spark, sf).join(low, "doc_id", "left")
    return rows.withColumn("text", F.when(F.col("low"), F.lit(" \n")).otherwise(F.col("text"))).drop("low")


@query("ckpt_empty_files", f"WITH {DOCS}, low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), turns AS (SELECT doc_id, file_name, "
                           "row_number() OVER (PARTITION BY folder ORDER BY file_name) AS turn FROM docs) SELECT file_name AS path, "
                           "CASE WHEN doc_id IN (SELECT doc_id FROM low) THEN 'empty' ELSE 'done' END AS status FROM turns WHERE turn <= 24")
def ckpt_empty_files(spark: SparkSession, sf: str) -> DataFrame:
    """Blank files are finished once; the second limited run gets to new files."""
    return entries(spark, two_runs(spark, sf, blanked, 12)).select("path", "status")


_ALL_FILES = (
    f"{DOCS}, {WINDOW_UNITS}, {SEMANTIC}, sizes AS (SELECT d.doc_id, d.file_name AS path, d.folder, d.folder_ord, count(*) AS n, "
    "sum(strlen(c.chunk))::BIGINT AS bytes FROM chunks c JOIN docs d USING (doc_id) GROUP BY ALL), " + _sql_run(1, "true")
)


def written_files(spark: SparkSession, sf: str) -> str:
    """Documents as one text file each, in a folder for each source."""
    root = scratch_path(spark, "files")
    write_text_files(docs(spark, sf).select("folder", "doc_id", "text"), root, ("folder", "doc_id"))
    return root


def _folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "/folder=([^/]*)/", 1)


_FILE_ID = "/doc_id=([0-9]+)[.]"


@query("src_files_build", f"WITH RECURSIVE {_ALL_FILES} SELECT s.doc_id, r.shard::INT AS shard, s.n AS chunks, s.bytes "
                          "FROM run1 r JOIN sizes s USING (path)")
def src_files_build(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as one text file each, then listed, read and built."""
    root, out = written_files(spark, sf), scratch_path(spark, "corpus")
    names = [r["folder"] for r in folder_inventory(manifest(spark, sf).select("folder", "bytes")).select("folder").collect()]
    folders = sorted(names, key=lambda name: int(name.removeprefix("src")))
    files = list_files(spark, root, folders, "*.txt", _folder_of)
    texts = read_text_files(spark, root, folders, "*.txt", _folder_of)
    build_corpus(spark, files, texts, out, BuildOptions(shard_bytes=SHARD_BYTES, bounded=False))
    number = F.regexp_extract("file_name", _FILE_ID, 1).cast("long")
    return read_release(spark, out).groupBy(number.alias("doc_id"), "shard").agg(
        F.count("*").alias("chunks"), F.sum(utf8_bytes(F.col("text"))).cast("long").alias("bytes")
    )


@query("src_pages_build", f"WITH RECURSIVE {_ALL_FILES} SELECT s.doc_id, r.shard::INT AS shard, s.n AS chunks, s.bytes "
                          "FROM run1 r JOIN sizes s USING (path)")
def src_pages_build(spark: SparkSession, sf: str) -> DataFrame:
    """Files listed and read by tasks, then built; no file name passes through the driver."""
    names = [r["folder"] for r in folder_inventory(manifest(spark, sf).select("folder", "bytes")).select("folder").collect()]
    folders = sorted(names, key=lambda name: int(name.removeprefix("src")))
    files = list_pages(spark, written_files(spark, sf), folders, "*.txt", folder_of=_folder_of)
    out = scratch_path(spark, "corpus")
    build_corpus(spark, files, read_pages(files), out, BuildOptions(shard_bytes=SHARD_BYTES, bounded=False))
    number = F.regexp_extract("file_name", _FILE_ID, 1).cast("long")
    return read_release(spark, out).groupBy(number.alias("doc_id"), "shard").agg(
        F.count("*").alias("chunks"), F.sum(utf8_bytes(F.col("text"))).cast("long").alias("bytes")
    )


@query("src_pages_after", f"WITH {DOCS}, named AS (SELECT *, 'folder=' || folder || '/doc_id=' || doc_id::VARCHAR || '/' AS dir FROM docs), "
                          "token AS (SELECT max(dir) AS t FROM named WHERE folder = (SELECT max(folder) FROM docs WHERE folder < 'src5')) "
                          "SELECT doc_id, folder, bytes + 1 AS bytes, dir > coalesce(t, '') AS later, ends_with(folder, '1') AS prefixed FROM named, token")
def src_pages_after(spark: SparkSession, sf: str) -> DataFrame:
    """Files (each ends in a line break), those that a second listing finds after the last page of the first, and those below prefixes."""
    root = written_files(spark, sf)
    files = list_pages(spark, root, pattern="*.txt", folder_of=_folder_of)
    first = files.where("folder < 'src5'")
    token = last_page(first.join(first.agg(F.max("folder").alias("folder")), "folder"))
    later = list_pages(spark, root, pattern="*.txt", after=token).select("path", F.lit(True).alias("later"))
    ones = [f"folder={r['folder']}/" for r in files.select("folder").distinct().where(F.endswith("folder", F.lit("1"))).collect()]
    below = list_pages(spark, root, pattern="*.txt", prefixes=ones or ["none"]).select("path", F.lit(True).alias("prefixed"))
    rows = files.join(later, "path", "left").join(below, "path", "left")
    return rows.select(
        F.regexp_extract("path", _FILE_ID, 1).cast("long").alias("doc_id"), "folder", "bytes",
        *[F.coalesce(name, F.lit(False)).alias(name) for name in ("later", "prefixed")],
    )
