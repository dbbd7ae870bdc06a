"""Named queries of the operators, with production parameters, and SQL checks where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.decontamination import contamination
from corpusloom.llm.exact_dedup import exact_groups
from corpusloom.llm.lexical_search import search
from corpusloom.llm.licenses import LICENCE_FILE, SPEAKS, TEMPLATES, document_files, scan
from corpusloom.llm.licenses import THRESHOLD as LICENCE_THRESHOLD
from corpusloom.llm.merge_dropout import encode
from corpusloom.llm.minhash import near_duplicates
from corpusloom.llm.ngram_join import ngram_components
from corpusloom.llm.oracles import CONTAMINATION_SQL, EXACT_SQL, JOIN_SQL, NEAR_SQL, REPEATS_SQL, SEARCH_SQL, license_sql, url_sql
from corpusloom.llm.pii import digest_columns, personal_data
from corpusloom.llm.quality import quality
from corpusloom.llm.substring_dedup import without_repeats
from corpusloom.llm.token_rollup import maintained_totals
from corpusloom.llm.url_filter import DAMPING, RULES, THRESHOLD, verdicts
from corpusloom.llm.whitening import whiten
from corpusloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_exact_dedup", EXACT_SQL)
def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op6_decontamination", CONTAMINATION_SQL)
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_quality")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_minhash_near_dedup", NEAR_SQL)
def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_substring_dedup", REPEATS_SQL)
def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_merge_dropout")
def _merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "lossless")


@query("op2_pii")
def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(personal_data(table(spark, sf_dir, "documents")))


@query("op3_license_scan", license_sql(TEMPLATES, SPEAKS, LICENCE_FILE, LICENCE_THRESHOLD))
def _license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_files(table(spark, sf_dir, "documents")).select("path", "text"))


@query("op5_token_rollup")
def _token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_url_filter", url_sql(RULES, DAMPING, THRESHOLD))
def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


@query("op11_fp_tree_search", SEARCH_SQL)
def _fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_cholesky_whitening")
def _cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_ngram_join", JOIN_SQL)
def _ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
