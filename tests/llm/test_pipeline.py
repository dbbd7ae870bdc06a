import duckdb
import pytest

import corpus_pipeline
from corpus_pipeline import STAGES, run
from corpusloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_columns_and_take_effect(outputs):
    columns = outputs["input"].columns
    for name, _ in STAGES[:-1]:
        assert outputs[name].columns == columns
    counts = [df.count() for df in outputs.values()]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0.6 * counts[0]


def test_exact_stage(outputs):
    before = outputs["quality"].collect()
    largest = {}
    for row in before:
        largest[row.text] = max(largest.get(row.text, -1), row.doc_id)
    assert {(r.doc_id, r.text) for r in outputs["exact_dedup"].collect()} == {(i, t) for t, i in largest.items()}


def test_near_stage(outputs):
    from test_minhash import brute

    rows = [(r.doc_id, r.text) for r in outputs["exact_dedup"].collect()]
    want = {doc_id for doc_id, _, name in brute(rows) if doc_id == name}
    assert {r.doc_id for r in outputs["near_dedup"].collect()} == want


def test_decontamination_stage(outputs):
    from test_decontamination import brute

    items = [(r.item_id, r.text) for r in outputs["input"].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in outputs["near_dedup"].collect()}
    after = {r.doc_id: r.text for r in outputs["decontamination"].collect()}
    hit = {row[0]: row[2] / row[1] for row in brute(list(before.items()), items) if row[5]}
    assert {i: t for i, t in after.items() if i not in hit} == {i: t for i, t in before.items() if i not in hit}
    assert {i for i in hit if hit[i] <= 0.5} == hit.keys() & after.keys()
    assert not any(row[5] for row in brute(list(after.items()), items))


def test_run_gives_the_last_stage(spark, outputs):
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(run(spark, SF).collect()) == sorted(outputs["encoding"].collect())
    assert outputs["encoding"].where("not lossless").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    if name in ORACLES:
        for table in ("documents", "pages", "benchmark", "labels"):
            duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = duckdb.sql(ORACLES[name])
        columns = want.columns
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want.fetchall())


def test_stages_bound_batches_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        for own, want in ((None, corpus_pipeline.BATCH_BYTES), ("3m", "3m")):
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)
            corpus_pipeline.encoding_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
