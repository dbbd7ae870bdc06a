import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import scratch_path
from corpusloom.sources import jsonl, ledger, shards
from corpusloom.sources.documents import prompt_matrix, read_text_files
from corpusloom.sources.listing import list_files, list_prefix
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def papers(tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    for name, text in {"2403/a.txt": "one\ntwo", "2403/b.txt": "é", "24031/c.txt": "c", "2402/d.txt": "d"}.items():
        path = root / "pdf" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(root)


def test_listing_reads_names_and_sizes(spark, papers):
    files = {r.path.split("/pdf/")[1]: (r.folder, r.bytes) for r in list_files(spark, papers, pattern="*.txt").collect()}
    assert files == {"2403/a.txt": ("2403", 7), "2403/b.txt": ("2403", 2), "24031/c.txt": ("24031", 1), "2402/d.txt": ("2402", 1)}


def test_prefix_is_a_string_prefix(spark):
    manifest = spark.createDataFrame([(f"pdf/{p}",) for p in ("2403/a", "24031/c", "2402/d", "2401/e")], "path string")
    got = {r.path: r.folder_ord for r in list_prefix(manifest, "pdf", ["2403", "2402", "24031"]).collect()}
    assert got == {"pdf/2403/a": 0, "pdf/24031/c": 0, "pdf/2402/d": 1}


def test_whole_text_files(spark, papers):
    rows = read_text_files(spark, papers, ["2403", "2402"], "*.txt").collect()
    found = {r.file_name.split("/pdf/")[1]: (r.folder, r.folder_ord, r.text) for r in rows}
    assert found["2403/a.txt"] == ("2403", 0, "one\ntwo") and len({r.doc_id for r in rows}) == 4
    assert found["2402/d.txt"][1] == 1 and found["24031/c.txt"][1] == 2
    listed = {(r.path, r.folder, r.folder_ord) for r in list_files(spark, papers, ["2403", "2402"], "*.txt").collect()}
    assert listed == {(r.file_name, r.folder, r.folder_ord) for r in rows}


def test_ragged_prompts(spark):
    frame = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "conv int, prompts array<string>")
    got = sorted(tuple(r) for r in prompt_matrix(frame, "conv", "prompts").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]


def test_one_shard_prunes_the_others(spark):
    path = scratch_path(spark, "t-shards")
    shards.write_shards(spark.range(100).selectExpr("id", "cast(id % 4 as int) as shard"), path, base=4)
    one = shards.read_shard(spark, path, 5)
    assert one.count() == 25
    assert "PartitionFilters: [isnotnull(shard" in plan_of(one)


def test_rewriting_a_shard_keeps_the_others(spark):
    path = scratch_path(spark, "t-again")
    rows = spark.range(100).selectExpr("id", "cast(id % 4 as int) as shard")
    shards.write_shards(rows, path)
    shards.write_shards(rows.where("shard = 2"), path)
    assert shards.read_dataset(spark, path).count() == 100


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n{broken\n{"a": "2\\n3"}\n')
    schema = T.StructType([T.StructField("a", T.StringType())])
    rows = jsonl.read_jsonl(spark, str(tmp_path), schema).cache()
    assert sorted(r.a for r in jsonl.parsed(rows).collect()) == ["1", "2\n3"]
    assert [r._corrupt_record for r in rows.where("a is null").collect()] == ["{broken"]


def test_missing_ledger_is_empty(spark):
    assert ledger.read_ledger(spark, scratch_path(spark, "t-none")).count() == 0


def test_failed_files_are_tried_again(spark):
    path = scratch_path(spark, "t-ledger")
    ledger.append_ledger(spark.createDataFrame([("a", 0, "done", None), ("b", None, "failed", "x")], ledger.SCHEMA), path)
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    todo = ledger.unprocessed(manifest, ledger.read_ledger(spark, path))
    assert sorted(r.path for r in todo.collect()) == ["b", "c"]


def test_quarantine_keeps_the_bytes(spark):
    frame = spark.sql("select 1 as id, 'ok' as t union all select 2, cast(unhex('61ff') as string) union all select 3, null")
    clean, bad = shards.split_encodable(frame, "t")
    assert [r.id for r in clean.collect()] == [1]
    assert {r.id: r.raw for r in bad.collect()} == {2: bytearray(b"a\xff"), 3: None}
