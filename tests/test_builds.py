import pytest
from pyspark.sql import functions as F

from corpusloom.catalog.generation import echo_client
from corpusloom.functions.prompts import SUMMARIZE
from corpusloom.operators import semantic
from corpusloom.plans.corpus_build import BuildOptions, build_corpus, run_summary
from corpusloom.plans.instruction_build import build_instructions
from corpusloom.session import scratch_path
from corpusloom.sources.releases import entries, read_release


def corpus(spark, texts):
    rows = [(i, f"pdf/{f}/{i}", f, o, t) for i, (f, o, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, file_name string, folder string, folder_ord int, text string")
    manifest = docs.select(
        F.col("file_name").alias("path"), "folder", "folder_ord", F.octet_length("text").cast("long").alias("bytes")
    )
    return docs, manifest


def test_failed_file_is_retried_and_rows_land_once(spark):
    docs, manifest = corpus(spark, [("A", 0, "One. Two."), ("A", 0, "poison pill."), ("B", 1, "Three. Four. Five.")])
    out = scratch_path(spark, "t-out")

    def picky(units):
        if any("poison" in u for u in units):
            raise ValueError("bad")
        return semantic.bag_distances(units)

    first = BuildOptions(shard_bytes=10, unit_mode="sentence", bounded=False, assign=semantic.chunk_starts(picky))
    build_corpus(spark, manifest, docs, out, first)
    status = {r.path: r.status for r in entries(spark, out).collect()}
    assert status == {"pdf/A/0": "done", "pdf/A/1": "failed", "pdf/B/2": "done"}
    failed = entries(spark, out).where("status = 'failed'").first()
    assert failed.error == "ValueError: bad" and failed.shard is None
    before = read_release(spark, out).count()

    second = BuildOptions(shard_bytes=10, unit_mode="sentence", bounded=False, base_shard=10)
    build_corpus(spark, manifest, docs, out, second)
    added = read_release(spark, out).where("shard >= 10")
    assert {r.file_name for r in added.collect()} == {"pdf/A/1"}
    assert read_release(spark, out).where("shard < 10").count() == before
    rows = read_release(spark, out)
    assert rows.count() == rows.select("node_id").distinct().count()
    assert rows.groupBy("file_name").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0

    build_corpus(spark, manifest, docs, out, second)
    assert read_release(spark, out).count() == rows.count()
    assert {r.status for r in entries(spark, out).where("shard = 10").collect()} == {"done"}


def test_limits_ignore_finished_files(spark):
    docs, manifest = corpus(spark, [("A", 0, f"text {i}.") for i in range(4)])
    out = scratch_path(spark, "t-out")
    for run in range(2):
        build_corpus(spark, manifest, docs, out, BuildOptions(per_folder=2, base_shard=run))
        assert entries(spark, out).count() == 2 * (run + 1)
    counts = {r.status: r.files for r in run_summary(manifest, entries(spark, out)).collect()}
    assert counts == {"done": 4}


def test_second_default_run_adds_shards(spark):
    docs, manifest = corpus(spark, [("A", 0, f"text {i}.") for i in range(6)])
    out = scratch_path(spark, "t-out")
    for run in range(3):
        build_corpus(spark, manifest, docs, out, BuildOptions(shard_bytes=8, total=2))
    published = read_release(spark, out).select(F.col("file_name").alias("path"), "shard").distinct()
    listed = entries(spark, out).select("path", "shard")
    assert published.count() == listed.count() == 6
    assert published.exceptAll(listed).count() == listed.exceptAll(published).count() == 0
    more, _ = corpus(spark, [("A", 0, f"text {i}.") for i in range(7)])
    with pytest.raises(ValueError, match="replace published"):
        build_corpus(spark, manifest.unionByName(manifest.limit(1).withColumn("path", F.lit("pdf/A/6"))), more, out,
                     BuildOptions(base_shard=1))
    assert read_release(spark, out).count() == 6


def test_blank_files_are_finished_and_failed_ones_come_last(spark):
    docs, manifest = corpus(spark, [("A", 0, " "), ("A", 0, "poison here."), ("A", 0, "good."), ("A", 0, "better.")])
    out = scratch_path(spark, "t-out")

    def picky(units):
        if any("poison" in u for u in units):
            raise ValueError("bad")
        return semantic.bag_distances(units)

    options = BuildOptions(total=1, unit_mode="sentence", bounded=False, assign=semantic.chunk_starts(picky))
    for _ in range(5):
        build_corpus(spark, manifest, docs, out, options)
    rows = [(r.path[-1], r.status) for r in entries(spark, out).collect()]
    assert sorted(rows) == [("0", "empty"), ("1", "failed"), ("1", "failed"), ("2", "done"), ("3", "done")]
    assert {r.status: r.files for r in run_summary(manifest, entries(spark, out)).collect()} == {"done": 2, "empty": 1, "failed": 1}


def test_hot_folder_keeps_every_row(spark):
    texts = [("hot" if i % 3 == 0 else f"f{i}", i, f"w{i} " * (i % 7 + 1)) for i in range(300)]
    docs, manifest = corpus(spark, texts)
    out = scratch_path(spark, "t-out")
    build_corpus(spark, manifest, docs, out, BuildOptions(shard_bytes=60))
    rows = read_release(spark, out)
    assert rows.select("file_name").distinct().count() == 300
    over = rows.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("file_name").alias("n"))
    assert over.where("b > 60 and n > 1").count() == 0


def test_instructions_end_to_end(spark):
    chunks = spark.createDataFrame([(i, f"chunk {i}") for i in range(30)], "id long, text string")
    rows = build_instructions(chunks, F.col("id"), "m", echo_client)
    got = rows.collect()
    assert len(got) == 30 and {r.status for r in got} == {"ok"}
    assert all(r.output == f"{r.instruction} {r.input}"[:200].strip() or len(r.output.split()) == 20 for r in got)
    assert any(r.instruction == SUMMARIZE for r in got)
