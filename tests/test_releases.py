import pathlib
import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpusloom.plans import corpus_build
from corpusloom.plans.corpus_build import BuildOptions, build_corpus, prepare, publish
from corpusloom.session import scratch_path
from corpusloom.sources import releases
from corpusloom.sources.releases import adopt, entries, head, history, put_if_absent, read_release, read_release_shard, write_run
from tests.test_builds import corpus

SMALL = BuildOptions(shard_bytes=12)


def files(spark, n=6):
    return corpus(spark, [("A" if i < 4 else "B", i // 4, f"text {i}.") for i in range(n)])


def state(spark, out):
    rows = read_release(spark, out).groupBy(F.col("file_name").alias("path"), "shard").count()
    published = sorted((r.path, r.shard, r["count"]) for r in rows.collect())
    listed = sorted((r.path, r.shard, 1) for r in entries(spark, out).where("status = 'done'").collect())
    return published, listed


def test_runs_that_overlap_lose_nothing(spark):
    """The first run is prepared, the second runs as a whole, then the first publishes: every file once, by one shard number."""
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    slow = prepare(spark, manifest.where("path < 'pdf/A/3'"), docs, out, SMALL)
    assert build_corpus(spark, manifest.where("path > 'pdf/A/1'"), docs, out, SMALL) == 1
    assert publish(spark, slow, out) == 2
    published, listed = state(spark, out)
    assert published == listed and [p for p, *_ in published] == sorted(r.path for r in manifest.collect())
    first, second = ({s for p, s, _ in published if (p > "pdf/A/1") == late} for late in (True, False))
    assert not first & second and first | second == set(range(len(first | second)))
    assert publish(spark, prepare(spark, manifest, docs, out, SMALL), out) is None


def test_a_run_whose_files_are_all_taken_publishes_nothing(spark):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    slow = prepare(spark, manifest, docs, out, SMALL)
    build_corpus(spark, manifest, docs, out, SMALL)
    assert publish(spark, slow, out) is None and head(spark, out)[0] == 1


def test_lost_race_gets_new_numbers_without_writing_again(spark, monkeypatch):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    pending = prepare(spark, manifest.where("folder = 'A'"), docs, out, SMALL)
    writes, real = [], corpus_build.commit

    def late(spark, root, version, run, base):
        writes.append(run["run"])
        if len(writes) == 1:
            monkeypatch.setattr(corpus_build, "commit", real)
            build_corpus(spark, manifest.where("folder = 'B'"), docs, out, SMALL)
            monkeypatch.setattr(corpus_build, "commit", late)
        return real(spark, root, version, run, base)

    monkeypatch.setattr(corpus_build, "commit", late)
    assert publish(spark, pending, out) == 2
    assert len(writes) == 2 and writes[0] == writes[1]
    published, listed = state(spark, out)
    assert published == listed and len(published) == 6
    assert [(r.version, r.base) for r in history(spark, out).orderBy("version").collect()] == [(1, 0), (2, 2)]


@pytest.mark.parametrize("step", ["pack", "write_run", "commit"])
def test_crash_at_each_step_repeats_cleanly(spark, step, monkeypatch):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    build_corpus(spark, manifest.where("folder = 'A'"), docs, out, SMALL)
    before = state(spark, out)

    def crash(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(corpus_build, step, crash)
        with pytest.raises(RuntimeError, match="lost"):
            build_corpus(spark, manifest, docs, out, SMALL)
    assert state(spark, out) == before and head(spark, out)[0] == 1
    build_corpus(spark, manifest, docs, out, SMALL)
    published, listed = state(spark, out)
    assert published == listed and len(published) == 6 and head(spark, out)[0] == 2


def test_rows_of_a_crashed_run_are_not_read(spark):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    build_corpus(spark, manifest.where("folder = 'A'"), docs, out, SMALL)
    rows = spark.createDataFrame([("x", "pdf/A/0", "n", 0)], "text string, file_name string, node_id string, shard int")
    rows.withColumnRenamed("shard", "part").write.partitionBy("part").parquet(f"{out}/data/run=r0")
    published, listed = state(spark, out)
    assert published == listed and len(published) == 4


def test_earlier_versions_stay_readable(spark):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    for folder in "AB":
        build_corpus(spark, manifest.where(F.col("folder") == folder), docs, out, SMALL)
    assert {r.file_name[4] for r in read_release(spark, out, 1).collect()} == {"A"}
    assert entries(spark, out, 1).count() == 4 and entries(spark, out, after=1).count() == 2
    assert read_release(spark, out, 0).count() == 0
    for number in range(head(spark, out)[1]):
        want = read_release(spark, out).where(F.col("shard") == number).select("file_name", "shard")
        assert sorted(read_release_shard(spark, out, number).select("file_name", "shard").collect()) == sorted(want.collect())
    assert read_release_shard(spark, out, 99).count() == 0


def test_counters_equal_a_recount(spark):
    docs, manifest = corpus(spark, [("A", 0, "One. Two. é"), ("A", 0, " "), ("B", 1, "Three four.")])
    out = scratch_path(spark, "t-out")
    build_corpus(spark, manifest, docs, out, SMALL)
    row = history(spark, out).first()
    again = read_release(spark, out).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.countDistinct("shard").alias("s")).first()
    assert (row.done, row.empty, row.failed, row.chunks, row.bytes, row.shards, row.base) == (2, 1, 0, again.n, again.b, again.s, 0)


def test_a_run_without_any_text(spark):
    docs, manifest = corpus(spark, [("A", 0, " "), ("A", 0, "")])
    out = scratch_path(spark, "t-out")
    assert build_corpus(spark, manifest, docs, out, SMALL) == 1
    row = history(spark, out).first()
    assert (row.empty, row.shards, row.chunks, row.bytes) == (2, 0, 0, 0)
    assert build_corpus(spark, manifest, docs, out, SMALL) is None


def test_adopted_files_keep_their_shards(spark):
    docs, manifest = files(spark)
    out = scratch_path(spark, "t-out")
    adopt(manifest.where("folder = 'A'").select("path", F.lit(4).alias("shard"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")), out)
    build_corpus(spark, manifest, docs, out, SMALL)
    assert {(r.path[4], r.shard) for r in entries(spark, out).collect()} == {("A", 4), ("B", 5), ("B", 6)}


def test_only_one_of_many_creates_a_file(spark):
    path, won, gate = scratch_path(spark, "race") + "/x y/7.json", [], threading.Barrier(8)

    def run(k):
        gate.wait()
        if put_if_absent(spark, path, str(k)):
            won.append(k)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and [r.value for r in spark.read.text(path).collect()] == [str(won[0])]


ROWS = [(f"é{i}" if i % 7 else None, f"f{i % 40}", "n", i % 40) for i in range(400)] + [(f"x{i}", "big", "n", 40) for i in range(3000)]


def run_of(spark, out):
    rows = spark.createDataFrame(ROWS, "text string, file_name string, node_id string, shard int").repartition(5)
    listed = rows.groupBy("file_name", "shard").count().select(
        F.col("file_name").alias("path"), "shard", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error")
    )
    run = write_run(rows, listed, out)
    assert releases.commit(spark, out, 1, run, 0)
    got = sorted(map(tuple, read_release(spark, out).select("text", "file_name", "node_id", "shard").collect()), key=str)
    return run, got, sorted(path.name for path in pathlib.Path(f"{out.removeprefix('file:')}/data/run={run['run']}").glob("part=*"))


def test_tasks_write_the_parts_themselves(spark, monkeypatch):
    """Without Spark's writer, which opens a folder for each part by a process of its own on a local disk."""
    with monkeypatch.context() as patch:
        patch.delattr(DataFrameWriter, "partitionBy")
        run, got, folders = run_of(spark, scratch_path(spark, "t-out"))
    assert got == sorted(ROWS, key=str) and folders == sorted(f"part={k}" for k in range(41))
    assert (run["chunks"], run["bytes"], run["shards"], run["done"]) == (3400, sum(len((r[0] or "").encode()) for r in ROWS), 41, 41)


def test_a_store_that_python_cannot_open_gets_the_same_parts(spark, monkeypatch):
    def closed(path):
        raise OSError("no library")

    monkeypatch.setattr(releases, "opened", closed)
    run, got, folders = run_of(spark, scratch_path(spark, "t-out"))
    assert got == sorted(ROWS, key=str) and set(folders) == {f"part={k}" for k in range(41)}
    assert (run["chunks"], run["bytes"], run["shards"], run["done"]) == (3400, sum(len((r[0] or "").encode()) for r in ROWS), 41, 41)
