from pyspark.sql import functions as F

from corpusloom.operators.splitting import explode_chunks, window_units
from corpusloom.session import scratch_path
from corpusloom.streaming import chat_state
from corpusloom.streaming.ingest import ingest, ingested


def test_ingest_equals_batch_and_picks_up_new_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    landing, out, offsets = (scratch_path(spark, n) for n in ("t-land", "t-out", "t-off"))

    def chunk(batch):
        return explode_chunks(batch, window_units(F.col("text")))

    def run():
        query = ingest(spark, landing, docs.schema, chunk, out, offsets, files_per_batch=2)
        query.awaitTermination()
        return ingested(spark, out)

    docs.where("doc_id < 120").repartition(6).write.parquet(landing)
    first = run()
    assert first.select("batch_id").distinct().count() == 3
    assert run().count() == first.count()
    docs.where("doc_id >= 120").repartition(2).write.mode("append").parquet(landing)
    got = run().select("doc_id", "chunk_no", "chunk")
    want = chunk(docs)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_chat_state_survives_a_restart(spark):
    schema = "conv_id long, turn long, role string, text string"
    landing, out, offsets = (scratch_path(spark, n) for n in ("t-turns", "t-req", "t-off"))
    before = spark.conf.get(chat_state.PROVIDER, None)

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        chat_state.run(spark, landing, spark.createDataFrame([], schema).schema, out, offsets).awaitTermination()
        return {(r.conv_id, r.turn): (r.n_messages, r.context_tokens) for r in spark.read.parquet(out).collect()}

    got = land([(1, 0, "user", "a b"), (2, 0, "system", "s"), (2, 1, "user", "x"), (1, 1, "assistant", "c d e")])
    assert got == {(1, 0): (1, 0), (2, 1): (2, 1)}
    got = land([(1, 2, "user", "f"), (2, 3, "user", "y"), (2, 2, "assistant", "z")])
    assert got == {(1, 0): (1, 0), (2, 1): (2, 1), (1, 2): (3, 5), (2, 3): (4, 3)}
    assert spark.conf.get(chat_state.PROVIDER, None) == before


def landed(spark, **options):
    schema = "conv_id long, turn long, role string, text string"
    landing, out, offsets = (scratch_path(spark, n) for n in ("t-turns", "t-req", "t-off"))

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        chat_state.run(spark, landing, spark.createDataFrame([], schema).schema, out, offsets, **options).awaitTermination()
        return sorted((r.conv_id, r.turn, r.n_messages, r.context_tokens, r.status) for r in spark.read.parquet(out).collect())

    return land


def test_null_text_counts_as_empty(spark):
    land = landed(spark)
    assert land([(1, 0, "user", None), (1, 1, "user", "a b"), (1, 2, "user", None)]) == [
        (1, 0, 1, 0, "ok"), (1, 1, 2, 0, "ok"), (1, 2, 3, 2, "ok"),
    ]


def test_turns_wait_for_their_predecessors(spark):
    land = landed(spark, patience_ms=3_600_000)
    assert land([(1, 2, "user", "c"), (2, 0, "user", "x y")]) == [(2, 0, 1, 0, "ok")]
    assert land([(1, 1, "assistant", "b b")]) == [(2, 0, 1, 0, "ok")]
    first = land([(1, 0, "user", "a"), (1, 4, "user", None)])
    assert first == [(1, 0, 1, 0, "ok"), (1, 2, 3, 3, "ok"), (2, 0, 1, 0, "ok")]
    assert land([(1, 3, "assistant", "d"), (1, 1, "assistant", "again")])[1:4] == [
        (1, 1, None, None, "late"), (1, 2, 3, 3, "ok"), (1, 4, 5, 5, "ok"),
    ]


def test_patience_ends_and_idle_conversations_are_forgotten(spark):
    land = landed(spark, patience_ms=1)
    land([(1, 0, "user", "a"), (1, 3, "user", "d")])
    # The gap never closes: with the next batch, long after the deadline, the waiting turn goes on.
    assert (1, 3, 2, 1, "ok") in land([(2, 0, "user", "x")])
    land = landed(spark, patience_ms=1, idle_ms=2)
    land([(1, 0, "user", "a")])
    land([(2, 0, "user", "x")])
    assert (1, 0, 1, 0, "ok") in land([(1, 0, "user", "fresh")]) and len(land([(3, 0, "user", "y")])) == 4
