import zlib

import numpy as np
import pytest

from corpusloom.llm.quality import SLOTS, fit, index_vectors, keep_quality, quality, slots_of, word_vectors


@pytest.fixture(scope="module")
def scored(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    rows = {r.doc_id: r for r in quality(docs, labels).collect()}
    return rows, {r.doc_id: r.quality for r in labels.collect()}, docs, labels


def test_held_out_accuracy(scored):
    rows, labels, _, _ = scored
    held = [(rows[i].score, rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([p == y for _, p, y in held]) > 0.9


def test_held_out_labels_change_no_score(scored, spark):
    from pyspark.sql import functions as F

    rows, _, docs, labels = scored
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality(docs, flipped).collect()} == {i: r.score for i, r in rows.items()}


def test_kept_rows_have_their_columns(scored, awkward, spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    kept = keep_quality(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert {r.score for r in quality(awkward, labels).collect()} == {0.5}


def test_empty_table(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality(nothing, labels).count() == 0


def test_word_vectors_match_brute_force(spark):
    texts = ["a b c a *** B", "", None, "c d", "UPPER Words a"]
    got = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    want = np.zeros((SLOTS, got.shape[1]))
    for text in texts:
        slots = slots_of(text)
        for i, slot in enumerate(slots):
            want[slot] += index_vectors()[slots[max(0, i - 2) : i + 3]].sum(0)
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, np.where(norm > 0, want / np.where(norm > 0, norm, 1), 0), atol=1e-6)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    net = fit(x, (rng.random(4000) < p).astype(float))
    assert np.abs(net.scores(x) - p).mean() < 0.08
