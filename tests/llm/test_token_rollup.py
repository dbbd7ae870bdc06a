from collections import Counter

import tiktoken

from corpusloom.llm.token_rollup import FOLDER, PATTERN, VERSIONS, Rollup, _ranks, maintained_totals
from corpusloom.session import scratch_path


def test_totals_match_brute_force(spark, awkward, awkward_rows):
    coders = {v: tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=_ranks(f"{FOLDER}/{f}"), special_tokens={}) for v, f in VERSIONS.items()}
    gone = {awkward_rows[3][0], awkward_rows[5][0]}
    want = Counter()
    for doc_id, text, lang, source, *_ in awkward_rows:
        if doc_id not in gone:
            kept = "\n".join(dict.fromkeys((text or "").split("\n")))
            for version, coder in coders.items():
                want[source, lang, version, "documents"] += 1
                want[source, lang, version, "tokens"] += len(coder.encode_ordinary(kept))
    labels = spark.createDataFrame([(i, 1) for i in gone] + [(i, 1) for i in gone] + [(None, 1), (999, 1), (0, None)], "doc_id long, toxic int")
    got = Counter()
    for r in maintained_totals(awkward, labels).collect():
        got[r.source, r.lang, r.version, "documents"] += r.documents
        got[r.source, r.lang, r.version, "tokens"] += r.tokens
    assert +got == +want


def test_batches_are_idempotent_and_uncommitted_ones_do_not_count(spark):
    store = Rollup(spark, scratch_path(spark, "t-rollup"))
    schema = "source string, lang string, version string, documents long, tokens long"
    assert store.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "v", 2, 10), ("a", "en", "v", 1, 5), (None, None, "v", 1, None)], schema)
    assert store.apply("one", first) and not store.apply("one", first)
    assert store.apply("two", spark.createDataFrame([("a", "en", "v", -1, -5), (None, None, "v", -1, 0)], schema))
    # A batch that wrote its deltas but broke off before the marker.
    spark.createDataFrame([("a", "en", "v", 9, 9, "three")], f"{schema}, batch string").write.parquet(f"{store.path}/deltas/three")
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 2, 10)]
    assert store.apply("three", spark.createDataFrame([("b", "de", "w", 1, 1)], schema))
    assert sorted(tuple(r) for r in store.totals().collect()) == [("a", "en", "v", 2, 10), ("b", "de", "w", 1, 1)]


def test_empty_table(spark, nothing):
    assert maintained_totals(nothing, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
