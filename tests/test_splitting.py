import functools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusloom.catalog import QUERIES
from corpusloom.operators import semantic
from corpusloom.operators.splitting import (
    bound_sizes, buffered, explode_chunks, merge_short, sentence_units, token_windows, window_units,
)
from tests.conftest import plan_of


def arr(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first().v


def tokens(n):
    return [f"t{i}" for i in range(n)]


def test_window_counts(spark):
    sizes = {n: [len(w) for w in arr(spark, token_windows(F.col("t")), t=tokens(n))] for n in (1, 256, 257, 492, 493)}
    assert sizes == {1: [1], 256: [256], 257: [256, 21], 492: [256, 256], 493: [256, 256, 21]}


def test_windows_rebuild_the_tokens(spark):
    cut = arr(spark, token_windows(F.col("t")), t=tokens(1000))
    assert sum([cut[0], *[w[20:] for w in cut[1:]]], []) == tokens(1000)


def test_blank_text_has_no_units(spark):
    assert arr(spark, window_units(F.col("x")), x="  \n ") == []
    assert arr(spark, sentence_units(F.col("x")), x="  \n ") == []


def test_sentences(spark):
    assert arr(spark, sentence_units(F.col("x")), x=" A b. C?  D!\nE 3.5 f") == ["A b.", "C?", "D!", "E 3.5 f"]


def test_buffer(spark):
    assert arr(spark, buffered(F.col("u")), u=["a", "b", "c"]) == ["a b", "a b c", "b c"]
    assert arr(spark, buffered(F.col("u")), u=["a"]) == ["a"]


def fold(sizes, minimum):
    groups = []
    for n in sizes:
        if groups and n < minimum and sum(groups[-1]) < minimum:
            groups[-1].append(n)
        else:
            groups.append([n])
    return [sum(g) for g in groups]


def test_merge_short_follows_the_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [["w"] * int(n) for n in rng.integers(1, 160, rng.integers(1, 12))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, chunks array<array<string>>")
    got = {r.id: [len(c) for c in r.v] for r in frame.select("id", merge_short(F.col("chunks")).alias("v")).collect()}
    assert got == {i: fold([len(c) for c in chunks], 100) for i, chunks in rows}


def test_bounds(spark):
    chunks = [["a"] * 50, ["b"] * 60, ["c"] * 600]
    assert [len(c) for c in arr(spark, bound_sizes(F.col("c")), c=chunks)] == [110, 256, 256, 88]


def semantic_chunks(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return semantic.semantic_chunks(docs, **options).first().chunks


def test_one_sentence_is_one_chunk(spark):
    assert semantic_chunks(spark, "Only one.") == ["Only one."]


def test_equal_distances_do_not_break(spark):
    assert semantic_chunks(spark, "a b. a b. a b. a b.") == ["a b. a b. a b. a b."]


def test_break_at_the_topic_change(spark):
    text = " ".join(["cats purr softly."] * 6 + ["rockets burn fuel."] * 6)
    assert len(semantic_chunks(spark, text)) >= 2


def test_failing_encoder_leaves_null(spark):
    def broken(_):
        raise ValueError("no")

    assert semantic_chunks(spark, "A. B.", assign=semantic.chunk_starts(broken)) is None


@pytest.fixture
def failing(monkeypatch):
    """The default distances fail on one document."""
    def distances(units):
        if any("poison" in u for u in units):
            raise ValueError("bad units")
        return semantic.bag_distances(units)

    monkeypatch.setattr(semantic, "chunk_starts", functools.partial(semantic.chunk_starts, distances))


@pytest.mark.parametrize("name", ["chunk_semantic", "chunk_semantic_window", "chunk_semantic_bounded"])
def test_a_query_ends_with_the_error_of_a_document(spark, failing, tmp_path, name):
    rows = [(1, "s1", "A b. C d."), (2, "s1", "A poison. C d."), (3, "s1", " "), (4, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.where("doc_id <> 2").write.parquet(f"{tmp_path}/good/documents.parquet")
    docs.write.parquet(f"{tmp_path}/all/documents.parquet")
    assert {r.doc_id for r in QUERIES[name](spark, f"{tmp_path}/good").collect()} == {1}
    with pytest.raises(PythonException, match="ValueError: bad units"):
        QUERIES[name](spark, f"{tmp_path}/all").collect()


def test_errors_are_kept_where_they_are_asked_for(spark, failing):
    docs = spark.createDataFrame([(1, "A b. C d."), (2, "A poison. C d."), (3, " "), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.chunks, r.chunk_error) for r in semantic.semantic_chunks(docs, errors=True).collect()}
    assert got == {1: (["A b. C d."], None), 2: (None, "ValueError: bad units"), 3: ([], None), 4: (None, None)}


def test_an_own_encoder_may_end_the_job(spark):
    def broken(_):
        raise ValueError("no")

    with pytest.raises(PythonException, match="ValueError: no"):
        semantic_chunks(spark, "A. B.", assign=semantic.chunk_starts(broken, errors=False))


def test_vector_encoder_distances():
    def encode(texts):
        return np.array([[t.count("a"), t.count("b")] for t in texts], dtype=float)

    d = semantic.encoder_distances(encode, radius=0)(["a", "a", "b"])
    assert d.tolist() == [0.0, 1.0]


def test_sql_and_udf_distances_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fast = semantic.distance_rows(docs)
    contexts = semantic.unit_rows(docs)
    slow = semantic.distances(semantic.word_counts(contexts), contexts)
    both = fast.join(slow.withColumnRenamed("distance", "other"), ["doc_id", "pos"], "full")
    assert both.where("distance is null or other is null or abs(distance - other) > 1e-9").count() == 0


def test_chunking_is_narrow_and_calls_python_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = plan_of(explode_chunks(semantic.semantic_chunks(docs), "chunks"))
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_partitioning_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {tuple(r) for r in explode_chunks(semantic.semantic_chunks(docs.coalesce(1)), "chunks").collect()}
    many = {tuple(r) for r in explode_chunks(semantic.semantic_chunks(docs.repartition(7)), "chunks").collect()}
    assert one == many


def test_units_without_words(spark):
    docs = spark.createDataFrame([(1, "a b. -- ! -- ! -- ! a b. c.")], "doc_id long, text string")
    contexts = semantic.unit_rows(docs)
    slow = {r.pos: r.distance for r in semantic.distances(semantic.word_counts(contexts), contexts).collect()}
    assert slow == {r.pos: r.distance for r in semantic.distance_rows(docs).collect()}
    assert slow[1] == 1.0


def test_a_null_text_has_no_distances(spark):
    rows = spark.createDataFrame([(1, "One two. Two three. Three."), (2, None)], "doc_id int, text string")
    assert {r.doc_id for r in semantic.distance_rows(rows).collect()} == {1}


def test_units_are_objects_of_few_documents_at_a_time():
    many = pa.array([["a"], None, []] * semantic.DOCS_AT_ONCE)
    parts = list(semantic.some_documents(iter([many])))
    assert [len(p) for p in parts] == [semantic.DOCS_AT_ONCE] * 3 and sum(parts, []) == many.to_pylist()
