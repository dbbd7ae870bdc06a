from array import array

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.merge_dropout import MODEL, Encoder, Vocabulary, decode, encode


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def test_without_dropout_as_the_library(vocabulary, awkward_rows):
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(vocabulary, dropout=0)
    for row in awkward_rows:
        if row[1] and "▁" not in row[1]:
            assert np.frombuffer(encoder.encode(row[1]), np.int32).tolist() == model.encode(row[1])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aeinst"))))
def test_round_trip(text):
    encoder = Encoder(VOCABULARY, dropout=0.4)
    assert encoder.decode(encoder.encode(text)) == text


VOCABULARY = Vocabulary.load()


def test_merging_together_is_merging_alone(vocabulary, awkward_rows):
    encoder = Encoder(vocabulary, dropout=0.3)
    encoder.encode_all([row[1] or "" for row in awkward_rows])
    for variant, known in enumerate(encoder.known):
        for segment, ids in known.items():
            codes = np.array([ord(c) for c in segment], np.uint32)
            key = int(encoder.keys(codes, np.array([len(codes)]), variant)[0])
            assert array("i", encoder.merge(segment, key)).tobytes() == ids


def test_seed_and_place_vary_segmentations(vocabulary):
    text = "international considerations\n" * 40
    encoder = Encoder(vocabulary, dropout=0.3)
    ids = encoder.encode(text)
    assert ids == Encoder(vocabulary, dropout=0.3).encode(text) != Encoder(vocabulary, dropout=0.3, seed=9).encode(text)
    assert len({encoder.known[v].get(" considerations") for v in range(encoder.variants)}) > 1


def test_forgetting_changes_nothing(vocabulary, awkward_rows, monkeypatch):
    texts = [row[1] or "" for row in awkward_rows]
    whole = Encoder(vocabulary).encode_all(texts)
    monkeypatch.setattr("corpusloom.llm.merge_dropout._KNOWN_SEGMENTS", 50)
    small = Encoder(vocabulary)
    assert [small.encode(t) for t in texts] == whole


def test_rows(awkward, awkward_rows, nothing):
    encoded = encode(awkward)
    rows = encoded.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) // 4 for r in rows)
    got = sorted((r.doc_id or -1, r.text) for r in decode(encoded).collect())
    assert got == sorted((row[0] or -1, row[1] or "") for row in awkward_rows)
    assert encode(nothing).count() == 0


def test_workers_forget_segments(spark):
    """What a task has encoded does not stay in a worker that waits or does other work."""
    rows = spark.createDataFrame([(i, f"word{i} again and again") for i in range(200)], "doc_id long, text string").repartition(4)
    assert encode(rows).where("lossless").count() == 200

    def held(batches):
        import pyarrow as pa

        from corpusloom.llm import merge_dropout

        for _ in batches:
            pass
        known = [sum(map(len, encoder.known)) for encoder in merge_dropout._encoders.values()]
        yield pa.RecordBatch.from_arrays([pa.array([len(known)]), pa.array([sum(known)])], names=["encoders", "segments"])

    found = spark.range(0, 64, 1, 8).mapInArrow(held, "encoders long, segments long").collect()
    assert any(r.encoders for r in found) and not any(r.segments for r in found)
