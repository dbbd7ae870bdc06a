"""Encoders and distances: equal words are handled once, and results are those of the plain definition."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from corpusloom.catalog.chunking import digit_encoder
from corpusloom.operators import semantic


def test_digit_encoder_hashes_a_word_once_a_batch(monkeypatch):
    texts = ["a b a", "", " b a \x1c c ", "c" * 50]
    plain = [Counter(int(hashlib.md5(w.encode()).hexdigest()[0], 16) for w in t.split()) for t in texts * 50]
    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda data: calls.append(data) or md5(data))
    vectors = digit_encoder()(pd.Series(texts * 50))
    assert len(calls) == 4
    assert [[c[k] for k in range(16)] for c in plain] == np.asarray(vectors).tolist()
    assert digit_encoder()(pd.Series([], dtype=object)).shape == (0, 16)


@pytest.mark.parametrize("kind", ["lists", "arrays", "matrix"])
def test_encode_batches_leaves_other_columns_in_arrow(spark, kind):
    def make_encoder():
        def encode(texts):
            rows = [[float(len(t)), 1.0] for t in texts]
            return {"lists": rows, "arrays": [np.array(r) for r in rows], "matrix": np.array(rows).reshape(-1, 2)}[kind]

        return encode

    rows = spark.createDataFrame([(1, "abc", None), (None, "x", 5), (1, "abc", None)], "k bigint, text string, n int")
    coded = semantic.encode_batches(rows, "text", make_encoder)
    assert "MapInArrow" in coded._jdf.queryExecution().toString()
    found = sorted(map(tuple, coded.collect()), key=str)
    assert found == sorted([(1, "abc", None, [3.0, 1.0]), (None, "x", 5, [1.0, 1.0]), (1, "abc", None, [3.0, 1.0])], key=str)


def plain_distances(units: list[str], radius: int) -> np.ndarray:
    own = [Counter(semantic._WORD.findall(u.lower())) for u in units]
    bags = []
    for i in range(len(own)):
        bag: Counter = Counter()
        for near in own[max(i - radius, 0):i + radius + 1]:
            bag.update(near)
        bags.append(bag)
    norms = [sum(n * n for n in b.values()) for b in bags]
    out = np.empty(max(len(bags) - 1, 0))
    for i in range(len(out)):
        dot = sum(n * bags[i + 1][w] for w, n in bags[i].items() if w in bags[i + 1])
        out[i] = 1 - dot / np.sqrt(norms[i] * float(norms[i + 1])) if norms[i] and norms[i + 1] else 1.0
    return np.round(out, semantic.DIGITS)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bag_distances_equal_the_plain_definition(radius):
    rng = random.Random(radius)
    for _ in range(200):
        units = [" ".join(rng.choice("abcdeF") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 9))]
        assert np.array_equal(semantic.bag_distances(units, radius), plain_distances(units, radius))


def test_bag_distances_count_each_unit_once():
    """Bags of neighbours are not counted word by word: clearly less time than the plain definition takes."""
    rng = random.Random(5)
    units = [" ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(20)) for _ in range(3000)]

    def seconds(work) -> float:
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            work()
            best = min(best, time.process_time() - began)
        return best

    assert seconds(lambda: semantic.bag_distances(units)) < 0.7 * seconds(lambda: plain_distances(units, 1))
