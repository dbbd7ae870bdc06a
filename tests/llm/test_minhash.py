import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import minhash
from corpusloom.llm.components import components
from corpusloom.llm.minhash import drop_near_duplicates, near_duplicates, shingle_set, signature
from helpers import ascii_words, lower, prose


def brute(rows):
    """Component names and set sizes by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = ascii_words(lower(text))
        sets.append({tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) > 3 else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), names.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def check(df, rows):
    want = Counter((d, n, c, d == c) for d, n, c in brute(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()) == want


def test_awkward_rows(awkward, awkward_rows):
    check(awkward, [row[:2] for row in awkward_rows])


@pytest.mark.parametrize("block", [8, 1024])
def test_group_around_the_threshold(spark, block, monkeypatch):
    """Copies of one text whose similarities lie on both sides of 0.8, in blocks smaller than their buckets."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(2)
    words = prose(rng, 120).split()
    rows = []
    for i in range(60):
        share = rng.choice([0.01, 0.03, 0.05, 0.06])
        rows.append((i, " ".join(prose(rng, 1) if rng.random() < share else w for w in words)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_one_of_each_group_stays(awkward):
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    names = {r.component_id for r in near_duplicates(awkward).collect()}
    assert {r.doc_id for r in kept.collect()} == names


def test_empty_table(nothing):
    assert near_duplicates(nothing).count() == 0


def test_signature_agreement_estimates_similarity():
    a, b = shingle_set(" ".join(map(str, range(1000)))), shingle_set(" ".join(map(str, range(100, 1100))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a, 1024) == signature(b, 1024)).mean() - true) < 0.06


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (1, 0)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
