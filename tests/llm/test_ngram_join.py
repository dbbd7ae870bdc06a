import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import ngram_join
from corpusloom.llm.components import _stars
from corpusloom.llm.ngram_join import _links, keys_of, needed, ngram_components, prefix_length
from corpusloom.session import materialize
from helpers import ascii_words, lower, prose


def shingles(text):
    words = ascii_words(lower(text))
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) > 3 else ({tuple(words)} if words else set())


def brute(rows):
    """Component names and set sizes by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), names.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def check(df, rows):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()) == brute(rows)


def test_awkward_rows(awkward, awkward_rows):
    check(awkward, [row[:2] for row in awkward_rows])


def test_empty_table(nothing):
    assert ngram_components(nothing).count() == 0


def family(rng, n, words, shares):
    base = prose(rng, words).split()
    return [" ".join(prose(rng, 1) if rng.random() < rng.choice(shares) else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_groups_around_the_threshold(spark, small, monkeypatch):
    """Copies on both sides of 0.85, texts that share a passage, frequent tokens of each class, small blocks and few pairs a task."""
    if small:
        for name, value in {"CLASSES": (2, 8), "BLOCK": 4, "HUB_PAIRS": 5, "SAMPLE": 2, "MERGE": 3, "HOT_SHARE": 400}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(4)
    passage = prose(rng, 40)
    texts = family(rng, 50, 140, [0.0, 0.01, 0.02, 0.04]) + family(rng, 25, 700, [0.005, 0.01, 0.02]) + family(rng, 20, 30, [0, 0.03])
    texts += [f"{prose(rng, rng.randint(20, 200))} {passage} {prose(rng, 5)}" for _ in range(40)]
    texts += [f"{passage} {prose(rng, k)}" for k in range(12)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


@pytest.mark.parametrize("kinds", [[1], [1, 2], [2], [3], [1, 2, 3]])
def test_linked_pairs_share_a_key(kinds):
    """Whatever the classes of the tokens, pairs at the threshold have a key in common; so have pairs of different size classes."""
    rng = np.random.default_rng(len(kinds) * 10 + kinds[0])
    for n in [1, 2, 6, 7, 20, 33, 55, 63, 64, 100, 127, 128, 300, 1000]:
        for shrink in (False, True):
            missing = n * 15 // 100
            tokens = np.unique(rng.integers(0, 2**64, n + 2 * missing, np.uint64))
            rng.shuffle(tokens)
            # 100 * (n - k) >= 85 * (n + k), or one side a subset of the other
            k = missing if shrink else max(k for k in range(n + 1) if 100 * (n - k) >= 85 * (n + k))
            left, right = np.sort(tokens[:n]), np.sort(tokens[k:n] if shrink else np.concatenate([tokens[k:n], tokens[n : n + k]]))
            kind_of = {int(t): int(rng.choice(kinds)) for t in tokens}
            keys = []
            for own, other in ((left, right), (right, left)):
                prefix = own[: prefix_length(len(own))].tolist()
                held = set(other[: prefix_length(len(other))].tolist())
                at = [i for i, t in enumerate(prefix) if t in held]
                keys.append(set(keys_of(len(own), at, [prefix[i] for i in at], [kind_of[prefix[i]] for i in at])))
            assert keys[0] & keys[1]


def test_prefixes_reach_the_misses():
    for n in range(1, 3000):
        assert needed(n) == n - -(-85 * n // 100) + 1
        assert needed(n) <= prefix_length(n) <= n


def test_tokens_of_others_make_no_key():
    assert keys_of(100, [], [], []) == []
    assert keys_of(100, [17], [5], [1]) == []  # sixteen tokens nobody has come first
    assert len(keys_of(100, [3], [5], [1])) == 1


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_plans_stay_small(spark, monkeypatch):
    """A query plans a dozen such steps; each table that a plan names again takes the driver's memory."""
    edges = materialize(spark.createDataFrame([(5, 1), (2, 5), (7, 7), (9, 8), (3, 1), (5, 1)], "a long, b long"), "t-edges")
    assert scans(_stars(edges)) <= 6
    assert sorted(map(tuple, _stars(edges).collect())) == [(2, 1), (3, 1), (5, 1), (9, 8)]
    sets = [(k, np.arange(k, k + 100, dtype=np.uint64).tobytes()) for k in range(0, 40, 4)]
    pairs = materialize(spark.createDataFrame([(a, b) for a, _ in sets for b, _ in sets if a > b], "a long, b long"), "t-pairs")
    table = materialize(spark.createDataFrame(sets, "node long, shingles binary"), "t-sets")
    want = [(a, b) for a in range(0, 40, 4) for b in range(0, a, 4) if 100 * (100 - a + b) >= 85 * (100 + a - b)]
    assert scans(_links(pairs, table)) <= 3 and sorted(map(tuple, _links(pairs, table).collect())) == want
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 2)
    assert sorted(map(tuple, _links(pairs, table).collect())) == want


@pytest.mark.parametrize("cut", [False, True])
def test_blocks_give_links_that_join_components(spark, cut, monkeypatch):
    """A group of copies that all link makes fewer rows than a block has components, not one for each pair and key."""
    if cut:
        monkeypatch.setattr(ngram_join, "BLOCK", 16)
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 1 << 11)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    texts = [np.unique(np.concatenate([base[:195], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(60)]
    texts += [np.unique(np.concatenate([base[:150], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))]  # links with none
    size = [len(t) for t in texts]
    sets = spark.createDataFrame([(k, t.tobytes()) for k, t in enumerate(texts)], "node long, shingles binary")
    own = spark.createDataFrame([(k, 5 if k < 60 else 0) for k in range(61)], "node long, own long")
    keys = spark.createDataFrame([(key, k, size[k]) for key in range(4) for k in range(61)], "key long, node long, size long")
    nobody = spark.createDataFrame([], "node long, label long")
    rows = ngram_join._open_rows(keys, nobody)
    short = [(k, ngram_join.NO_END, t.astype(np.uint16).tobytes()) for k, t in enumerate(texts)]
    prefixes = spark.createDataFrame(short, "node long, end long, prefix binary")
    found = [tuple(r) for r in ngram_join._joining(rows, prefixes, own, sets).collect()]
    graph = {k: {k} for k in range(61)}
    for a, b in found:
        both = graph[a] | graph[b]
        for k in both:
            graph[k] = both
    assert graph[0] == set(range(60)) and graph[60] == {60}
    assert len(found) <= (59 if not cut else 59 * 16) and len(found) < 60 * 59 // 2
