import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical_search
from corpusloom.llm.lexical_search import Best, FpTree, search, term_counts
from helpers import lower, prose

ITEMS = "item_id long, text string, score string, rank int"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in rows]
    n_docs, words = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counted:
            m = 10 + (90 * c.total() * n_docs) // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted((tuple(r) for r in search(docs, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def items(awkward_rows):
    rng = random.Random(8)
    texts = [r[1] for r in awkward_rows if r[1] and len(r[1]) < 2_000]
    return [(k, " ".join(rng.sample(rng.choice(texts).split() or ["x"], 1) + rng.choice(texts).split()[:25])) for k in range(30)] + [
        (40, None), (41, ""), (42, "UNKNOWNWORD"), (43, "a B c"), (43, "d É"), (None, "one two"), (44, "\U0001f600 é 49"),
    ]


@pytest.mark.parametrize("block_terms", [4096, 40])
def test_same_as_scoring_every_document(awkward, awkward_rows, items, spark, block_terms, monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 64)
    bench = spark.createDataFrame([(*x, "s", 1) for x in items], ITEMS)
    assert got(awkward, bench, block_terms=block_terms) == brute([r[:2] for r in awkward_rows], items)


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(90)] + [(None, "same words here"), (5, "same words here")], "doc_id long, text string")
    rows = search(docs.repartition(6), spark.createDataFrame([(1, "words", "", 0)], ITEMS)).collect()
    assert sorted((r.rank, r.doc_id) for r in rows) == list(enumerate([0, 1, 2, 3, 4, 5, 5, 6, 7, 8], 1))


def test_no_documents_and_no_items(nothing, awkward, spark):
    one = spark.createDataFrame([(1, "a b", "", 0)], ITEMS)
    assert search(nothing, one).count() == 0
    assert search(awkward, one.limit(0)).count() == 0


def test_pieces_do_not_cut_terms(monkeypatch):
    text = "abc é12 " * 50 + "x" * 500
    whole = term_counts(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(lexical_search, "PIECE", piece)
        assert term_counts(text) == whole


def test_tree_skips_what_cannot_rank():
    """Every document is below the root once; good documents are found though most are never scored."""
    rng = random.Random(3)
    n, width = 3000, 200
    topics = [rng.sample(range(width), 40) for _ in range(60)]
    paths = [np.array(sorted(rng.sample(topics[k % 60], 25))) for k in range(n)]
    counts = [np.array([rng.randint(1, 4) for _ in p], np.int32) for p in paths]
    m = np.array([rng.randint(40, 300) for _ in range(n)])
    tree = FpTree(np.arange(n), np.zeros(n, bool), m, paths, counts, width)
    leaves = sorted((a, b) for a, b, kids in zip(tree.low, tree.high, tree.children, strict=True) if kids is None)
    assert [a for a, _ in leaves] == [0, *(b for _, b in leaves[:-1])] and leaves[-1][1] == n
    assert all(b - a <= lexical_search.LEAF for a, b in leaves)
    scored = 0
    for _ in range(20):
        terms = rng.choice(paths)[::2]
        weights = 1000 + 40 * terms
        best = Best(10)
        scored += tree.search(terms, weights, best)
        all_scores = (lexical_search._gains(tree.tf[:, terms], tree.m) * weights).sum(1)
        order = np.lexsort((tree.ids, -all_scores))[:10]
        assert best.scores.tolist() == all_scores[order].tolist() and best.ids.tolist() == tree.ids[order].tolist()
    assert scored < 20 * n * 0.6


def test_prose_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(400)]
    items = [(k, prose(rng, 30)) for k in range(20)]
    bench = spark.createDataFrame([(*x, "s", 1) for x in items], ITEMS)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench, top=4) == brute(rows, items, 4)
