from collections import Counter

import pytest

from corpusloom.llm import substring_dedup
from corpusloom.llm.substring_dedup import without_repeats
from helpers import ascii_words

LAST = 2**63 - 1


def brute(rows, window=50):
    first, out = {}, Counter()
    for doc_id, text in rows:
        words = ascii_words(text)
        order = LAST if doc_id is None else doc_id
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, LAST), order)
    for doc_id, text in rows:
        words, gone = ascii_words(text), set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (LAST if doc_id is None else doc_id):
                gone.update(range(k, k + window))
        out[doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("group_docs, tree_words", [(5_000, 400_000), (2, 300), (0, 300)])
def test_matches_brute_force(awkward, awkward_rows, group_docs, tree_words, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_DOCS", group_docs)
    monkeypatch.setattr(substring_dedup, "TREE_WORDS", tree_words)
    assert Counter(map(tuple, without_repeats(awkward).collect())) == brute([row[:2] for row in awkward_rows])


def test_empty_table(nothing):
    assert without_repeats(nothing).count() == 0
