import hashlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import exact_dedup
from corpusloom.llm.exact_dedup import drop_exact_copies, exact_groups


@pytest.mark.parametrize("salts", [1, 3])
def test_groups_match_brute_force(awkward, awkward_rows, salts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LOCAL_ROWS", 4)
    groups = defaultdict(list)
    for row in awkward_rows:
        groups[row[1] or ""].append(row[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_groups(awkward, salts).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_kept_rows_keep_their_columns(awkward, awkward_rows):
    kept = drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted({row[1] or "" for row in awkward_rows})


def test_empty_table(nothing):
    assert exact_groups(nothing).count() == 0
    assert drop_exact_copies(nothing).count() == 0
