import hashlib
import re
from collections import Counter

import pytest

from corpusloom.llm.decontamination import Automaton, contamination, decontaminate, normal_words, with_spans
from helpers import lower

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = _WORDS.findall(lower(text))
        size = min(window, len(words))
        for k in range(len(words) - size + 1) if size else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    out = Counter()
    for doc_id, text in docs:
        words, hit, found = _WORDS.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                owners = windows.get(tuple(words[k : k + size]))
                if owners:
                    found |= owners
                    hit.update(range(k, k + size))
        names = ",".join(sorted(str(i) for i in found))
        out[doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def items(awkward_rows):
    texts = [row[1] for row in awkward_rows if row[1] and 60 < len(row[1].split()) < 170]
    cut = [" ".join(t.split()[k : k + n]) for k, (t, n) in enumerate(zip(texts, (30, 10, 9, 3, 12, 25, 1, 40, 11, 10), strict=False))]
    return [(k, t.upper() if k % 2 else t) for k, t in enumerate(cut)] + [(90, ""), (91, None), (92, "!?"), (93, cut[0]), (4, cut[4])]


@pytest.mark.parametrize("shard_words", [15, 100_000])
def test_matches_brute_force(spark, awkward, awkward_rows, items, shard_words):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([row[:2] for row in awkward_rows], items)
    if shard_words == 100_000:
        assert Counter(map(tuple, contamination(awkward, bench).collect())) == want
    found = with_spans(awkward, bench, shard_words=shard_words).collect()
    hits = Counter((r.doc_id, r["__n_words"], sum(b - a for a, b in r["__spans"]), len(r["__items"])) for r in found)
    few = Counter()
    for row, n in want.items():
        few[row[:4]] += n
    assert hits == few


def test_no_items_and_no_documents(spark, awkward, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(awkward, bench).where("contaminated").count() == 0
    assert contamination(nothing, bench).count() == 0


def test_spans_are_cut_and_covered_documents_dropped(spark):
    item = " ".join(f"w{k}" for k in range(12))
    clean = "nothing of it here,  as it was"
    rows = [(1, clean), (2, f"Before, {item.upper()}! after it " + "and more " * 12), (3, f"x {item}"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1] == clean and got[4] is None and got[5] == ""
    assert got[2].startswith("Before, ! after it and more") and "w3" not in got[2].lower()


def test_automaton_knows_longest_runs():
    words = [normal_words(t) for t in ("a b c d", "c d e f g", "b c")]
    automaton = Automaton([(str(k), w) for k, w in enumerate(words)], window=3)
    spans, found = automaton.scan(normal_words("x a b c e f g c d e"))
    assert spans == [(1, 10)] and found == {"0", "1", "2"}


def test_one_python_pass_cuts_and_drops(spark):
    """Each further pass in a stage takes another worker a task, and carries all texts once more."""
    passage = " ".join(f"item{k}" for k in range(10))
    docs = spark.createDataFrame([(1, f"a b c d e f g h i j k {passage} z"), (2, passage), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, "other words")], "item_id long, text string")
    for shard_words in (100_000, 2):
        cut = decontaminate(docs, items) if shard_words > 2 else with_spans(docs, items, shard_words=2, coverage=0.5)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        assert sorted(map(tuple, cut.collect())) == [(1, "a b c d e f g h i j k  z"), (3, None)]
