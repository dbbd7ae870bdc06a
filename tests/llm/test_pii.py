import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.pii import KINDS, LABELERS, _score, candidates, digest_columns, personal_data, reliabilities, span_classifier

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group())]


TEXTS = [
    "1.2.3.4.5.6.7.8 x", "a@b.c%d@e.f.g @x a@b", "9" * 3000 + " 4465758382889437 4465 7583-8288 9437", "+1 (523) 555-1055.",
    "000000255.1.1.0 256.1.1.1", "\U0001f600 é foo@bar.com\x01 a@b.c", "a" * 20_000 + " " + "1." * 3000, "", None,
    "+1 2 3 4 5 6 7 8 9 10 11 12 13 14", "1.1.1.1.1", "12345678901234567890123", "+12(", "1-1-1 1--1", "x@y.z@u.v w@-.-", "\x01\x02a@b.cc",
    "call (523) 555-1055 or mail me (at) bar.com, 3782 822463 10005, 2001:0db8:0000:0000:0000:0000:0000:0001",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, spans int")
    for row in digest_columns(personal_data(docs)).collect():
        want = brute([*TEXTS, TEXTS[0]][row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), row.doc_id
        assert [row[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS]
        assert set(want) <= set(row.spans.split(",")) | {""}


def test_awkward_and_empty(awkward, awkward_rows, nothing):
    got = Counter((r.doc_id, r.n_email, r.n_phone) for r in digest_columns(personal_data(awkward)).collect())
    assert got == Counter((row[0], *(sum(x.startswith(k) for x in brute(row[1])) for k in ("email", "phone"))) for row in awkward_rows)
    assert personal_data(nothing).count() == 0


def test_loose_spans_are_added_where_forms_and_votes_speak_for_them(spark):
    good = [(k, f"please call +1 (523) 555-10{k:02d} or phone (523) 555-20{k:02d} now") for k in range(60)]
    bad = [(100 + k, f'key="523-555-10{k:02d}x" page=123.456.78{k:02d}9') for k in range(30)]
    rows = digest_columns(personal_data(spark.createDataFrame(good + bad, "doc_id long, text string"))).collect()
    assert all(len(r.spans.split(",")) == 2 for r in rows if r.doc_id < 100)
    assert all(r.spans == "" for r in rows if r.doc_id >= 100)


@pytest.mark.parametrize("common", [0.95, 0.05])
def test_a_rare_kind_is_judged_by_its_own_forms(spark, common):
    features = "named_struct('form', {}, 'size', '3', 'before', '{}', 'after', 'blank') as features"
    many = spark.range(40_000).selectExpr("'phone' as kind", features.format("'0-0'", "blank"), f"double({common}) as p")
    few = [spark.range(20).selectExpr("'email' as kind", features.format(form, before), f"double({p}) as p")
           for form, before, p in (("'a (at) a.a'", "blank", 0.95), ("'a(at)a a'", "mark", 0.05))]
    # Each of these forms occurs once in 40,000 spans of its kind.
    rare = spark.range(20).selectExpr("'phone' as kind", features.format("concat('0', repeat('.', int(id)))", "blank"), f"double({1 - common}) as p")
    spans = many.unionByName(few[0]).unionByName(few[1]).unionByName(rare)
    score = _score(F.struct("kind", "features"), span_classifier(spans))
    got = {(r.kind, r.p): r.score for r in spans.select("kind", "p", score.alias("score")).distinct().collect()}
    assert got["email", 0.95] > 0 > got["email", 0.05]
    assert (got["phone", common] > 0) == (common > 0.5) and (got["phone", 1 - common] > 0) == (common < 0.5)


def test_reliabilities_find_the_good_labelers(spark):
    names = list(LABELERS)
    rows = []
    for true, n in ((1, 400), (0, 600)):
        for k in range(n):
            rows.append(([true if (k + j) % 10 else 1 - true for j in range(3)] + [k % 2, true if k % 3 else -1], 1))
    struct = "struct<" + ", ".join(f"{name}: int" for name in names) + ">"
    patterns = spark.createDataFrame([(tuple(v), n) for v, n in rows], f"votes {struct}, n int").groupBy("votes").agg({"n": "sum"})
    model = reliabilities(patterns.withColumnRenamed("sum(n)", "n"))["labelers"]
    for name in (*names[:3], names[4]):
        assert model[name][0] > 0.85 and model[name][1] < 0.15
    assert model[names[3]] == pytest.approx((0.5, 0.5), abs=0.05)


def test_many_matches_in_one_text_keep_their_places_and_surroundings(spark):
    """Far more matches than are folded at once, also of matches that touch each other."""
    email, ip = "é a@b.co ", "1.2.3.4"
    text = email * 2_000 + "x" + (ip + "5 ") * 900 + " ".join(str(n) for n in range(10, 9_000))
    found = candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    emails = [(s.start, s.stop, s.features.before, s.features.after) for s in found if s.kind == "email"]
    assert emails == [(9 * k + 2, 9 * k + 8, "blank", "blank") for k in range(2_000)]
    at = 9 * 2_000 + 1
    assert [(s.start, s.stop) for s in found if s.kind == "ip"] == [(at + 9 * k, at + 9 * k + 8) for k in range(900)]
    assert all(text[s.stop - 1].isalnum() for s in found)
