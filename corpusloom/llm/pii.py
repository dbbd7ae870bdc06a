"""Personal data by weak supervision, on SQL functions alone.

Strict patterns give the base spans. Looser patterns add candidates (written-out addresses, numbers without a country code, ...).
Labelers vote on every candidate: the strict pattern, a check of the digits, gazetteers of endings and issuers, the words
before it, and what it touches. Expectation-maximisation over the counts of vote patterns (a table of bounded size) estimates how
reliable each labeler is; its posteriors train a naive Bayes classifier of spans by their form and surroundings, which decides
on the candidates. Base spans always stay.

Positions come from marking matches in the text and adding up the lengths of the pieces. The patterns are possessive, so that
long runs of one kind of character neither overflow the matcher's stack nor are tried again from every position.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.llm.common import text_of
from corpusloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 8
THRESHOLD = 0.5
#: Characters before a candidate in which the context labeler looks.
REACH = 24
#: Pieces of a text that are folded at once; even.
BLOCK = 512

_LOCAL = "[A-Za-z0-9._%+-]"
_STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits or nothing: runs of another length fail anyway and need not be looked at one by one.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ -])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Gazetteers and trigger words.
_ENDINGS = r"(?i)[.\])] ?(com|org|net|edu|gov|info|io|de|fr|es|eu|uk)$"
_TRIGGERS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|from|adresse)\b",
    "card": r"(?i)\b(card|visa|credit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|telefon|téléphone|teléfono|ruf)\b",
}
_AGAINST = r"(?i)(\b(version|release|isbn|issn|section|page|no|nr)\b|[=#/\"'])[^a-z0-9]*$"

_FOUND = "array<struct<start: int, stop: int, value: string, before: string, after: string>>"
LABELERS = ("strict", "digits", "gazetteer", "context", "edges")
FEATURES = ("form", "size", "before", "after")
#: No value of a feature is this word: letters of a form are written as one a.
RARE = "rare"


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with positions in code points and what is around; the text must be free of U+0001.

    Pieces are folded a block at a time and blocks are moved to their places at the end, as a fold over all of them would copy the
    matches found so far at each match.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0001")), "\u0001", -1)
    none = F.expr(f"cast(array() as {_FOUND})")

    def with_next(pieces: Column) -> Column:
        first = lambda i: F.substring(F.coalesce(F.get(pieces, i), F.lit("")), 1, 1)
        return F.transform(pieces, lambda p, i: F.struct(
            p.alias("value"), F.when(first(i + 1) != "", first(i + 1)).otherwise(first(i + 2)).alias("after")
        ))

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece["value"])
        here = F.struct(
            state["at"].alias("start"), stop.alias("stop"), piece["value"].alias("value"), state["tail"].alias("before"), piece["after"].alias("after")
        )
        return F.struct(
            stop.alias("at"), (~state["match"]).alias("match"), F.right(F.concat(state["tail"], piece["value"]), F.lit(REACH)).alias("tail"),
            F.when(state["match"], F.concat(state["found"], F.array(here))).otherwise(state["found"]).alias("found"),
        )

    def moved(block: Column, at: Column) -> Column:
        return F.transform(block["found"], lambda m: m.withField("start", m["start"] + at).withField("stop", m["stop"] + at))

    # Every second piece is a match and so not empty: blocks of an even number of pieces begin outside of one, and twice as many
    # pieces as a context has characters hold the context.
    def blocks(pieces: Column) -> Column:
        def fold(k: Column) -> Column:
            earlier = F.least(k - 1, F.lit(2 * REACH))
            tail = F.right(F.array_join(F.transform(F.slice(pieces, k - earlier, earlier), lambda p: p["value"]), ""), F.lit(REACH))
            start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), tail.alias("tail"), none.alias("found"))
            return F.aggregate(F.slice(pieces, k, F.lit(BLOCK)), start, step)

        return F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), fold)

    def placed(folded: Column) -> Column:
        places = F.aggregate(folded, F.array(F.lit(0)), lambda at, b: F.array_append(at, F.element_at(at, -1) + b["at"]))
        return F.flatten(F.zip_with(folded, F.slice(places, F.lit(1), F.size(folded)), moved))

    return let(let(parts, with_next), lambda pieces: let(blocks(pieces), placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(
        F.split(digits, ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a strict match must satisfy besides its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(value, r"\."), lambda p: small(p) & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(value))
    return n.between(16, 19) & _luhn(value) if kind == "card" else n.between(8, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _candidate(kind: str, strict: bool, m: Column) -> Column:
    value, digits = m["value"], _digits(m["value"])
    n = F.length(digits)
    before, right = m["before"], m["after"]
    left = F.right(before, F.lit(1))
    word = "^[\\p{L}\\p{N}]$"
    gazetteer = {
        "email": _vote(value.rlike(_ENDINGS), F.lit(False)),
        "ip": _vote(F.lit(False), value.rlike(r"^(0|127|255)\.")),
        "card": _vote(digits.rlike("^[3-6]"), digits.rlike("^[0789]")),
        "phone": _vote(value.rlike(r"^\+(1|33|34|44|49)\b"), value.rlike(r"^\+0")),
    }[kind]
    checks = {
        "email": F.lit(-1), "ip": _vote(F.lit(strict), F.lit(False)),
        "card": F.when(_luhn(value), 1).otherwise(0), "phone": _vote(n.between(10, 13), (n < 8) | (n > 15)),
    }[kind]
    form = F.regexp_replace(F.regexp_replace(value, "[\\p{L}]+", "a"), "[0-9]+", "0")
    return F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.lit(strict).alias("base"),
        F.struct(
            F.lit(int(strict)).alias("strict"), checks.cast("int").alias("digits"), gazetteer.alias("gazetteer"),
            _vote(before.rlike(_TRIGGERS[kind]), before.rlike(_AGAINST)).alias("context"),
            F.when(left.rlike(word) | right.rlike(word), 0).otherwise(1).alias("edges"),
        ).alias("votes"),
        F.struct(
            F.when(F.length(form) <= 12, form).otherwise("long").alias("form"),
            F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string").alias("size"),
            _shape(left).alias("before"), _shape(right).alias("after"),
        ).alias("features"),
    )


def _shape(char: Column) -> Column:
    return F.when(char == "", "edge").when(char.rlike("\\s"), "blank").when(char.rlike("[\\p{L}]"), "letter").when(
        char.rlike("[0-9]"), "digit"
    ).otherwise("mark")


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: base spans and candidates that touch no base span, in one row for each row of ``docs``."""
    # U+0001 marks matches; in a text it stands outside every pattern, as U+0002 does, which takes its place.
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(text_of(), "\u0001", "\u0002").alias("text"))
    text = F.col("text")
    needs = {
        "email": (text.contains("@"), text.contains("at)") | text.contains("at]")), "phone": (text.contains("+"), text.rlike("[0-9]{3}")),
        "ip": (text.rlike("[0-9]\\.[0-9]"), text.contains(":")), "card": (text.rlike("[0-9][ -]?[0-9]"), text.rlike("[0-9]{4}")),
    }
    none = F.expr(f"cast(array() as {_FOUND})")

    def valid(kind: str) -> Column:
        return F.filter(_matches(text, _STRICT[kind]), lambda m: _holds(kind, m["value"]))

    def spans(column: Column, kind: str, strict: bool) -> Column:
        return F.transform(column, lambda m: _candidate(kind, strict, m))

    def free(m: Column) -> Column:
        return ~F.exists(F.col("taken"), lambda t: (m["start"] < t["stop"]) & (t["start"] < m["stop"]))

    for kind in KINDS:
        strict, loose = needs[kind]
        df = df.withColumn(f"strict_{kind}", F.when(strict, valid(kind)).otherwise(none))
        df = df.withColumn(f"loose_{kind}", F.when(loose, _matches(text, _LOOSE[kind])).otherwise(none))
    base = F.concat(*(spans(F.col(f"strict_{k}"), k, True) for k in KINDS))
    taken = F.concat(*(F.col(f"strict_{k}") for k in KINDS))
    more = F.concat(*(spans(F.filter(F.col(f"loose_{k}"), free), k, False) for k in KINDS))
    return df.withColumn("taken", taken).select("doc_id", F.concat(base, more).alias("found"))


def _log_odds(votes: Column, model: dict) -> Column:
    """Evidence of the votes; an abstention says nothing."""
    parts = [
        F.when(votes[name] == 1, math.log(a / b)).when(votes[name] == 0, math.log((1 - a) / (1 - b))).otherwise(0.0)
        for name, (a, b) in model["labelers"].items()
    ]
    return reduce(lambda x, y: x + y, parts, F.lit(model["prior"]))


def _posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over ``(votes, n)``; ``labelers`` holds P(vote 1 | personal) and P(vote 1 | not), ``prior`` the log odds."""
    model = {"prior": 0.0, "labelers": {name: (0.8, 0.2) for name in LABELERS}}
    for _ in range(rounds):
        p = _posterior(_log_odds(F.col("votes"), model))
        sums = [F.sum(p * F.col("n")).alias("yes"), F.sum((1 - p) * F.col("n")).alias("no")]
        for name in LABELERS:
            vote = F.col("votes")[name]
            for side, weight in (("yes", p), ("no", 1 - p)):
                sums.append(F.sum(F.when(vote == 1, weight * F.col("n")).otherwise(0.0)).alias(f"{name}_{side}"))
                sums.append(F.sum(F.when(vote >= 0, weight * F.col("n")).otherwise(0.0)).alias(f"{name}_{side}_all"))
        row = patterns.agg(*sums).first()
        if row["yes"] is None:
            return model
        model = {"prior": math.log((row["yes"] + 1) / (row["no"] + 1)), "labelers": {
            name: tuple((row[f"{name}_{s}"] + w) / (row[f"{name}_{s}_all"] + 1) for s, w in (("yes", 0.8), ("no", 0.2)))
            for name in LABELERS
        }}
    return model


def span_classifier(features: DataFrame) -> tuple[float, dict[str, dict[str, float]]]:
    """Naive Bayes on ``(kind, features, p)``: prior log odds, and the log ratio of each kind and, within its kind, of each value.

    Values that do not make up a thousandth of the spans of their kind count as one, ``RARE``: a kind has at most 1,001 values of a
    feature, whatever the corpus and however few its spans are. Each ratio has one span more, split as the kind or value is split
    over all, so a kind of which nothing is doubted keeps its rare values.
    """
    sums = (F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    kinds = {row["kind"]: (row["yes"], row["no"]) for row in features.groupBy("kind").agg(*sums).collect()}
    if not kinds:
        return 0.0, {}
    yes, no = (sum(side) for side in zip(*kinds.values(), strict=True))
    pairs = features.select("kind", "p", F.explode(F.array(*(
        F.struct(F.lit(name).alias("name"), F.col("features")[name].alias("value")) for name in FEATURES
    ))).alias("f"))
    least = F.create_map(*(F.lit(x) for kind, both in sorted(kinds.items()) for x in (kind, sum(both) / 1000)))
    counted = pairs.groupBy("kind", "f.name", "f.value").agg(*sums).withColumn(
        "value", F.when(F.col("yes") + F.col("no") >= least[F.col("kind")], F.col("value")).otherwise(RARE)
    ).groupBy("kind", "name", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))

    def ratio(part: tuple[float, float], of: tuple[float, float]) -> float:
        share = sum(part) / sum(of)
        return math.log((part[0] + share) / (of[0] + 1) / ((part[1] + share) / (of[1] + 1)))

    table: dict[str, dict[str, float]] = {"kind": {kind: ratio(both, (yes, no)) for kind, both in kinds.items()}}
    table |= {name: {} for name in FEATURES}
    for row in counted.collect():
        table[row["name"]][f"{row['kind']} {row['value']}"] = ratio((row["yes"], row["no"]), kinds[row["kind"]])
    return math.log((yes + 1) / (no + 1)), table


def _score(span: Column, classifier: tuple[float, dict[str, dict[str, float]]]) -> Column:
    prior, table = classifier
    parts = []
    for name, values in table.items():
        pairs = F.create_map(*(F.lit(x) for item in sorted(values.items()) for x in item))
        if name == "kind":
            parts.append(F.coalesce(pairs[span["kind"]], F.lit(0.0)))
        else:
            value, rare = (F.concat_ws(" ", span["kind"], x) for x in (span["features"][name], F.lit(RARE)))
            parts.append(F.coalesce(pairs[value], pairs[rare], F.lit(0.0)))
    return reduce(lambda x, y: x + y, parts, F.lit(prior))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs``: an array of ``(kind, start, stop, base)``, by kind and start.

    Null texts count as empty and have no spans. Repeated rows give repeated rows; other columns are not read. Without candidates
    beyond the base, or on an empty table, the result is the base.
    """
    found = materialize(candidates(docs), "candidates")
    spans = found.select(F.explode(F.filter("found", lambda s: s.isNotNull())).alias("s")).select("s.*")
    patterns = spans.groupBy("votes").agg(F.count("*").alias("n"))
    model = reliabilities(materialize(patterns, "votes"))
    classifier = span_classifier(spans.select("kind", "features", _posterior(_log_odds(F.col("votes"), model)).alias("p")))
    kept = F.filter("found", lambda s: s["base"] | (_posterior(_score(s, classifier)) >= threshold))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(
        rank(s).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["base"].alias("base")
    )))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["stop"], s["base"])).alias("spans"))


def digest_columns(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of :func:`personal_data`."""
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    ), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
