"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton, in which every run of item words is a path. The
words of a document are streamed through it; at each word the automaton knows the longest run of item words
that ends there. Runs of ``window`` words or more (or a whole item that is shorter) are hits.

The automaton is built from shards of at most ``SHARD_WORDS`` item words and sent to the tasks; further shards
take further passes over the documents, so memory stays bounded whatever the size of the test set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, ROWS_AT_ONCE, give_back, text_of
from corpusloom.session import materialize

WINDOW = 10
#: Words of one automaton (about 1 kB of memory each in a task); longer tests take several passes.
SHARD_WORDS = 100_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all other code points from U+0080."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


class Automaton:
    """Suffix automaton of several word sequences; ``items`` are the ids that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for _, words in items:
            codes = [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words]
            coded.append(codes)
            last = 0
            for code in codes:
                last = self._extend(last, code)
        #: state whose path is a window's words (or a whole short item) -> items
        self.owners: dict[int, set[str]] = {}
        #: lengths of the windows that end in a state of ``owners``
        self.sizes: dict[int, int] = {}
        for (item, _), codes in zip(items, coded, strict=True):
            size = min(window, len(codes))
            state = run = 0
            for code in codes:
                state, run = self.step(state, run, code)
                if size and run >= size:
                    at = self.cut(state, size)
                    self.owners.setdefault(at, set()).add(item)
                    self.sizes[at] = size
        #: for each state, the states of ``owners`` that are suffixes of it, longest first
        self.ends: list[tuple[int, ...]] = [()] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            up = self.ends[self.link[state]] if state else ()
            self.ends[state] = (state, *up) if state in self.owners else up
        self.shortest = min(self.sizes.values(), default=0)

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, code, known)
        state = self._add(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at != -1:
            target = self.next[at][code]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._clone(at, code, target)
        return state

    def _add(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, at: int, code: int, target: int) -> int:
        clone = self._add(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while at != -1 and self.next[at].get(code) == target:
            self.next[at][code] = clone
            at = self.link[at]
        return clone

    def step(self, state: int, run: int, code: int) -> tuple[int, int]:
        """Longest suffix of the words so far that is a run of item words."""
        while state and code not in self.next[state]:
            state = self.link[state]
            run = self.length[state]
        following = self.next[state].get(code)
        return (0, 0) if following is None else (following, run + 1)

    def cut(self, state: int, size: int) -> int:
        """State of the last ``size`` words of a longer run."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word positions (end exclusive, in order, merged) and the items that were found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        steps, links, lengths, ends = self.next, self.link, self.length, self.ends
        shortest = self.shortest
        if not shortest:
            return [], set()
        state = run = 0
        for at, code in enumerate(map(self.vocabulary.get, words)):
            if code is None:
                state = run = 0
                continue
            following = steps[state].get(code)
            if following is None:
                while state and code not in steps[state]:
                    state = links[state]
                    run = lengths[state]
                following = steps[state].get(code, 0)
                if not following:
                    state = run = 0
                    continue
            state = following
            run += 1
            if run < shortest:
                continue
            fits = [owner for owner in ends[state] if self.sizes[owner] <= run]
            if fits:
                found.update(fits)
                start = at + 1 - self.sizes[fits[0]]
                if spans and start <= spans[-1][1]:
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, set().union(*(self.owners[state] for state in found)) if found else set()


def item_shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Normalised items in shards of about ``shard_words`` words at most; an item is never split.

    Spark adds up the sizes first; a shard is what the driver holds at once.
    """
    source = items.select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // (2 * shard_words)))  # a word has two bytes at least, with what separates it
    for shard in range(n):
        part = source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == shard)
        yield [(row["item_id"], normal_words(row["text"])) for row in part.toLocalIterator()]


_FOUND = "__n_words bigint, __spans array<struct<start: int, stop: int>>, __items array<string>"


def with_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, coverage: float | None = None
) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` and ``__items``.

    Spans are word positions, end exclusive, in order and disjoint; items are the sorted ids (as strings) with an
    occurring window. Null and empty texts have no words. Items without words match nothing; an item whose id is
    null is found but not named. Repeated rows and items change nothing; other columns pass through unread.
    With ``coverage`` the last pass also cuts the spans (see :func:`decontaminate`) and gives the columns of ``docs`` alone.
    """
    state = docs.withColumns({
        "__n_words": F.lit(0).cast("long"),
        "__spans": F.expr("cast(array() as array<struct<start: int, stop: int>>)"),
        "__items": F.expr("cast(array() as array<string>)"),
    })
    text_at, shards = state.columns.index("text"), item_shards(items, shard_words)
    shard = next(shards)  # there is always one
    while shard is not None:
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))
        shard = next(shards, None)
        if shard is not None:
            state = materialize(state.mapInArrow(_scanner(automaton, text_at), state.schema), "decontamination")
    if coverage is None:
        return state.mapInArrow(_scanner(automaton, text_at), state.schema)
    return state.mapInArrow(_scanner(automaton, text_at, coverage), docs.schema)


def _scanner(automaton, text_at: int, coverage: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton.value.scan
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                spans, items = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                counts = []
                for at, text in enumerate(part.column(text_at)):
                    words = normal_words(text.as_py() or "")
                    counts.append(len(words))
                    hits, found = scan(words)
                    if hits:
                        before = [(s["start"], s["stop"]) for s in spans[at]]
                        spans[at] = [{"start": a, "stop": b} for a, b in _merged(before + hits)]
                        items[at] = sorted({*items[at], *(x for x in found if x is not None)})
                if coverage is not None:
                    yield _cut(part, text_at, counts, spans, coverage)
                    continue
                schema = part.schema
                new = [pa.array(v, f.type) for v, f in zip((counts, spans, items), list(schema)[-3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *new], schema=schema)
        give_back()

    return run


def _cut(part: pa.RecordBatch, text_at: int, counts: list[int], spans: list[list[dict]], coverage: float) -> pa.RecordBatch:
    """Rows without the last three columns and their spans; those with too many words in spans are left out."""
    columns, names = part.columns[:-3], part.schema.names[:-3]
    found = [[(s["start"], s["stop"]) for s in row] for row in spans]
    if not any(found):
        return pa.RecordBatch.from_arrays(columns, names=names)
    stay = [sum(b - a for a, b in pairs) <= coverage * n for pairs, n in zip(found, counts, strict=True)]
    texts = columns[text_at].to_pylist()
    texts = [without_spans(t, pairs) if pairs and s else t for t, pairs, s in zip(texts, found, stay, strict=True)]
    columns[text_at] = pa.array(texts, part.schema.field(text_at).type)
    return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay, pa.bool_()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs``."""
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]))
    return with_spans(docs.select("doc_id", "text"), items, window).select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the given word spans; what stands between two removed words goes with them."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data.translate(LOWER))]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at : places[start][0]])
        at = places[stop - 1][1]
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; documents with more than ``coverage`` of their words hit are dropped.

    Columns, their order and all other values are those of ``docs``. Clean documents come back unchanged.
    """
    return with_spans(docs, items, window, coverage=coverage)
