"""Removal of passages of ``WINDOW`` words or more that start in an earlier document too: prefix-partitioned suffix trees.

1. Sieve. Of the prefixes (runs of ``PREFIX`` words) in a window, the one with the least hash stands for it, so equal windows
   are stood for by equal prefixes. Only windows whose prefix occurs in several documents can repeat. Documents that repeat a
   whole word sequence are represented by their earliest.
2. The suffixes that are left are dealt out by that prefix. A prefix with suffixes in more than ``GROUP_DOCS`` documents is lengthened
   to the whole window, where a node of the tree is its digest and is reduced by partial minima, so no group outgrows a task.
3. A task sorts the suffixes of a few prefixes at a time by prefix doubling. Suffixes that agree in ``WINDOW`` words are the
   deep internal nodes; each knows the earliest document below it. Neighbouring windows that start in an earlier document make
   up maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, scramble, text_of, word_hashes
from corpusloom.session import materialize

WINDOW = 50
PREFIX = 10
#: Documents with one prefix whose suffixes a task holds; a more frequent prefix is lengthened to the whole window.
GROUP_DOCS = 5_000
#: Words whose suffixes a task sorts at once.
TREE_WORDS = 400_000
#: Stands for a missing doc_id: later than any other.
_LAST = 2**63 - 1

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """What ASCII white space separates."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_prefixes(words: list[bytes]) -> np.ndarray:
    """For each window of a text, the least hash of the prefixes inside it."""
    n = len(words) - PREFIX + 1
    if len(words) < WINDOW:
        return np.empty(0, _U)
    hashes = word_hashes(words)
    out = np.zeros(n, _U)
    for k in range(PREFIX):
        out = out * _BASE + hashes[k : k + n]
    out = scramble(out)
    span, reach = 1, WINDOW - PREFIX + 1
    while 2 * span <= reach:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = reach - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _outline(orders, hashes, texts):
    counts, sequences, prefixes = [], [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        sequences.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
        prefixes.append(np.unique(window_prefixes(words)).view(np.int64))
    return orders, hashes, counts, sequences, prefixes


def _runs(orders, hashes, texts, shared):
    """Runs of neighbouring windows with one shared prefix: their first window, number and words."""
    out = [[], [], [], [], [], []]
    for order, code, text, known in zip(orders, hashes, texts, shared, strict=True):
        words = words_of(text)
        least = window_prefixes(words).view(np.int64)
        hit = np.isin(least, np.array(known, np.int64))
        edge = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (hit[1:] != hit[:-1])]) if len(least) else []
        for first, stop in zip(edge, [*edge[1:], len(least)], strict=True):
            if hit[first]:
                row = (int(least[first]), order, code, int(first), int(stop - first), b" ".join(words[first : stop + WINDOW - 1]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
    return out


def _sorted_suffixes(codes: np.ndarray) -> np.ndarray:
    """Rank of each suffix by its first ``WINDOW`` words, by prefix doubling; equal ranks are one node."""
    rank, span = codes, 1
    while 2 * span <= WINDOW:
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
    rest = WINDOW - span
    return np.unique(rank[: len(rank) - rest] * (int(rank.max()) + 1) + rank[rest:], return_inverse=True)[1]


def _repeats(runs: list[tuple]) -> pa.RecordBatch:
    """Word spans of the runs (prefix, order, hash, first, n, words) whose windows start in an earlier document."""
    vocabulary: dict[bytes, int] = {}
    codes, starts, at = [], [], 0
    for run in runs:
        words = run[5].split(b" ")
        codes.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        starts.append(np.arange(at, at + run[4]))
        at += len(words)
    n = np.array([run[4] for run in runs])
    node = _sorted_suffixes(np.concatenate(codes))[np.concatenate(starts)]
    order = np.repeat(np.array([run[1] for run in runs], np.int64), n)
    earliest = np.full(node.max() + 1, _LAST, np.int64)
    np.minimum.at(earliest, node, order)
    late = order > earliest[node]
    rows = [[], [], [], []]
    begin = np.cumsum(n) - n
    for i in np.flatnonzero(np.logical_or.reduceat(late, begin)).tolist():
        own = late[begin[i] : begin[i] + n[i]]
        edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for column, value in zip(rows, (runs[i][1], runs[i][2], runs[i][3] + first, runs[i][3] + stop + WINDOW - 1), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
        names=["ord", "text_hash", "start", "stop"],
    )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by prefix; those of a prefix stay together, small prefixes share a tree."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                if any(r[1] != group[0][1] for r in group):
                    held += group
                    size += sum(r[4] + WINDOW for r in group)
                if size >= TREE_WORDS:
                    yield _repeats(held)
                    held, size = [], 0
                group = []
            group.append(row)
    if any(r[1] != group[0][1] for r in group):
        held += group
    if held:
        yield _repeats(held)


def _single_windows(orders, hashes, texts, shared):
    """Digest of each distinct window with a frequent prefix, and where the document has it."""
    out = [[], [], [], []]
    for order, code, text, known in zip(orders, hashes, texts, shared, strict=True):
        words = words_of(text)
        hit = np.isin(window_prefixes(words).view(np.int64), np.array(known, np.int64))
        places: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(hit).tolist():
            digest = hashlib.blake2b(b" ".join(words[k : k + WINDOW]), digest_size=16).digest()
            places.setdefault(digest, []).append(k)
        for digest, at in places.items():
            for column, value in zip(out, (digest, order, code, at), strict=True):
                column.append(value)
    return out


def _cut(orders, texts, spans):
    counts, removed, kept = [], [], []
    for text, found in zip(texts, spans, strict=True):
        words = words_of(text)
        stays = np.ones(len(words), bool)
        for span in found or ():
            stays[span["start"] : span["stop"]] = False
        counts.append(len(words))
        removed.append(int(len(words) - stays.sum()))
        kept.append(b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s).decode("utf-8", "surrogatepass"))
    return orders, counts, removed, kept


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``, one row for each row of ``docs``; kept words are joined by one space.

    Null and empty texts have no words. Order is that of doc_id; a missing id comes after all others, and rows that share an id
    are no earlier than each other. Windows are judged on the input. Other columns are not read.
    """
    source = docs.select(_order().alias("ord"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    key = ["ord", "text_hash"]
    # The texts are dealt out once; both joins with them read this exchange.
    texts = source.repartition(*key)
    outlines = materialize(
        map_batches(source, "ord bigint, text_hash bigint, n_words int, sequence binary, prefixes array<bigint>", _outline),
        "outlines",
    )
    earliest = outlines.where(F.col("n_words") >= WINDOW).groupBy("sequence").agg(F.min("ord").alias("first"))
    placed = outlines.join(earliest, "sequence")
    copies = placed.where("ord > first").select(*key, F.lit(0).alias("start"), F.col("n_words").alias("stop"))
    windows = placed.where("ord = first").select(*key, F.explode("prefixes").alias("prefix"))
    shared = windows.groupBy("prefix").agg(
        F.min("ord").alias("low"), F.max("ord").alias("high"), (F.count("*") > GROUP_DOCS).alias("frequent")
    ).where("low < high")
    wanted = windows.join(shared.select("prefix", "frequent"), "prefix").groupBy(*key).agg(
        F.collect_set(F.when(~F.col("frequent"), F.col("prefix"))).alias("usual"),
        F.collect_set(F.when(F.col("frequent"), F.col("prefix"))).alias("frequent"),
    )
    suspects = texts.join(wanted, key)
    runs = map_batches(
        suspects.where(F.size("usual") > 0).select(*key, "text", "usual"),
        "prefix bigint, ord bigint, text_hash bigint, first int, n int, words binary", _runs,
    )
    spans = runs.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(
        _subtrees, "ord bigint, text_hash bigint, start int, stop int"
    )
    single = map_batches(
        suspects.where(F.size("frequent") > 0).select(*key, "text", "frequent"),
        "digest binary, ord bigint, text_hash bigint, places array<int>", _single_windows,
    )
    nodes = single.groupBy("digest").agg(F.min("ord").alias("first"))
    late = single.join(nodes, "digest").where("ord > first")
    deep = late.select(*key, F.explode("places").alias("start")).select(*key, "start", (F.col("start") + WINDOW).alias("stop"))
    found = copies.unionByName(spans).unionByName(deep).groupBy(*key).agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    )
    cut = map_batches(
        texts.join(found, key, "left").select("ord", "text", "spans"),
        "ord bigint, n_words bigint, n_removed bigint, kept_text string", _cut,
    )
    return cut.select(F.when(F.col("ord") < _LAST, F.col("ord")).alias("doc_id"), "n_words", "n_removed", "kept_text")
