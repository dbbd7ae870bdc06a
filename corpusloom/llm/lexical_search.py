"""Ranked lexical search with a document FP-tree and branch-and-bound.

Documents are restricted to the terms of the items and written with their term counts; from that table come the number of
documents, their length and the document frequency of each term. Each task then builds trees of the documents it reads: a
document is the path of its terms from the most frequent to the rarest, so documents that hold the same frequent terms share
the upper part of their paths. A node knows, for all documents below it, the largest count of each term and the least length
norm m. Both give an upper bound of any score below it, as a score rises with counts and falls with m. An item goes
down the tree depth first, best bound first, and leaves out what cannot reach its ten best so far; these carry over from tree
to tree. The best of all tasks are merged by rank.

Items come in blocks of a bounded number of different terms; each block is a pass of its own over the documents.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import LOWER, give_back, map_batches
from corpusloom.session import materialize

TOP = 10
#: Different terms of a block of items; an item with more is a block of its own.
BLOCK_TERMS = 4096
#: Counts that a tree holds at once: its documents times the terms of the block.
CELLS = 1 << 23
#: Documents scored together at the bottom of a tree.
LEAF = 32
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term: runs of ASCII letters (A-Z lower-cased), digits and code points from U+0080."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        stop = start + PIECE
        if stop < len(data):
            last = _TERM.match(data, stop)  # a term that the cut runs through belongs to this piece
            stop = last.end() if last else stop
        counts.update(_TERM.findall(data, start, stop))
        start = stop
    return counts


def _item_terms(ids, texts):
    return ids, [list(term_counts(text)) for text in texts]


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items and their distinct terms, in blocks; rows that share an ``item_id`` are one item with the terms of all."""
    kind = items.schema["item_id"].dataType.simpleString()
    terms = map_batches(items.select("item_id", "text"), f"item_id {kind}, terms array<binary>", _item_terms)
    merged = terms.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    block, known = [], set()
    for row in merged.orderBy("item_id").toLocalIterator():
        own = [bytes(term) for term in row["terms"]]
        if block and len(known.union(own)) > block_terms:
            yield block
            block, known = [], set()
        known.update(own)
        block.append((row["item_id"], own))
    yield block


def _restrict(code: dict[bytes, int]):
    def work(ids, texts):
        lengths, terms, counts = [], [], []
        for text in texts:
            found = term_counts(text)
            lengths.append(found.total())
            kept = sorted((code[term], n) for term, n in found.items() if term in code)
            pairs = np.array(kept, np.int32).reshape(-1, 2)
            terms.append(pairs[:, 0].tobytes())
            counts.append(pairs[:, 1].tobytes())
        return ids, lengths, terms, counts

    return work


def _frequencies(size: int):
    """Rows ``(code, df)`` of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total[np.frombuffer(terms.as_buffer(), np.int32)] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["code", "df"])

    return run


class Best:
    """The highest scores of one item so far."""

    def __init__(self, top: int) -> None:
        self.top, self.floor = top, 1
        self.scores, self.ids, self.missing = (np.zeros(0, kind) for kind in (np.int64, np.int64, bool))

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        good = scores >= self.floor
        if good.any():
            scores, ids, missing = (
                np.concatenate([old, new[good]])
                for old, new in ((self.scores, scores), (self.ids, ids), (self.missing, missing))
            )
            order = np.lexsort((ids, missing, -scores))[: self.top]
            self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
            if len(order) == self.top:
                self.floor = int(self.scores[-1])


def _gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])


class FpTree:
    """Documents as paths of term ranks (0 is the most frequent term), with bounds at each node.

    A node is a range of the sorted paths. Neighbouring children are taken together while they have no more than ``LEAF``
    documents; a node of no more than that is a leaf.
    """

    def __init__(self, ids, missing, m, paths: list[np.ndarray], counts: list[np.ndarray], width: int) -> None:
        keys = [path.astype(">u4").tobytes() for path in paths]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        at = np.array(order)
        self.ids, self.missing, self.m = ids[at], missing[at], m[at]
        paths, counts = [paths[i] for i in order], [counts[i] for i in order]
        self.tf = np.zeros((len(order), width), np.int32)
        for row, path, count in zip(self.tf, paths, counts, strict=True):
            row[path] = count
        # How many terms a path shares with the one before.
        shared = np.array([0, *(_prefix(a, b) for a, b in zip(paths, paths[1:], strict=False))])
        self.low, self.high, self.children = [0], [len(order)], [None]
        above = [0]
        while above:
            node = above.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            inner = shared[low + 1 : high]
            cuts = [low, *(low + 1 + np.flatnonzero(inner == inner.min())).tolist(), high]
            kids, start = [], low
            for a, b in zip(cuts[1:], [*cuts[2:], None], strict=True):
                if b is None or b - start > LEAF:
                    kids.append(len(self.low))
                    self.low.append(start)
                    self.high.append(a)
                    self.children.append(None)
                    start = a
            self.children[node] = np.array(kids)
            above += kids
        self.most = np.zeros((len(self.low), width), np.int32)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):  # children come after their parent
            kids, part = self.children[node], slice(self.low[node], self.high[node])
            self.most[node] = (self.tf[part] if kids is None else self.most[kids]).max(0)
            self.least[node] = (self.m[part] if kids is None else self.least[kids]).min()

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer ``best`` all documents that may be among them; the number of documents scored."""
        scored, waiting = 0, [(self._bounds(np.array([0]), terms, weights)[0], 0)]
        while waiting:
            bound, node = waiting.pop()
            if bound < best.floor:
                continue
            kids = self.children[node]
            if kids is None:
                part = slice(self.low[node], self.high[node])
                scores = (_gains(self.tf[part][:, terms], self.m[part]) * weights).sum(1)
                best.offer(scores, self.ids[part], self.missing[part])
                scored += part.stop - part.start
            else:
                bounds = self._bounds(kids, terms, weights)
                rising = np.argsort(bounds, kind="stable")
                rising = rising[bounds[rising] >= best.floor]
                waiting += zip(bounds[rising].tolist(), kids[rising].tolist(), strict=True)
        return scored

    def _bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (_gains(self.most[nodes[:, None], terms], self.least[nodes]) * weights).sum(1)


def _prefix(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    other = np.flatnonzero(a[:size] != b[:size])
    return int(other[0]) if len(other) else size


def _rank_block(vectors: DataFrame, block, code: dict[bytes, int], item_type: T.DataType, top: int) -> DataFrame:
    totals = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n_docs, n_words = totals["docs"], totals["words"]
    df = np.zeros(len(code), np.int64)
    counted = vectors.select("terms").mapInArrow(_frequencies(len(code)), "code int, df bigint")
    for row in counted.groupBy("code").agg(F.sum("df").alias("df")).collect():
        df[row["code"]] = row["df"]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    # Terms that no document holds take no part.
    wanted = []
    for item, terms in block:
        codes = np.array([code[t] for t in terms], np.int64)
        codes = codes[df[codes] > 0]
        wanted.append((item, rank[codes], weight[codes]))
    out = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(out)
    width = int((df > 0).sum())
    rows_of_tree = max(LEAF, CELLS // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in wanted]
        for held in _gathered(batches, rows_of_tree):
            ids, lengths, terms, counts = (pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held), strict=True))
            m = 10 + (90 * lengths.to_numpy() * n_docs) // n_words
            paths, tfs = [], []
            for codes, tf in zip(terms, counts, strict=True):
                ranks = rank[np.frombuffer(codes.as_buffer(), np.int32)]
                order = np.argsort(ranks)
                paths.append(ranks[order])
                tfs.append(np.frombuffer(tf.as_buffer(), np.int32)[order])
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            tree = FpTree(ids.fill_null(0).to_numpy(zero_copy_only=False), missing, m, paths, tfs, width)
            for (_, terms, weights), found in zip(wanted, best, strict=True):
                if len(terms):
                    tree.search(terms, weights, found)
        for (item, *_), found in zip(wanted, best, strict=True):
            size = len(found.scores)
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * size, arrow.field(0).type), pa.array(found.ids, mask=found.missing), pa.array(found.scores),
            ], schema=arrow)
        give_back()

    return vectors.where(F.length("terms") > 0).mapInArrow(run, out)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of ``rows`` rows (the last of fewer)."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0, highest first.

    Equal scores rank by ascending doc_id; rows without doc_id come after others of their score. Rows that repeat a
    document rank each on their own. Rows that share an item_id (or have none) are one item with the terms of all. Null,
    empty and term-free texts match nothing and count for nothing; items without a match have no rows. Other columns are not
    read; empty tables give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    item_type = items.schema["item_id"].dataType
    found = []
    for block in item_blocks(items, block_terms):
        code = {term: k for k, term in enumerate(sorted({t for _, terms in block for t in terms}))}
        restricted = map_batches(source, "doc_id bigint, n bigint, terms binary, counts binary", _restrict(code))
        found.append(_rank_block(materialize(restricted, "vectors"), block, code, item_type, top))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = functools.reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
