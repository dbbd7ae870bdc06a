"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are hashed to ``SLOTS`` slots, so the vector table has a fixed size however many words a corpus has. Every slot has
a sparse random index vector. One pass over all texts adds up, for each slot, the index vectors of its occurrences and
their neighbours; a document is the average of the unit vectors of its words. The network is trained in numpy on a
bounded sample of labelled documents (``TRAIN_ROWS``), and its probabilities are calibrated with a temperature fitted on
rows it was not trained on.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import give_back

SLOTS = 1 << 15
DIMENSIONS = 32
NONZERO = 4
REACH = 2
SEED = 11
#: Bound on the labelled rows the network is fitted on: those with the smallest keyed hash of their id.
TRAIN_ROWS = 20_000
HIDDEN = 16
EPOCHS = 60
THRESHOLD = 0.3

#: Tokens handled at once in a task.
_SLICE = 100_000
_KNOWN_WORDS = 60_000
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")


class _Slots(dict):
    """Token to slot, remembered for the words seen lately."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        word = token.decode("utf-8", "replace")
        # Words in capitals share slots by length, as their spelling says less than their shape.
        key = b"\x00%d" % min(len(word), 12) if len(word) > 1 and word.isupper() else word.lower().encode()
        slot = self[token] = zlib.crc32(key) & (SLOTS - 1)
        return slot


_slots = _Slots()


def slots_of(text: str | None) -> np.ndarray:
    tokens = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_slots.__getitem__, tokens), np.int32, len(tokens))


@functools.lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each slot; the row after the last is zero (no neighbour)."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS + 1, DIMENSIONS), np.int16)
    places = rng.random((SLOTS, DIMENSIONS)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out[:SLOTS], places, rng.choice(np.array([-1, 1], np.int16), (SLOTS, NONZERO)), 1)
    return out


def _add_contexts(sums: np.ndarray, slots: np.ndarray) -> None:
    index = index_vectors()
    for start in range(0, len(slots), _SLICE):
        stop = min(start + _SLICE, len(slots))
        padded = np.full(stop - start + 2 * REACH, SLOTS, np.int32)
        low, high = max(0, start - REACH), min(len(slots), stop + REACH)
        padded[low - start + REACH : high - start + REACH] = slots[low:high]
        near = index[padded]
        context = near[REACH:-REACH].copy()
        for shift in range(1, REACH + 1):
            context += near[REACH - shift : -REACH - shift]
            context += near[REACH + shift : len(near) - REACH + shift]
        own = slots[start:stop]
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sums[ordered[first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int64)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((SLOTS, DIMENSIONS), np.int64)
    held, size = [], 0
    gap = np.full(REACH, SLOTS, np.int32)

    def flush() -> None:
        nonlocal held, size
        if held:
            joined = np.concatenate(held)
            own = joined < SLOTS
            if own.any():
                padded_sums = np.zeros((SLOTS + 1, DIMENSIONS), np.int64)
                _add_contexts(padded_sums, joined)
                np.add(sums, padded_sums[:SLOTS], out=sums)
        held, size = [], 0

    for batch in batches:
        for text in batch.column(0):
            slots = slots_of(text.as_py())
            held += [slots, gap]
            size += len(slots)
            if size >= 4 * _SLICE:
                flush()
    flush()
    used = np.flatnonzero(sums.any(1))
    columns = [pa.array(used.astype(np.int32))] + [pa.array(sums[used, d]) for d in range(DIMENSIONS)]
    yield pa.RecordBatch.from_arrays(columns, names=["slot", *(f"d{d}" for d in range(DIMENSIONS))])
    give_back()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all slots, from all texts: ``SLOTS`` x ``DIMENSIONS`` float32, a fixed 4 MB."""
    names = [f"d{d}" for d in range(DIMENSIONS)]
    schema = "slot int, " + ", ".join(f"{name} bigint" for name in names)
    summed = docs.select("text").mapInArrow(_partial_sums, schema).groupBy("slot").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((SLOTS, DIMENSIONS), np.float32)
    got = summed.toArrow()
    if got.num_rows:
        rows = np.stack([got.column(n).to_numpy() for n in names], 1).astype(np.float64)
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        out[got.column("slot").to_numpy()] = rows / np.where(norm > 0, norm, 1)
    return out


def _pool(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean word vector of each whole text (zero for an empty one)."""
    rows = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        slots = slots_of(text.as_py())
        for start in range(0, len(slots), _SLICE):
            rows[row] += table[slots[start : start + _SLICE]].sum(0, dtype=np.float64)
        rows[row] /= max(1, len(slots))
    return rows


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``docs(text, y, order)`` with the text replaced by its vector."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _pool(batch.column(0), shared.value)
            vector = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIMENSIONS), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([vector, *batch.columns[1:]], names=["vector", "y", "order"])
        give_back()

    return docs.select("text", "y", "order").mapInArrow(run, "vector array<double>, y double, order bigint")


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit. Without weights the score is ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on four fifths of the rows, temperature on the rest."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or prior in (0.0, 1.0):
        return Network(prior)
    rng = np.random.default_rng(seed)
    part = rng.random(len(y)) < 0.8
    mean, scale = x[part].mean(0), x[part].std(0) + 1e-6
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    xs, ys, turn = (x[part] - mean) / scale, y[part], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ys))
        for start in range(0, len(order), 128):
            rows = order[start : start + 128]
            a, target = xs[rows], ys[rows]
            hidden = np.tanh(a @ weights[0] + weights[1])
            delta = (_sigmoid(hidden @ weights[2] + weights[3]) - target) / len(rows)
            back = np.outer(delta, weights[2]) * (1 - hidden**2)
            grads = [a.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ delta + 1e-4 * weights[2], delta.sum()]
            turn += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                weights[k] = weights[k] - 0.003 * step
    net = Network(prior, mean, scale, tuple(weights))
    if (~part).any():
        z, target = net.logits(x[~part]), y[~part]
        grid = np.geomspace(0.25, 8, 61)
        loss = [-np.mean(np.log(np.where(target == 1, _sigmoid(z / t), _sigmoid(-z / t)) + 1e-12)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def with_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``__held_out`` (boolean) and ``__score`` (double, higher: label 1 likelier).

    Labels are learnt only where crc32 of the id, as text, leaves a remainder other than 0 by 5; ``train_rows`` bounds how many:
    those with the smallest keyed hash of their id. Empty and null texts have a zero vector and are scored like any. A null id is
    not held out and has no label. Null labels are left out; rows that repeat one count once. Without labels of both classes every
    score is the share of label 1, or 0.5 without any. Of ``docs`` only text and doc_id are read; other columns pass through.
    """
    def remainder(name: str) -> Column:
        return F.crc32(F.col(name).cast("string").cast("binary")) % 5

    known = labels.where(F.col("quality").isNotNull() & (remainder("doc_id") != 0))
    chosen = known.select(F.xxhash64("doc_id").alias("order"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    chosen = chosen.distinct().orderBy("order", "id", "y").limit(train_rows)
    # The sample's size is the parameter, so broadcasting its ids and gathering its vectors is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    table = word_vectors(docs)
    got = pooled(sample.select("text", "y", "order"), table).toArrow()
    n = got.num_rows
    x = np.array(got.column("vector").to_pylist(), np.float64).reshape(n, DIMENSIONS)
    y, order = got.column("y").to_numpy().astype(np.float64), got.column("order").to_numpy()
    place = np.lexsort((*x.T, y, order)) if n else np.zeros(0, np.int64)
    model = docs.sparkSession.sparkContext.broadcast((table, fit(x[place], y[place])))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        for batch in batches:
            scores = net.scores(_pool(batch.column(at), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "__score"])
        give_back()

    schema = docs.withColumn("__score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema).withColumn("__held_out", F.coalesce(remainder("doc_id") == 0, F.lit(False)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; see :func:`with_scores`."""
    return with_scores(docs.select("doc_id", "text"), labels).select(
        "doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with their columns."""
    return with_scores(docs, labels).where(F.col("__score") >= threshold).select(*docs.columns)
