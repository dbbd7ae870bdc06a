"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become whole numbers, so sums and deviations are exact. The scatter of the centred vectors is added up from one
matrix a task. Its pivoted factor ``L`` has the scatter as ``L L'``; Jacobi rotations of the columns of ``L`` make them
orthogonal, without ever forming a further product. Their squared norms are then the eigenvalues of the scatter, and the columns
themselves, normalised and put back in the order before pivoting, its eigenvectors.

Only matrices of the vectors' dimension reach the driver, never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.common import give_back

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows whose projections a task holds at once.
ROWS = 4096
#: Sweeps of rotations; ten are enough in practice.
SWEEPS = 60

_EPS = np.finfo(float).eps


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with ``L @ L.T == matrix[order][:, order]``; ``L`` has as many columns as the matrix has rank."""
    a, size = matrix.copy(), len(matrix)
    order = np.arange(size)
    factor = np.zeros((size, size))
    rest = a.diagonal().copy()
    least = size * _EPS * max(rest.max(initial=0), 0)
    for k in range(size):
        pivot = k + int(rest[k:].argmax())
        if rest[pivot] <= least:
            return factor[:, :k], order
        for rows in (a, a.T, factor, rest, order):
            rows[[k, pivot]] = rows[[pivot, k]]
        factor[k, k] = np.sqrt(rest[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        rest[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """Columns of ``factor`` after one-sided Jacobi rotations: orthogonal, with the same ``factor @ factor.T``.

    A round of a sweep turns disjoint pairs at once; in a sweep every pair meets (a round-robin tournament).
    """
    g, width = factor.copy(), factor.shape[1]
    seats = np.arange(width + width % 2)
    close = _EPS * np.sqrt(max(len(g), 1))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            angle = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, angle.max(initial=0))
            turn = angle > close
            if turn.any():
                p, q, a, b, aa, bb, ab = p[turn], q[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
                zeta = (bb - aa) / (2 * ab)
                tangent = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
                cosine = 1 / np.hypot(1, tangent)
                g[:, p], g[:, q] = cosine * (a - tangent * b), cosine * (tangent * a + b)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= close:
            break
    return g


def principal_components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors (columns); a vector's largest entry is positive."""
    factor, order = pivoted_cholesky(scatter)
    columns = orthogonal_columns(factor)
    values = (columns * columns).sum(0)
    falling = np.argsort(-values, kind="stable")
    vectors = np.empty_like(columns)
    vectors[order] = (columns / np.sqrt(values))[:, falling]
    largest = np.abs(vectors).argmax(0)
    return values[falling], vectors * np.sign(vectors[largest, np.arange(len(largest))])


def whole_entries(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors in ``column``, and their entries as whole numbers."""
    length = pc.equal(pc.list_value_length(column), dims).to_numpy(zero_copy_only=False) == True  # noqa: E712 (nulls)
    at = np.flatnonzero(length)
    entries = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(entries).all(1)
    return at[fine], np.clip(np.floor(entries[fine] * SCALE), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def _added(vectors: DataFrame, dims: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(entries)`` over all batches: a row of packed doubles or longs per task and first index, added by that index."""
    kind = of(np.zeros((0, dims), np.int64)).dtype

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                total += of(whole_entries(batch.column(1).slice(start, ROWS), dims)[1])
        yield packed(range(shape[0]), total)
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(values.as_buffer(), kind)
        yield packed(sums, sums.values())

    def packed(places, values) -> pa.RecordBatch:
        rows = [v.tobytes() for v in values]
        return pa.RecordBatch.from_arrays([pa.array(list(places), pa.int32()), pa.array(rows, pa.binary())], names=["at", "sums"])

    parts = vectors.mapInArrow(add, "at int, sums binary").repartition("at").mapInArrow(merge, "at int, sums binary")
    out = np.zeros(shape, kind)
    for row in parts.collect():
        out[row["at"]] = np.frombuffer(bytes(row["sums"]), kind).reshape(shape[1:])
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per usable vector and component.

    Vectors that are null, or hold null or non-finite entries, are dropped. So are vectors of another length than most
    have (of equally common lengths the longest), and empty ones. All others, repeated rows and rows without a ``vec_id``
    included, make up the fit list and come back. Entries beyond 2**62 count as that. ``deviation`` is null
    where it exceeds 64 bits. Components of an eigenvalue that is zero but for rounding have no whitened form and are left
    out, so a table of equal vectors, like an empty one, gives no rows. Other columns are not read.
    """
    vectors = embeddings.select("vec_id", vector)
    schema = T.StructType([
        vectors.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        *(T.StructField(name, T.DoubleType() if name != "deviation" else T.LongType())
          for name in ("deviation", "whitened", "explained", "identity_error")),
    ])
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    common = vectors.where(finite & (F.size(vector) > 0)).groupBy(F.size(vector).alias("dims")).count()
    first = common.orderBy(F.desc("count"), F.desc("dims")).first()
    if first is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dims, n = first["dims"], first["count"]
    sums = _added(vectors, dims, (dims, 1), lambda x: x.sum(0)[:, None])[:, 0]
    near = sums // n
    rest = sums - n * near  # n times the mean, less n times its whole part
    offset = rest / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - near) - offset

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return np.vstack([y.T @ y, y.sum(0)])

    moments = _added(vectors, dims, (dims + 1, dims), products)
    scatter, drift = moments[:-1], moments[-1] / n
    values, axes = principal_components((scatter + scatter.T) / 2)
    c = min(components, len(values))
    if not c:
        return embeddings.sparkSession.createDataFrame([], schema)
    turn = axes[:, :c] / np.sqrt(values[:c] / n)
    shift = drift @ turn

    def covariance(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn - shift
        return w.T @ w

    identity_error = float(np.abs(_added(vectors, dims, (c, c), covariance) / n - np.eye(c)).max())
    explained = values[:c] / np.trace(scatter)
    arrow = to_arrow_schema(schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, column = (x.slice(start, ROWS) for x in batch.columns)
                at, x = whole_entries(column, dims)
                far = n * (x - near) - rest
                fits = (far.astype(float) ** 2).sum(1) < 2.0**62
                deviation = np.where(fits, (far * far).sum(1), 0)
                rows = np.repeat(np.arange(len(at)), c)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at[rows])).cast(arrow.field(0).type), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(rows), n)), pa.array(deviation[rows], mask=~fits[rows]),
                    pa.array((centred(x) @ turn).ravel()), pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(rows), identity_error)),
                ], schema=arrow)
        give_back()

    return vectors.mapInArrow(project, schema)
