import math

import numpy as np
import pytest

from corpusloom.llm.whitening import orthogonal_columns, pivoted_cholesky, principal_components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, whitened string"


def brute(vectors):
    """Whole entries, exact deviations and the covariance's eigenvectors from numpy's own solver."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = [int(((n * row - s) ** 2).sum()) for row in x]
    y = np.array([[int(a) for a in n * row - s] for row in x], float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return deviation, values[::-1], axes[:, ::-1], y


def check(rows, ids, vectors, components):
    deviation, values, axes, y = brute(vectors)
    want = np.abs(y @ axes[:, :components] / np.sqrt(values[:components]))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert {r.n for r in rows} == {len(vectors)} and len(rows) == len(vectors) * components
    for k, i in enumerate(ids):
        mine = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in mine[:components]] == list(range(1, components + 1))
        assert mine[0].deviation == deviation[k]
        assert np.allclose([abs(r.whitened) for r in mine[:components]], want[k], atol=1e-6)
        assert np.allclose([r.explained for r in mine[:components]], values[:components] / values.sum(), rtol=1e-6)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_given_vectors(spark, parts):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    data = df.collect()
    check(whiten(df.repartition(parts)).collect(), [r.vec_id for r in data], [r.embedding for r in data], 32)


def test_unusable_rows_and_odd_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5) * [1, 20, 3, 0.5, 8]], 1, 2, "w") for i in range(40)]
    good += [(None, good[3][1], None, None, None)]
    bad = [(90, None), (91, []), (92, [1.0] * 4), (93, [1.0, None, 1.0, 1.0, 1.0]), (94, [float("nan")] + [0.0] * 4), (95, [float("inf")] + [0.0] * 4)]
    df = spark.createDataFrame(good + [(i, v, 0, 0, "") for i, v in bad], SCHEMA).repartition(3)
    check(whiten(df).collect(), [r[0] for r in good], [r[1] for r in good], 5)


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-40, 40, size=(30, 2))
    vectors = [[float(a), float(b), float(a + b), 7.0] for a, b in base]
    rows = whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(vectors)], SCHEMA)).collect()
    check(rows, range(30), vectors, 2)


def test_tables_without_rows_or_spread(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 1.5], 0, 0, "") for i in range(9)], SCHEMA)
    assert whiten(same).count() == 0


def test_large_entries_have_no_deviation_in_64_bits(spark):
    rows = whiten(spark.createDataFrame([(0, [3e8, 1.0], 0, 0, ""), (1, [-3e8, 2.0], 0, 0, ""), (2, [1.0, 5.0], 0, 0, "")], SCHEMA)).collect()
    assert {r.vec_id: r.deviation is None for r in rows} == {0: True, 1: True, 2: False}


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(33, 60)) * np.logspace(0, -6, 33)[:, None]
    matrix = wide @ wide.T
    factor, order = pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[order][:, order], atol=1e-13 * matrix.max())
    assert np.allclose(factor, np.tril(factor)) and np.all(np.diff(np.diag(factor)) <= 1e-12)
    columns = orthogonal_columns(factor)
    assert np.allclose(columns @ columns.T, factor @ factor.T, atol=1e-12 * matrix.max())
    values, axes = principal_components(matrix)
    assert np.allclose(axes.T @ axes, np.eye(33), atol=1e-10)
    assert np.allclose(values, (np.linalg.svd(wide, compute_uv=False)) ** 2, rtol=1e-8)
