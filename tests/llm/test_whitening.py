"""Whitening against eigenvectors of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from foliomill.llm import queries, whitening

COLUMNS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors):
    """n, deviations, eigenvalues and eigenvectors from the covariance in whole numbers."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in scaled.T @ scaled])
    values, vectors = np.linalg.eigh(covariance)
    return n, (scaled * scaled).sum(1).tolist(), values[::-1], vectors[:, ::-1], scaled.astype(float) / n


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def compare(got, rows):
    rows = [(i, v) for i, v in rows if good(v)]
    n, deviations, values, vectors, centred = brute([v for _, v in rows])
    k = min(8, len(values))
    assert len(got) == n * k and set(got.n) == {n} and (got.identity_error <= 1e-4).all() and got.identity_error.nunique() == 1
    want = {i: (d, c) for (i, _), d, c in zip(rows, deviations, centred)}
    for component in range(1, k + 1):
        part = got[got.component == component].set_index("vec_id")
        direction = centred @ vectors[:, component - 1] / np.sqrt(values[component - 1])
        expected = np.array([direction[j] for j, _ in enumerate(rows)])
        found = part.loc[[i for i, _ in rows]].whitened.to_numpy()
        sign = np.sign(found @ expected)
        assert np.allclose(found, sign * expected, rtol=1e-6, atol=1e-8)
        assert np.allclose(part.explained, values[component - 1] / values.sum(), rtol=1e-6)
        assert [part.loc[i].deviation for i, _ in rows] == [want[i][0] for i, _ in rows]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(queries.op13_whitening(spark, sf).toPandas(), rows)


@pytest.mark.parametrize("parts", [1, 40])
def test_broken_rows_and_many_partitions(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [None] * 11), (1002, [1.0] * 10 + [float("nan")]), (1003, [float("inf")] + [0.0] * 10), (1004, [-float("inf")] * 11), (1005, []), (1006, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1, [0]) for i, v in rows], "vec_id long, embedding array<double>, _id string, n int, _x array<int>").repartition(parts)
    compare(whitening.whiten(frame).toPandas(), [r for r in rows if r[0] < 1005])


def test_awkward(spark):
    schema = "vec_id long, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame([], schema))
    assert got.count() == 0 and got.columns == ["vec_id", "n", "deviation", "component", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], schema)).toPandas()
    assert one.component.tolist() == [1, 2] and (one.whitened == 0).all() and (one.explained == 0).all() and (one.deviation == 0).all() and (one.identity_error == 1).all()
    # Repeated rows, and a direction without variance.
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (1, [1.0, 5.0]), (2, [3.0, 5.0])], schema)).toPandas()
    assert len(flat) == 6 and (flat[flat.component == 2].whitened == 0).all() and (flat[flat.component == 1].explained == 1).all()
    assert sorted(abs(flat[flat.component == 1].whitened.round(6))) == [0.707107, 0.707107, 1.414214]


def test_deviations_are_exact():
    for n, q, r, x in [(3, 5, 2, 1 << 40), (10**9, 100_000, 999_999_999, 100_020), (51_282, 100_000, 40_000, 99_000)]:
        want = 2 * (n * x - (q * n + r)) ** 2
        got = whitening.deviations(np.full((2, 2), x), n, np.full(2, q), np.full(2, r))
        assert got == [want if want < 1 << 63 else None] * 2
