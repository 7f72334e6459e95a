import math

import numpy as np
import pytest

from citeloom.llm import whitening
from citeloom.llm.common import Written


def brute(vectors, k=8):
    """Whitening as told, with the whole covariance, by numpy."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    mean = s / n
    c = x - mean
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (c @ u) / np.sqrt(e), e / np.trace(v)


def compare(rows, ids, vectors, k):
    n, deviation, white, explained = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, j + 1) for i in ids for j in range(k)}
    for j in range(k):
        ours = np.array([got[i, j + 1].whitened for i in ids])
        sign = 1 if ours @ white[:, j] > 0 else -1
        assert np.abs(sign * ours - white[:, j]).max() < 1e-7
        assert all(abs(got[i, j + 1].explained / explained[j] - 1) < 1e-9 for i in ids)
    for p, i in enumerate(ids):
        assert {(got[i, j + 1].n, got[i, j + 1].deviation) for j in range(k)} == {(n, deviation[p])}
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-8


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    return (random.standard_normal((400, 20)) * np.linspace(2, 0.5, 20) + 3).astype(np.float32).tolist()


def test_whitened_rows_equal_the_plain_way(spark, vectors):
    bad = [(1000, None), (1001, [1.0] * 19 + [None]), (1002, [1.0] * 19 + [float("nan")]), (1003, [float("inf")] + [1.0] * 19), (1004, []), (1005, [1.0] * 7)]
    rows = [(i, v, i) for i, v in enumerate(vectors)] + [(*b, 0) for b in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").repartition(5)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out.collect(), list(range(400)), vectors, 8)


def test_registered_query_equals_the_plain_way(spark):
    from citeloom.llm.queries import op12_whitening

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    compare(op12_whitening(spark, folder).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def test_passes_certify_components_of_spread_spectra(spark):
    """Where eigenvalues fall fast the block stays narrow, and residuals are at rounding."""
    random = np.random.default_rng(5)
    m = random.standard_normal((300, 80)) * (4.0 ** -np.arange(80).clip(0, 10)) * 50
    x = Written(whitening.integers(spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")), "x").df
    fit = whitening.Fit(x, 3)
    assert fit.residual <= whitening.CERTIFIED * fit.values[0] and max(fit.widths) < 80
    flat = Written(whitening.integers(spark.createDataFrame([(i, v) for i, v in enumerate(random.standard_normal((300, 80)).tolist())], "vec_id long, embedding array<double>")), "x").df
    wide = whitening.Fit(flat, 3)
    assert wide.widths[-1] == 80 and wide.passes < 12 and wide.residual < 1e-9 * wide.values[0]


def test_few_directions_and_repeats(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [2.0, 2.0, 5.0]), (3, [4.0, 2.0, 5.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in out} == {1} and len(out) == 4 and {r.n for r in out} == {4}
    assert all(abs(r.explained - 1) < 1e-12 for r in out)
    for few in (rows[:1], rows[:2], [], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0


def test_large_deviations_are_exact_or_null(spark):
    rows = [(i, [float(v), 0.5]) for i, v in enumerate([0, 1 << 30, -(1 << 30), 5])] + [(9, [1e300, 1.0]), (10, [1e20, 1.0])]
    out = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert {i for i, _ in out} == {"0", "1", "2", "3"}  # no long holds 1024 * 1e20
    xs = [1024 * v + 100_000 for v in (0, 1 << 30, -(1 << 30), 5)]
    for i, x in enumerate(xs):
        want = (4 * x - sum(xs)) ** 2
        assert out[str(i), 1].deviation == (want if want < 1 << 63 else None)
