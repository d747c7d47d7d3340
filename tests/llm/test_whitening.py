"""Whitening against exact fractions and numpy, and on odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lumenarc.llm import whitening as W

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """n, S and covariance of the distinct quantized vectors, by fractions."""
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)})
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    c = [[r[i] * n - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    return x, n, s, cov


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, n, s, cov = brute([r.embedding for r in rows])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = {}
    for r in W.op13_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == {r.vec_id for r in rows} and all(set(g) == {1, 2, 3, 4} for g in got.values())
    signs = {}
    for r in rows:
        own = [math.floor(256 * float(c)) for c in r.embedding]
        for k, g in got[r.vec_id].items():
            want = sum((a - b / n) * c for a, b, c in zip(own, s, v[:, k - 1], strict=True)) / math.sqrt(e[k - 1])
            sign = signs.setdefault(k, 1 if abs(g.whitened - want) < abs(g.whitened + want) else -1)
            assert abs(g.whitened - sign * want) < 1e-9
            assert (g.n, g.deviation) == (n, sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True)))
            assert abs(g.explained - e[k - 1] / np.trace(cov)) < 1e-12 and g.identity_error < 1e-9


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5, 0.25], [1, 1 - 1e-12, 1e-3, 1e-3 + 1e-13, 1e-8, 0]])
def test_refinement_of_near_and_equal_eigenvalues(values):
    """From float32 vectors to the last digits: residuals and orthogonality, and the vectors themselves where eigenvalues differ."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    _, start = np.linalg.eigh(a.astype(np.float32))
    e, x = W.refine(a, start)
    assert np.all(np.diff(e) <= 0) and np.abs(e - sorted(values, reverse=True)).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15 and np.abs(a @ x - x * e).max() < 1e-14
    order = np.argsort(-np.array(values), kind="stable")
    for i in range(6):
        gap = min(abs(values[order[i]] - values[j]) for j in range(6) if j != order[i])
        if gap > 1e-4:
            assert 1 - abs(x[:, i] @ q[:, order[i]]) < 1e-15


def test_large_matrix_reaches_double_precision():
    rng = np.random.default_rng(2)
    b = rng.standard_normal((400, 64)) * np.linspace(3, 1, 64)
    a = b.T @ b / 400
    _, start = np.linalg.eigh(a.astype(np.float32))
    e, x = W.refine(a, start)
    want, v = np.linalg.eigh(a)
    assert np.abs(e - want[::-1]).max() < 1e-13 and np.abs(np.abs((x * v[:, ::-1]).sum(0)) - 1).max() < 1e-12 and np.abs(a @ x - x * e).max() < 5e-15


def test_gram_is_exact_for_large_entries():
    rng = np.random.default_rng(3)
    y = rng.integers(-(1 << 40), 1 << 40, (50, 3))
    y[::2] %= 1000
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
    assert W.gram(y).tolist() == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (None, [-0.0, 0.001, -0.001]), (6, [7.0]), (7, []), (8, [3.0, 3.0, 3.0])]
    d = spark.createDataFrame([(*r, "z", 1.0) for r in rows], "vec_id long, embedding array<float>, x string, n double")
    got = W.whiten_table(d).collect()
    assert len(got) == 6 * 3 and {r.vec_id for r in got} == {1, None, 6, 7, 8} and {r.n for r in got} == {5}
    x, n, s, _ = brute([[*v, *[0.0] * (3 - len(v))] for i, v in rows if i not in (2, 3, 4, 5)])
    assert {r.deviation for r in got if r.vec_id is None} == {sum((n * a - b) ** 2 for a, b in zip((0, 0, -1), s, strict=True))}
    assert all(r.identity_error < 1e-9 for r in got) and abs(sum(r.explained for r in got if r.vec_id == 8) - 1) < 1e-12
    assert W.whiten_table(d.limit(0)).count() == 0 and W.whiten_table(d.filter("vec_id = 7")).count() == 0
    one = W.whiten_table(d.filter("vec_id = 1")).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, 0.0, 0.0) for r in one)
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = W.whiten_table(huge).collect()
    assert len(got) == 6 and all(math.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)
