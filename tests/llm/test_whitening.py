"""Embedding whitening against an eigendecomposition of the covariance, with odd rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, r string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def slow(rows, k):
    """{vec_id: (deviation, whitened up to sign, explained)} from a covariance that is formed."""
    dims = [len(v) for _, v in rows if v is not None]
    dim = max(sorted(set(dims), reverse=True), key=dims.count)
    used = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [i for i, _ in used], deviation, centred @ v / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize(("seed", "dim", "n", "k"), [(1, 8, 300, 32), (2, 40, 500, 32), (3, 5, 60, 3)])
def test_whiten(spark, seed, dim, n, k):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim) * 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(n, None), (n + 1, []), (n + 2, [None] * dim), (n + 3, [math.nan] * dim), (n + 4, [math.inf, *[0.0] * (dim - 1)]), (n + 5, [1.0])]
    rows += [(None, rows[0][1]), (1, rows[1][1])]
    got = whitening.whiten(frame(spark, rows).repartition(5), k).collect()
    ids, deviation, whitened, explained = slow(rows, k)
    count = min(k, dim)
    assert len(got) == len(ids) * count and {r["n"] for r in got} == {len(ids)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    signs = [np.sign(found[(5, c + 1)][0]["whitened"] * whitened[5, c]) for c in range(count)]
    for at, i in enumerate(ids):
        for c in range(count):
            for r in found[(i, c + 1)]:
                assert r["deviation"] == deviation[at]
                assert abs(r["whitened"] * signs[c] - whitened[at, c]) < 1e-7


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_a_direction_without_variance_is_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [a, a, b]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)).astype(float).tolist())]
    got = whitening.whiten(frame(spark, rows), 32).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_jacobi_keeps_small_values_accurate():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        values = np.logspace(6, -6, n)
        r = np.linalg.qr((q * values) @ np.linalg.qr(rng.normal(size=(n, n)))[0].T, mode="r")
        got, v = whitening.jacobi(r)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and np.all(np.diff(got) <= 0)
        assert np.allclose(np.linalg.norm(r @ v, axis=0), got, rtol=1e-9, atol=1e-10)
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_deviation_of_any_size():
    fit = whitening.Fit(10**9, [10**15, 10**15])
    x = np.array([[10**6, 10**6], [10**6 + 2, 10**6], [10**6 + 300, 10**6 - 40000]], float)
    assert fit.deviation(x) == [0, (2 * 10**9) ** 2, None]
    assert whitening.Fit(4, [2, 6]).deviation(np.array([[1.0, 2.0]])) == [4 + 4]


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 4)).tolist())]
    got = whitening.whiten(frame(spark, rows).repartition(11)).collect()
    assert got[0]["identity_error"] < 1e-9 and len(got) == 800
