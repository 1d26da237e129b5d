"""Whitening against numpy over whole numbers of any size."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from orrery.llm import whitening

SCHEMA = "vec_id long, label int, embedding array<float>, component string, x double"


def brute(rows, components=16):
    """n, eigenvalues' shares and the exact deviation of each row, by fractions."""
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    d = len(s)
    cov = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    return n, s, cov, [(k, x, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for k, x in kept]


def table(spark, rows):
    return spark.createDataFrame([(k, 1, v, "own", 0.5) for k, v in rows], SCHEMA)


def check(spark, rows, width=1.0):
    got = whitening.whitened(table(spark, rows)).collect()
    n, s, cov, want = brute(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == k * len(want)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation) for r in got) == sorted((key is None, key or 0, c + 1, dev) for key, _, dev in want for c in range(k))
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4 and int(r.deviation_exact) == r.deviation
        assert r.explained == pytest.approx(values[r.component - 1] / cov.trace(), rel=1e-9)
        by.setdefault((r.vec_id, r.component), []).append(r.whitened)
    exact = {key: [(n * a - b) / n for a, b in zip(x, s, strict=True)] for key, x, _ in want if key is not None}
    for c in range(k):
        mine = np.array([by[key, c + 1][0] for key in exact])
        theirs = np.array([np.dot(exact[key], axes[:, c]) / math.sqrt(values[c]) for key in exact])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
    return got


def test_whitened_against_fractions(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0.1 * j, 0.3 + j / 7) for j in range(20)]) for k in range(120)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    rows += [(500 + k, rows[0][1]) for k in range(60)] + [(7, rows[7][1]), (None, rows[3][1])]  # copies count once in the fit
    odd = [(900, None), (901, [math.nan] * 20), (902, [math.inf, *[0.0] * 19]), (903, [None, *[0.0] * 19]), (904, [1e30, *[0.0] * 19]), (905, [0.5] * 7), (906, [])]
    got = check(spark, [*rows, *odd[:4]])
    assert len(whitening.whitened(table(spark, [*rows, *odd])).collect()) == len(got)


def test_wide_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-(1 << 61), 1 << 61, (150, 3)), rng.integers(-5, 5, (150, 2))], axis=1)
    sums, cross = whitening.scatter(x)
    assert sums.tolist() == [sum(map(int, c)) for c in x.T]
    assert cross.tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x.T] for p in x.T]


def test_deviation_that_no_long_holds(spark):
    rows = [(k, [float(v), float(-v)]) for k, v in enumerate((1e12, 3e15, 7e15, 0.0))]
    got = whitening.whitened(table(spark, [(k, [float(np.float32(c)) for c in v]) for k, v in rows])).collect()
    assert {r.component for r in got} == {1}
    assert all(r.deviation is None and r.deviation_exact > 2**63 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]])
def test_no_spread_no_component(spark, rows):
    assert whitening.whitened(table(spark, rows)).collect() == []
