"""Exact quantiles against numpy, with ranges narrowed in many passes."""

import math

import numpy as np
import pytest

from orrery.operators import ranks

SHARES = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]


def between(x, q):
    """The quantile of sorted values, linear between two."""
    at = q * (len(x) - 1)
    low, high = math.floor(at), math.ceil(at)
    return x[low] if low == high else (high - at) * x[low] + (at - low) * x[high]


@pytest.mark.parametrize("few,cells", [(50_000, 1024), (7, 4), (1, 3)])
def test_quantiles(spark, monkeypatch, few, cells):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CELLS", cells)
    rng = np.random.default_rng(few)
    groups = {
        "even": rng.uniform(-5, 5, 300), "ties": rng.integers(0, 3, 200).astype(float), "wide": np.r_[rng.normal(0, 1, 100), [1e300, -1e300, 1e-300]],
        "equal": np.full(50, 2.5), "one": np.array([-7.0]), "inf": np.array([math.inf, -math.inf, 1.0, 2.0, math.inf]),
    }
    rows = [(k, float(v), float(-v)) for k, vs in groups.items() for v in vs] + [("even", None, None), ("none", None, 1.0), (None, 3.0, 4.0), (None, 5.0, 4.0)]
    got = {r.k: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, a double, b double").repartition(3), ["k"], ["a", "b"], SHARES).collect()}
    assert got.keys() == {*groups, "none", None}
    for k, v in groups.items():
        for name, x in (("a_q", v), ("b_q", -v)):
            for g, w in zip(got[k][name], [between(sorted(x.tolist()), q) for q in SHARES], strict=True):
                assert (math.isnan(g) and math.isnan(w)) or g == pytest.approx(w, rel=1e-12, abs=1e-300)
    assert got["none"].a_q is None and got["none"].b_q == [1.0] * 6
    assert got[None].a_q[3] == 4.0


def test_all_rows_as_one_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 5)
    df = spark.range(1001).selectExpr("cast(id * 7919 % 1001 AS double) AS v")
    (row,) = ranks.quantiles(df, [], ["v"], [0.5, 0.9]).collect()
    assert row.v_q == [500.0, 900.0]
    (none,) = ranks.quantiles(df.where("v < 0"), [], ["v"], [0.5]).collect()
    assert none.v_q is None


def test_nan_is_greatest(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    low, high = ranks.quantiles(df, [], ["v"], [0.5, 1.0]).first().v_q
    assert low == 2.0 and math.isnan(high)
