"""Nearest points against all pairs."""

import math

import numpy as np
import pytest

from orrery.operators import nearby


@pytest.mark.parametrize("leaf", [1, 16])
def test_pairs_of_sets(spark, monkeypatch, leaf):
    monkeypatch.setattr(nearby, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    sets = {
        "even": rng.uniform(-1, 1, (150, 3)), "far": rng.normal(50, 0.1, (60, 3)), "line": np.c_[np.linspace(-9, 9, 90), np.zeros((90, 2))], "one": np.array([[2.0, 2.0, 2.0]]),
        "crowd": np.r_[np.full((70, 3), 0.25), rng.normal(0, 1e-6, (70, 3)), [[1e9, 0, 0]]], "equal": np.full((40, 3), 7.0),
    }
    rows = [(k, *map(float, p)) for k, v in sets.items() for p in v] + [("even", math.nan, 0.0, 0.0), ("none", None, 1.0, 1.0), (None, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double, z double")
    pairs = [(a, b) for a in sets for b in sets] + [("even", "even"), ("none", "one"), ("gone", "one"), (None, "one")]
    got = {(r.a_key, r.b_key): r.distance for r in nearby.nearest_pair(spark.createDataFrame(pairs, "a_key string, b_key string"), points, points, "k").collect()}
    assert got.pop(("none", "one")) is None
    assert got.keys() == {(a, b) for a in sets for b in sets}
    for (a, b), d in got.items():
        assert d == pytest.approx(np.sqrt(((sets[a][:, None] - sets[b][None]) ** 2).sum(-1).min()), abs=1e-12)


@pytest.mark.parametrize("leaf", [1, 16])
def test_pixels_to_patches(spark, monkeypatch, leaf):
    monkeypatch.setattr(nearby, "LEAF", leaf)
    rng = np.random.default_rng(9)
    patches = [("a", int(r), int(c), k) for k, (r, c) in enumerate(rng.integers(0, 60, (200, 2)))] + [("b", 500, 3, 7), ("b", 500, 3, 5), ("c", None, 1, 1)]
    pixels = [("a", int(r), int(c)) for r, c in rng.integers(-10, 90, (250, 2))] + [("a", 1, 1), ("a", 1, 1), ("b", 0, 0), ("c", 4, 4), ("d", 2, 2)]
    got = nearby.nearest_patch(spark.createDataFrame(pixels, "f string, row int, col int"), spark.createDataFrame(patches, "f string, row int, col int, idx int"), "f").collect()
    assert len(got) == len(set(pixels))
    for r in got:
        there = [(max(abs(p - r.row), abs(q - r.col)), abs(p - r.row), abs(q - r.col), k) for f, p, q, k in patches if f == r.f and p is not None]
        assert r.idx == (min(there)[3] if there else 0)


def test_a_crowded_set_makes_few_rows(spark):
    """4,000 points against 4,000 in a corner of the other's box: far from all 16 million pairs at any step."""
    rng = np.random.default_rng(4)
    rows = [("a", *map(float, p)) for p in rng.normal(0, 1, (4000, 3))] + [("b", *map(float, p)) for p in np.r_[rng.normal(3, 0.2, (3999, 3)), [[1e6, 1e6, 1e6]]]]
    points = spark.createDataFrame(rows, "k string, x double, y double, z double")
    out = nearby.nearest_pair(spark.createDataFrame([("a", "b")], "a_key string, b_key string"), points, points, "k")
    a, b = (np.array([r[1:] for r in rows if r[0] == k]) for k in "ab")
    best = min(float(((a - p) ** 2).sum(1).min()) for p in b)
    assert out.first().distance == pytest.approx(math.sqrt(best), abs=1e-12)
