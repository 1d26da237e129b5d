"""Points counted in oriented boxes by a tree against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import boxes
from orrery.operators import joins

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("chunk,block", [(65536, 4096), (40, 8)])
def test_held_counts_are_those_of_all_pairs(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(joins, "CHUNK", chunk)
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(boxes, "LEAF", 4)
    rng = random.Random(3)
    value = lambda: rng.choice([rng.gauss(0, 1), float(round(rng.gauss(0, 1))), 0.0])
    rows = [(s, value(), value(), value()) for s in (1, 1, 1, 2) for _ in range(60)] + [(1, 0.5, 0.5, 0.5)] * 100
    rows += [(1, NAN, 0.0, 0.0), (1, INF, 0.0, 0.0), (1, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (2, 0.0, -INF, NAN), (3, 0.0, 0.0, 0.0), (5, NAN, 0.0, 0.0)]
    sides = [[abs(value()) + 0.5 for _ in range(3)] for _ in range(90)]
    objects = [(k, rng.choice([1, 1, 2, 4]), [value(), value(), value(), *d, value(), value(), value()]) for k, d in enumerate(sides)]
    unit = [0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    for k, (i, v) in enumerate([(0, NAN), (3, NAN), (3, INF), (4, -1.0), (6, INF), (8, None), (5, None), (0, INF), (4, 2.0)], 200):
        objects.append((k, 1, [*unit[:i], v, *unit[i + 1 :]]))
    objects += [(300, 5, [0.0, 0.0, 0.0, NAN, NAN, NAN, 0.0, 0.0, 0.0]), (301, 5, unit), (302, None, unit), (303, 1, None)]
    p = spark.createDataFrame(rows, "scene int, x double, y double, z double")
    o = spark.createDataFrame(objects, "box long, scene int, obb array<double>")
    want = p.join(o, "scene").where(boxes.holds(F.col("obb"), *[F.col(a) for a in "xyz"], inflation=0.05)).groupBy("box").agg(F.count("*").alias("n"))
    got = joins.held_counts(p, o, "scene", "box", "obb", "xyz", 0.05)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pairs = joins.inside_boxes(p, o, "scene", "obb", "xyz", 0.05)
    assert set(pairs.columns) == {"scene", "x", "y", "z", "box", "obb"} and pairs.count() == sum(r.n for r in want.collect())


def test_a_box_looks_at_the_points_near_its_faces_alone(monkeypatch):
    looked = []

    class Counted(np.ndarray):
        def __array_ufunc__(self, f, method, *args, **kwargs):
            plain = [a.view(np.ndarray) if isinstance(a, Counted) else a for a in args]
            if f is np.subtract and plain[1].ndim == 2 and plain[1].shape[1] == 1:
                looked.append(plain[0].size * plain[1].size)
            return getattr(f, method)(*plain, **kwargs)

    rng = np.random.default_rng(4)
    points = rng.uniform(-1, 1, (20000, 3))
    turned = np.array([[0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0.5, 0.5, 0.5]] * 10, float)
    turned[:, :3] = rng.uniform(-0.2, 0.2, (10, 3))
    found = boxes.held(points.view(Counted), np.ones(20000, np.int64), turned)
    assert found.tolist() == [int((np.abs(points - b[:3]) <= 0.5).all(axis=1).sum()) for b in turned]
    assert 0 < sum(looked) / 3 < 0.5 * 20000 * 10
