"""Unions of rectangles against a raster, and floors of two parts."""

import math

import numpy as np
import pytest

from orrery.operators import floors

RECT = "scene_id string, lx double, lz double, hx double, hz double"


def raster(rects, n=24):
    """Area and outline of rectangles with whole sides, by cells."""
    grid = np.zeros((n + 2, n + 2), bool)
    for lx, lz, hx, hz in rects:
        grid[lx + 1 : hx + 1, lz + 1 : hz + 1] = True
    return int(grid.sum()), int((grid[1:] != grid[:-1]).sum() + (grid[:, 1:] != grid[:, :-1]).sum())


@pytest.mark.parametrize("strips", [4096, 1])
def test_unions_of_random_floors(spark, strips):
    rng = np.random.default_rng(1)
    scenes = {}
    for k in range(1000):
        low = rng.integers(0, 20, (rng.integers(1, 14), 2))
        scenes[f"s{k}"] = np.c_[low, np.minimum(low + rng.integers(1, 9, low.shape), 24)]
    scenes["many"] = np.c_[low := rng.integers(0, 22, (400, 2)), low + rng.integers(1, 3, low.shape)]
    rows = [(k, *map(float, r)) for k, v in scenes.items() for r in v] + [("s0", *map(float, scenes["s0"][0])), ("flat", 1.0, 1.0, 1.0, 5.0), ("odd", math.nan, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)]
    got = {r.scene_id: r for r in floors.unions(spark.createDataFrame(rows, RECT).repartition(5), strips).collect()}
    assert (got["flat"].area, got["flat"].outline, got["odd"].area) == (0, 0, 0) and None not in got
    for k, v in scenes.items():
        assert (got[k].area, got[k].outline) == pytest.approx(raster(v))


def test_two_part_floors(spark):
    scenes = spark.createDataFrame([(f"s{k}", -2.0, -2.0, 2.0, 2.0) for k in range(80)] + [("odd", None, 0.0, 1.0, 1.0)], RECT)
    by = {}
    for r in floors.two_part_floors(scenes).collect():
        by.setdefault(r.scene_id, {})[r.part] = r
    assert len(by) == 80 and all(sorted(p) == [0, 1] for p in by.values())
    straight = []
    for k, p in by.items():
        a, b = p[0], p[1]
        assert a.area == b.area == pytest.approx(a.dx * a.dz + b.dx * b.dz) and a.yaw == b.yaw
        assert abs((a.cx + b.cx) / 2) <= 2 and abs((a.cz + b.cz) / 2) <= 2 and 1.5 <= min(a.dx, b.dz) and max(a.dx, b.dz) <= 10
        c, s = math.cos(a.yaw), math.sin(a.yaw)
        dx, dz = c * (b.cx - a.cx) + s * (b.cz - a.cz), -s * (b.cx - a.cx) + c * (b.cz - a.cz)
        gaps = abs(dx) - (a.dx + b.dx) / 2, abs(dz) - (a.dz + b.dz) / 2
        assert max(gaps) == pytest.approx(0, abs=1e-9) and min(gaps) <= -0.3 + 1e-9  # they touch along 0.3 m at least
        straight += [(k, -a.dx / 2, -a.dz / 2, a.dx / 2, a.dz / 2), (k, dx - b.dx / 2, dz - b.dz / 2, dx + b.dx / 2, dz + b.dz / 2)]
    for r in floors.unions(spark.createDataFrame(straight, RECT)).collect():
        assert r.area == pytest.approx(by[r.scene_id][0].area, rel=1e-6)


def test_rectangles_that_pass_strips_are_joined_first(spark):
    """A sweep makes rows in proportion to the rectangles, where most lie over each other."""
    rng = np.random.default_rng(3)

    def made(n):
        low = rng.normal(0.0, 0.12, (n, 2))
        rects = np.c_[low, low + np.abs(rng.normal(0.0, 0.12, (n, 2))) / 2 + 0.01]
        df = spark.createDataFrame([("s", *map(float, r)) for r in rects], RECT)
        swept = floors._swept(df, "x", "z", 4096)
        swept.collect()
        return sum(rows_of(swept._jdf.queryExecution().executedPlan()))

    def rows_of(plan):
        node = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            node = node.plan()
        metrics = node.metrics()
        mine = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        children = node.children()
        return [mine, *[n for i in range(children.size()) for n in rows_of(children.apply(i))]]

    small, large = made(1_000), made(4_000)
    assert large < 6 * small
