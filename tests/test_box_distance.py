"""Exact box distances against a minimisation over both boxes, and questions drawn by them."""

import numpy as np
import pytest

from orrery.functions import boxes
from orrery.operators import placing


def minimised(a, b, rounds=4000):
    """Least distance of points of two boxes by projection onto each in turn, with momentum."""
    (ca, ha, ra), (cb, hb, rb) = (tuple(x[0] for x in boxes._frames(v[None])) for v in (a, b))
    project = lambda x, c, h, r: c + r @ np.clip(r.T @ (x - c), -h, h)
    q, best = cb.copy(), np.inf
    last, t = q.copy(), 1.0
    for _ in range(rounds):
        p = project(q, ca, ha, ra)
        new = project(p, cb, hb, rb)
        best = min(best, np.linalg.norm(p - new))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        q, last, t = new + (t - 1) / t_next * (new - last), new, t_next
        q = project(q, cb, hb, rb)
    return best


def test_distances_against_minimisation():
    rng = np.random.default_rng(2)
    a, b = (np.c_[rng.normal(0, 1.2, (150, 3)), rng.uniform(0.05, 2.0, (150, 3)), rng.uniform(-3, 3, (150, 3))] for _ in range(2))
    a[:10, 6:], b[:10, 6:] = 0, 0  # parallel faces and edges
    a[10:15, 3], b[12:18, 3:5] = 0, 0  # flat ones
    got = boxes.distances(a, b)
    want = np.array([minimised(x, y) for x, y in zip(a, b, strict=True)])
    assert np.abs(got - want).max() < 1e-6
    assert (got == 0).sum() > 10 and (got > 0.1).sum() > 50
    assert np.allclose(boxes.distances(b, a), got, atol=1e-12)


def test_crossing_bars_meet_without_a_corner_inside():
    bar = np.array([[0, 0, 0, 4, 0.2, 0.2, 0, 0, 0], [0, 0, 0, 0.2, 4, 0.2, 0, 0, 0], [0, 0, 0.5, 0.2, 4, 0.2, 0.3, 0, 0]], float)
    assert boxes.distances(bar[:1], bar[1:2])[0] == 0
    assert boxes.distances(bar[:1], bar[2:])[0] == pytest.approx(0.3)


def test_column_with_nulls(spark):
    unit = [0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(unit, [3.0, *unit[1:]]), (None, unit), ([None, *unit[1:]], unit)], "a array<double>, b array<double>")
    assert [r.d for r in df.select(boxes.box_distance()("a", "b").alias("d")).collect()] == [2.0, None, None]


@pytest.mark.parametrize("count", [2, 5])
def test_questions_have_clear_answers(spark, count):
    scenes = spark.createDataFrame([(f"s{k}", -3.0, -2.0, -3.0, 3.0, 2.0, 3.0) for k in range(40)] + [("small", *[0.0] * 3, *[0.1] * 3)], "scene_id string, lx double, ly double, lz double, hx double, hy double, hz double")
    done = placing.box_sets(scenes, count)
    rows = done.accepted.collect()
    assert [r.scene_id for r in done.open.collect()] == ["small"] and len(rows) == 40
    for r in rows:
        b = np.array(r.boxes)
        d = [boxes.distances(b[:1], b[j : j + 1])[0] for j in range(1, count)]
        assert np.allclose(d, r.distances)
        ordered = sorted(d)
        assert (ordered[0] > 0.05) if count == 2 else (ordered[1] - ordered[0] >= 0.05 and r.answer == "ABCD"[int(np.argmin(d))])
    ended = {(r.round, r.reason): r.n for r in done.census.collect()}
    assert sum(n for (t, reason), n in ended.items() if reason == "accepted") == 40 and ended[-1, "open"] == 1
