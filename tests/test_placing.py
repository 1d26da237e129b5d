"""Placement with exclusions and visibility, each against a brute-force version."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.operators import cells, joins, placing

BOX = "scene_id string, lx double, ly double, lz double, hx double, hy double, hz double"


def uniform(*key, seed):
    """The operator's draw, by hand."""
    return int(hashlib.md5("|".join([*map(str, key), str(seed)]).encode()).hexdigest()[:15], 16) / 16**15


def number(*key, seed):
    return int(hashlib.md5("|".join([*map(str, key), str(seed)]).encode()).hexdigest()[:15], 16)


def segment_distance(c, p, q):
    d = q - p
    t = 0.0 if not d @ d else min(1.0, max(0.0, (c - p) @ d / (d @ d)))
    return np.linalg.norm(c - p - t * d)


def drawn(scene, slot, attempt, low, high, seed):
    u = lambda name, a, b: a + uniform(scene, slot, attempt, name, seed=seed) * (b - a)
    a = math.exp(u("a", math.log(0.2), math.log(1.0)))
    b, c = (math.exp(u(n, math.log(0.1), math.log(a))) for n in "bc")
    sides = [v for _, v in sorted((number(scene, slot, attempt, "turn" + n, seed=seed), v) for n, v in zip("abc", (a, b, c), strict=True))]
    centre = np.array([u(n, lo, hi) for n, lo, hi in zip("xyz", low, high, strict=True)])
    return centre, sides, math.sqrt(sum(v * v for v in sides)) / 2


def expected(scenes, boxes, paths, guards, low, high, seed, tries, each):
    """Round by round as stated: picks, then clashes by slot; what every draw ended for."""
    placed, census, still = {}, Counter(), {}
    for scene, lo, hi in scenes:
        slots = low + number(scene, "slots", seed=seed) % (high - low + 1)
        mine = [(np.array(b[:3]), math.sqrt(sum(v * v for v in b[3:])) / 2) for s, *b in boxes if s == scene]
        ways = [(np.array(p[:3]), np.array(p[3:6]), p[6] + 0.05) for s, *p in paths if s == scene]
        kept = [(np.array(g[:3]), np.array(g[3:])) for s, *g in guards if s == scene]
        open_, why = list(range(1, slots + 1)), defaultdict(Counter)
        for turn in range(math.ceil(tries / each)):
            picks = {}
            for slot in open_:
                for attempt in range(turn * each, min(tries, (turn + 1) * each)):
                    c, sides, r = drawn(scene, slot, attempt, lo, hi, seed)
                    reason = None
                    if any(np.linalg.norm(c - m) < r + q for m, q in mine):
                        reason = "box"
                    elif any(np.linalg.norm(c - np.clip(c, *g)) < r for g in kept):
                        reason = "guard"
                    elif any(segment_distance(c, p, q) < r + w for p, q, w in ways):
                        reason = "corridor"
                    if reason is None:
                        picks[slot] = (c, sides, r, attempt)
                        break
                    census[turn, reason] += 1
                    why[slot][reason] += 1
            won = []
            for slot, (c, sides, r, attempt) in sorted(picks.items()):
                if any(o < slot and np.linalg.norm(c - x[0]) < r + x[2] for o, x in picks.items()):
                    census[turn, "clash"] += 1
                    why[slot]["clash"] += 1
                else:
                    census[turn, "accepted"] += 1
                    placed[scene, slot] = (c, sides, attempt)
                    won.append(slot)
                    mine.append((c, r))
            open_ = [s for s in open_ if s not in won]
        still |= {(scene, s): max(why[s], key=lambda k, s=s: (why[s][k], k)) for s in open_}
    return placed, census, still


def test_distractors_against_every_exclusion(spark):
    rng = np.random.default_rng(1)
    scenes = [(f"s{k}", [-2.0, -1.0, -2.0], [2.0, 1.0, 2.0]) for k in range(25)] + [("tight", [0.0, 0.0, 0.0], [0.4, 0.4, 0.4]), ("flat", [0.0, 0.0, 0.0], [3.0, 0.0, 3.0])]
    boxes = [(s, *rng.uniform(lo, hi), *rng.uniform(0.1, 0.8, 3)) for s, lo, hi in scenes for _ in range(3)]
    paths = [(s, *rng.uniform(lo, hi), *rng.uniform(lo, hi), 0.2) for s, lo, hi in scenes for _ in range(2)] + [("s0", -1e6, 0.0, 0.0, 1e6, 0.1, 0.0, 0.3), ("s1", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5)]
    guards = [(s, *(c := rng.uniform(lo, hi)), *(c + 0.5)) for s, lo, hi in scenes[:12]]
    frame = lambda rows, names: spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "scene_id string, " + ", ".join(f"{n} double" for n in names.split()))
    got = placing.distractors(
        spark.createDataFrame([(s, *lo, *hi) for s, lo, hi in scenes] + [(None, *[0.0] * 6), ("odd", math.nan, *[0.0] * 5)], BOX),
        frame(boxes + [("s2", math.nan, 0, 0, 1, 1, 1)], "x y z dx dy dz"), frame(paths, "x0 y0 z0 x1 y1 z1 radius"), frame(guards, "lx ly lz hx hy hz"), low=2, high=4, seed=7, tries=12, each=5,
    )
    placed, census, still = expected(scenes, boxes, paths, guards, 2, 4, 7, 12, 5)
    rows = {(r.scene_id, r.slot): r for r in got.accepted.collect()}
    assert rows.keys() == placed.keys() and still
    for k, (c, sides, attempt) in placed.items():
        r = rows[k]
        assert r.attempt == attempt and np.allclose([r.x, r.y, r.z], c) and np.allclose([r.dx, r.dy, r.dz], sides)
    assert {(r.scene_id, r.slot): r.reason for r in got.open.collect()} == still
    ended = {(r.round, r.reason): r.n for r in got.census.collect()}
    assert {k: v for k, v in ended.items() if k[0] >= 0} == dict(census)
    assert ended[-1, "filled"] == len(placed) == sum(v for (t, k), v in ended.items() if k == "accepted") and ended[-1, "open"] == len(still)
    assert {"box", "guard", "corridor", "clash"} <= {k for _, k in census}


def test_no_scenes_no_slots(spark):
    none = placing.distractors(spark.createDataFrame([], BOX), spark.createDataFrame([], "scene_id string, x double, y double, z double, dx double, dy double, dz double"))
    assert none.accepted.collect() == [] and none.census.collect() == [] and none.open.collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_paths_and_boxes_by_cells(spark, seed):
    rng = np.random.default_rng(seed)
    points = [(str(k % 3), k, *rng.normal(0, 3, 3), rng.uniform(0, 1)) for k in range(300)]
    paths = [(str(k % 3), *rng.normal(0, 3, 3), *(rng.normal(0, 3, 3) if k % 5 else rng.normal(0, 3000, 3)), rng.choice([0.0, 0.1, 2.5])) for k in range(25)]
    boxes = [(str(k % 3), *(c := rng.normal(0, 3, 3)), *(c + rng.choice([0.01, 1.0, 4.0], 3))) for k in range(20)]
    p = spark.createDataFrame([(s, k, *map(float, v)) for s, k, *v in points], "scene_id string, k int, x double, y double, z double, r double")
    o = spark.createDataFrame([(s, *map(float, v)) for s, *v in paths], "scene_id string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, radius double")
    b = spark.createDataFrame([(s, *map(float, v)) for s, *v in boxes], BOX)
    near = {k for s, k, *c, r in points if any(s == t and segment_distance(np.array(c), np.array(w[:3]), np.array(w[3:6])) < r + w[6] for t, *w in paths)}
    assert {r.k for r in cells.near_paths(p, o, "scene_id", 1.0).collect()} == near
    inside = {k for s, k, *c, r in points if any(s == t and np.linalg.norm(np.array(c) - np.clip(c, g[:3], g[3:])) < r for t, *g in boxes)}
    assert {r.k for r in cells.near_boxes(p, b, "scene_id", 1.0).collect()} == inside
    assert near and inside and len(near) < 300


def hits(p, q, low, high):
    enter, leave = -math.inf, math.inf
    for a, b, lo, hi in zip(p, q, low, high, strict=True):
        if abs(b - a) <= 1e-8:
            if not lo <= a <= hi:
                return False
            continue
        one, two = sorted(((lo - a) / (b - a), (hi - a) / (b - a)))
        enter, leave = max(enter, one), min(leave, two)
    return enter < leave and leave > 0 and enter < 1


def test_seen_shares_against_brute_force(spark):
    rng = np.random.default_rng(3)
    views = [(str(s), f"v{s}{k}", *rng.normal(0, 2, 3)) for s in range(3) for k in range(4)]
    things = [(str(s), f"t{s}{k}", *rng.normal(0, 2, 3), *rng.uniform(0.1, 1.0, 3)) for s in range(3) for k in range(8)]
    v = spark.createDataFrame([(s, k, *map(float, c)) for s, k, *c in views] + [("0", None, 1.0, math.nan, 0.0)], "scene_id string, view string, x double, y double, z double")
    t = spark.createDataFrame([(s, w[1], k, *map(float, c)) for s, k, *c in things for w in views if w[0] == s], "scene_id string, view string, target string, x double, y double, z double, dx double, dy double, dz double")
    o = spark.createDataFrame([(s, k, *[float(c[i] - c[i + 3] / 2) for i in range(3)], *[float(c[i] + c[i + 3] / 2) for i in range(3)]) for s, k, *c in things], BOX.replace("lx", "target string, lx"))
    got = {(r.view, r.target): r for r in placing.seen_shares(v, t, o, rays=15, seed=8).collect()}
    assert len(got) == 3 * 4 * 8 and {r.answer for r in got.values()} == {"yes", "no"}
    for s, view, *eye in views:
        for s2, name, *c in things:
            if s == s2:
                free = 0
                for ray in range(15):
                    q = [c[i] + (uniform(view, name, ray, "xyz"[i], seed=8) - 0.5) * c[i + 3] for i in range(3)]
                    free += not any(hits(eye, q, np.array(b[:3]) - np.array(b[3:]) / 2, np.array(b[:3]) + np.array(b[3:]) / 2) for t_, other, *b in things if t_ == s and other != name)
                assert got[view, name].free == free and got[view, name].answer == ("yes" if free / 15 >= 0.1 else "no")


def test_sightlines_bear_their_answers_out(spark):
    scenes = spark.createDataFrame([(f"s{k}", -2.0, -1.0, -2.0, 2.0, 1.0, 2.0) for k in range(60)] + [(None, *[0.0] * 6)], BOX)
    done = placing.sightlines(scenes, rays=30, tries=75)
    rows, ended = done.accepted.collect(), {(r.round, r.reason): r.n for r in done.census.collect()}
    rng = np.random.default_rng(5)
    assert len(rows) + ended.get((-1, "open"), 0) == 60 and len(rows) > 55
    assert Counter(r.mode for r in rows).keys() == {"blocked", "clear", "partial"}
    for r in rows:
        p, q, o = (np.array([r[n + a] for a in "xyz"]) for n in "pqo")
        assert np.linalg.norm(q - p) == pytest.approx(r.d)
        share = np.mean([not hits(p, q + rng.uniform(-0.15, 0.15, 3), o - r.s / 2, o + r.s / 2) for _ in range(400)])
        assert share < 0.25 if r.answer == "no" else share > 0.02
        assert share > 0.85 if r.mode == "clear" else share < 0.97
        reach = math.sqrt(3) / 2 * r.s
        assert np.linalg.norm(o - p) >= reach and np.linalg.norm(o - q) >= reach


def test_long_segments_are_clipped_to_their_scene(spark):
    """A segment of a million units makes rows for the cells that its scene has boxes in, not for its length."""
    s = spark.createDataFrame([("a", -1e6, 0.0, 0.0, 1e6, 0.0, 0.0), ("a", -1e6, 5.0, 0.0, 1e6, 5.0, 0.0)], "scene_id string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    o = spark.createDataFrame([("a", 3.0, -0.01, -0.01, 3.02, 0.01, 0.01), ("a", 9.0, 7.0, 7.0, 9.02, 7.01, 7.01)], BOX)
    assert [r.y0 for r in joins.unblocked(s, o, "scene_id", 0.01).collect()] == [5.0]


def test_class_grounding_answers_score_full_marks(spark):
    from pyspark.sql import functions as F

    from orrery.functions import boxes

    rng = np.random.default_rng(6)
    rows = [(f"s{s}", k, f"c{rng.integers(0, 5)}", [float(v) for v in np.r_[rng.normal(0, 4, 3), rng.uniform(0.3, 2, 3)]]) for s in range(12) for k in range(15)]
    rows += [("s0", 99, "c9", [1.0] * 5), ("s0", None, "c9", [1.0] * 6), ("unseen", 1, "c1", [1.0] * 6)]
    o = spark.createDataFrame(rows, "scene_id string, object_id long, label string, box array<double>")
    seen = o.where("object_id % 7 != 0 OR scene_id = 's3'").where("scene_id != 'unseen'").select("scene_id", "object_id")
    out = placing.class_grounding(o, seen, most=6)
    got = out.select("*", boxes.greedy_f1(0.25)(boxes.parsed_many(F.col("answer")), F.col("boxes")).alias("f1")).collect()
    visible = {(r.scene_id, r.object_id) for r in seen.collect()}
    assert len(got) > 8 and "unseen" not in {r.scene_id for r in got}
    for r in got:
        mine = [(k, b) for s, k, c, b in rows if s == r.scene_id and c == r.label and k is not None and len(b) == 6]
        assert r.f1 == 1.0 and r.n == len(mine) == len(r.boxes) <= 6 and all((r.scene_id, k) in visible for k, _ in mine)
        assert [sum(v * v for v in b[:3]) for b in r.boxes] == sorted(sum(v * v for v in b[:3]) for _, b in mine)
