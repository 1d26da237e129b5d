"""Turns of moves and refaces against a fold, and drawn routes against their own turns."""

import math
import random

import numpy as np
import pytest

from orrery.operators import routes

SCENE = "scene_id string, lx double, ly double, lz double, hx double, hy double, hz double"


def turn(h, t):
    if np.hypot(*h) < 1e-3 or np.hypot(*t) < 1e-3:
        return "Turn Right"
    dot, cross = (h[0] * t[0] + h[1] * t[1]) / np.hypot(*h) / np.hypot(*t), h[0] * t[1] - h[1] * t[0]
    return "Turn Back" if dot < math.cos(math.radians(135)) else "Turn Left" if cross > 0 else "Turn Right"


def folded(actions):
    """Turns of one key's (kind, x, z) in order."""
    at = heading = None
    out = []
    for kind, x, z in actions:
        to = (x - at[0], z - at[1]) if at else None
        out.append(turn(heading, to) if heading and to else None)
        heading = to or heading
        at = at if kind == "face" else (x, z)
    return out


@pytest.mark.parametrize("width", [3.0, 1e6])
def test_turns_of_moves_and_refaces(spark, width):
    rng = random.Random(4)
    keys = {k: [(rng.choice(["move", "move", "face", None]), rng.choice([rng.uniform(-3, 3), 1.0]), rng.choice([rng.uniform(-3, 3), 1.0])) for _ in range(n)] for k, n in (("a", 40), ("b", 1), ("c", 2), ("hot", 300))}
    keys["d"] = [("face", 1.0, 1.0), ("face", 2.0, 1.0), ("move", 0.0, 0.0), ("face", 1.0, 0.0), ("move", 0.0, 1.0)]
    rows = [(k, i * 2, *a) for k, v in keys.items() for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, o int, kind string, x double, z double").repartition(4)
    got = {}
    for r in routes.action_turns(df, ["k"], "o", width).orderBy("o").collect():
        got.setdefault(r.k, []).append(r.turn)
    assert got == {k: folded(v) for k, v in keys.items()}
    assert got["d"] == [None, None, None, None, "Turn Left"]


@pytest.mark.parametrize("turns,reface,named", [(1, False, False), (3, False, False), (2, True, False), (2, True, True), (4, False, True)])
def test_drawn_routes_ask_for_their_turns(spark, turns, reface, named):
    scenes = spark.createDataFrame([(f"s{k}", -2.0, -1.0, -2.0, 2.0, 1.0, 2.0) for k in range(60)] + [("bare", *[0.5] * 6), (None, *[0.0] * 6)], SCENE)
    things = spark.createDataFrame([(f"s{k}", f"l{j}", 0.1 + 0.1 * j) for k in range(60) for j in range(turns + 4)], "scene_id string, label string, radius double") if named else None
    done = routes.drawn_routes(scenes, turns, reface, things)
    rows = done.accepted.collect()
    if named:
        assert [(r.scene_id, r.reason) for r in done.open.collect()] == [("bare", "objects")]
    assert len(rows) == 60 + (not named)
    seen = set()
    for r in rows:
        seen.update(r.turns)
        assert len(r.turns) == turns + reface and len(r.places) == turns + 2 + reface
        assert [x for x in folded([(p.kind, p.x, p.z) for p in r.places]) if x] == r.turns
        assert [p.kind for p in r.places].count("face") == reface
        assert min(math.sqrt(p.x**2 + p.y**2 + p.z**2) for p in r.places) > 0.1
        if named:
            assert len({p.label for p in r.places}) == len(r.places)
            assert all(math.hypot(p.x - q.x, p.z - q.z) >= p.radius + q.radius for i, p in enumerate(r.places) for q in r.places[:i])
    assert {"Turn Left", "Turn Right"} <= seen and ("Turn Back" in seen) == reface


def test_turns_along_one_line_and_after_nulls(spark):
    import duckdb
    from orrery.plans import placing

    import __spark_entry__  # noqa: F401  every query is registered
    from orrery.plans.base import SQL

    rng = random.Random(8)
    rows, n = [], 0
    for user in range(60):
        # whole steps along one line: their unit vectors round, the steps do not
        a, b = rng.randint(1, 30), rng.randint(1, 9)
        z = rng.randint(0, 9)
        for k in range(9):
            rows.append((z + b * k + 97 * n, user, rng.choice(["view", "buy"]), None if user == 7 and k == 4 else float(a * k), "2024-01-01"))
            n += 1
    import tempfile

    import pandas as pd

    folder = tempfile.mkdtemp(prefix="orrery-test-")
    events = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value", "ts"])
    events.to_parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = sorted(con.execute(SQL["action_turns"]).fetchall(), key=repr)
    got = sorted([(r.user_id, r.event_id, r.turn) for r in placing.action_turns(spark, folder).collect()], key=repr)
    assert got == want


def turn_labels_and_sql(spark, folder, rows):
    import duckdb
    import pandas as pd

    import __spark_entry__  # noqa: F401  every query is registered
    from orrery.plans.base import SQL
    from orrery.plans.spatial import turn_labels

    events = pd.DataFrame(rows, columns=["event_id", "user_id", "value"]).astype({"event_id": "Int64", "user_id": "Int64", "value": "Float64"})
    events.assign(event_type="view", ts=pd.Timestamp("2024-01-01")).to_parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = sorted(con.execute(SQL["turn_labels"]).fetchall(), key=repr)
    return sorted([(r.user_id, r.turns, r.n) for r in turn_labels(spark, str(folder)).collect()], key=repr), want


def test_turn_labels_along_one_line_go_by_unit_vectors(spark, tmp_path):
    # steps (a, b) and (m * a, m * b): their cross product is zero, that of their unit vectors is so for some only
    rows = [(97 * (40 * user + k) + z, user, x) for user, (a, b, m) in enumerate((a, b, m) for a in (1, 2, 3, 7, 11) for b in (1, 2, 5, 9) for m in (2, 3, 7)) for k, (z, x) in enumerate([(0, 0.0), (b, float(a)), (b + m * b, float(a + m * a))])]
    got, want = turn_labels_and_sql(spark, tmp_path, rows)
    assert len({turns for _, turns, _ in want}) == 2  # left and right
    assert got == want


def test_turn_labels_take_events_without_id_last(spark, tmp_path):
    path = [(1, 0.0), (4, 5.0), (6, 1.0), (None, 9.0), (98, 2.0), (110, None), (120, 4.0), (140, 8.0)]
    rows = [(None if i is None else i + 970 * user, user or None, x) for user in range(3) for i, x in path]
    got, want = turn_labels_and_sql(spark, tmp_path, rows)
    assert len(want) == 3
    assert got == want
