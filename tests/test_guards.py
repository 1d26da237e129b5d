"""Guards, policies, overrides and grids on small tables worked out by hand or by every pair."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orrery.functions import boxes
from orrery.operators import annotations, joins, reports


def test_segments_against_every_box(spark):
    r = random.Random(5)
    numbers = lambda n, wide: [r.uniform(-wide, wide) for _ in range(n)]
    segments = [(i % 3, i, *numbers(6, 2)) for i in range(200)]
    segments += [(0, 900, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (0, 901, None, 0.0, 0.0, 1.0, 1.0, 1.0), (None, 902, *numbers(6, 1)), (1, 903, -50.0, 0.1, 0.1, 50.0, 0.1, 0.1)]
    occluders = []
    for i in range(60):
        low = numbers(3, 2)
        size = [r.choice((0.0, 0.05, 0.4, 3.0)) for _ in range(3)]
        occluders.append((i % 3, *[v for a, b in zip(low, size, strict=True) for v in (a, a + b)]))
    occluders += [(0, None, 1.0, 0.0, 1.0, 0.0, 1.0), (0, 0.0, float("inf"), 0.0, 1.0, 0.0, 1.0)]

    def hit(s, o):
        near, far = float("-inf"), float("inf")
        for i in range(3):
            p, q, lo, hi = s[2 + i], s[5 + i], o[1 + 2 * i], o[2 + 2 * i]
            if abs(q - p) <= 1e-8:
                if not lo <= p <= hi:
                    return False
                continue
            a, b = sorted(((lo - p) / (q - p), (hi - p) / (q - p)))
            near, far = max(near, a), min(far, b)
        return near < far and far > 0 and near < 1

    whole = [o for o in occluders if None not in o and float("inf") not in o]
    want = sorted(s[1] for s in segments if s[0] is None or None in s or not any(o[0] == s[0] and hit(s, o) for o in whole))
    coords = ", ".join(f"{a}{e} double" for e in "01" for a in "xyz")
    s = spark.createDataFrame(segments, f"scene int, id int, {coords}")
    o = spark.createDataFrame(occluders, "scene int, " + ", ".join(f"{e}{a} double" for a in "xyz" for e in "lh"))
    for cell in (0.1, 1.0):
        got = sorted(x.id for x in joins.unblocked(s, o, "scene", cell).select("id").collect())
        assert got == want
        assert 0 < len(got) < len(segments)
    assert joins.unblocked(s, o.limit(0), "scene").count() == len(segments)


def test_overridden(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "k int, name string, v int")
    truth = spark.createDataFrame([(1, 5), (1, 4), (3, 9), (None, 7)], "k int, v int")
    assert [tuple(r) for r in joins.overridden(rows, truth, ["k"], ["v"]).collect()] == [(1, "a", 4)]


def test_dense(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), (None, True)], "scene string, ok boolean")
    assert sorted(str(r.scene) for r in reports.dense(rows, "scene", F.col("ok")).collect()) == ["None", "a", "b"]
    with pytest.raises(PySparkException, match="2 of 3 rows dropped of a"):
        reports.dense(rows.union(spark.createDataFrame([("a", False)], rows.schema)), "scene", F.col("ok")).collect()
    with pytest.raises(PySparkException, match="1 of 1 rows dropped of z"):
        reports.dense(spark.createDataFrame([("z", False)], rows.schema), "scene", F.col("ok")).collect()
    assert reports.dense(rows.limit(0), "scene", F.col("ok")).count() == 0


def test_frame_sizes(spark):
    scenes = spark.createDataFrame([("a", 640, 480), ("b", 1920, 1440), ("c", 320, 240), ("d", None, None)], "scene string, width int, height int")
    seen = lambda df: {r.scene: (tuple(r.effective)[0], r.mismatch) for r in df.collect() if r.width}
    assert seen(annotations.sized(scenes, (640, 480), "cap", most=(640, 480))) == {"a": (640, False), "b": (640, False), "c": (320, False)}
    assert seen(annotations.sized(scenes, (640, 480), "exact", "warn", most=(640, 480))) == {"a": (640, False), "b": (640, True), "c": (640, True)}
    assert seen(annotations.sized(scenes, (640, 480), "exact", "off")) == {"a": (640, False), "b": (1920, False), "c": (320, False)}
    with pytest.raises(PySparkException, match="not 640x480"):
        annotations.sized(scenes, (640, 480)).collect()
    with pytest.raises(ValueError, match="no policy"):
        annotations.sized(scenes, (640, 480), "upscale")
    counted = annotations.sizes_achieved(annotations.sized(scenes, (640, 480), "exact", "warn")).collect()
    assert sorted((r.width, r.scenes, r.mismatches) for r in counted) == [(320, 1, 1), (640, 1, 0), (1920, 1, 1)]


def test_points_moved(spark):
    texts = [("go to [1, 2, 3] then [ -1.125,0.5 , 2 ]", 1.0, 0.0), ("[1, 2] [a, 2, 3] .", 1.0, 0.0), (None, 1.0, 0.0), ("[1, 0, 0]", 0.0, 1.5707963267948966), ("[1, 0, 0]", None, 0.0), ("", 0.0, 0.0)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, text string, x double, yaw double")
    got = rows.select("id", boxes.points_moved()("text", "x", F.lit(0.0), F.lit(1.0), "yaw").alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == ["go to [0.00, 2.00, 2.00] then [-2.12, 0.50, 1.00]", "[1, 2] [a, 2, 3] .", None, "[0.00, 1.00, -1.00]", "[1, 0, 0]", ""]


def test_footprints(spark):
    r = random.Random(2)
    inner = [("square", r.uniform(0, 2), r.uniform(0, 3)) for _ in range(3000)]
    corners = [("square", x, z) for x in (0.0, 2.0) for z in (0.0, 3.0)]
    more = [("line", float(i), float(i)) for i in range(5)] + [("one", 1.0, 1.0)] * 4 + [("none", None, 1.0), ("none", float("nan"), 1.0)]
    rows = spark.createDataFrame(inner + corners + more, "g string, x double, z double")
    assert {a.g: a.area and round(a.area, 9) for a in reports.footprints(rows, "g", "x", "z", 7).collect()} == {"square": 6.0, "line": None, "one": None, "none": None}


def test_null_paths_and_floors(spark):
    from orrery.operators import curriculum

    routes = spark.createDataFrame([(1, "Turn Left, Turn Back"), (2, None)], "k int, turns string")
    got = {r.k: r.distractors for r in curriculum.turn_distractors(routes).collect()}
    assert got[2] is None and len(got[1]) == 3 and "Turn Left, Turn Back" not in got[1]
    floors = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0), ("b", None, 0.0, 1.0, 1.0), ("c", float("nan"), 0.0, 1.0, 1.0)], "scene_id string, lx double, lz double, hx double, hz double")
    assert {r.scene_id for r in curriculum.placements(floors, 3).collect()} == {"a"}


def test_equal_answers_are_scored_once(spark, tmp_path):
    """Texts are taken apart once a distinct answer, not once a row."""
    import duckdb
    from orrery.plans import scores
    from orrery.plans.base import SQL

    rows = spark.range(4_000).select((F.col("id") % 7 + 1).cast("int").alias("l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = scores.benchmark(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted((r.kind, r["mean"], r.n) for r in got.collect()) == sorted(con.execute(SQL["benchmark_score"]).fetchall())
