"""Queries over cameras, poses and guards, each beside SQL that reaches the same numbers by another formula where it can."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import geometry, text
from orrery.operators import annotations, joins, reports
from orrery.plans.base import POINTS, points, query, r6, table

PI = repr(math.pi)


def _turn_and_shift(angle: str, x: str, y: str, z: str):
    """Pose that turns about z by a column and shifts by three."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(angle), -F.sin(angle), zero, F.col(x), F.sin(angle), F.cos(angle), zero, F.col(y), zero, zero, one, F.col(z), zero, zero, zero, one)


def _near(c, name: str):
    """Rounded, with one zero."""
    return F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6)).alias(name)


@query("pose_products", f"WITH {POINTS} SELECT vec_id, round(cos(e3 + e4), 6) AS c, round(sin(e3 + e4), 6) AS s, round(cos(e3) * e5 - sin(e3) * e6 + e0, 6) AS x, round(sin(e3) * e5 + cos(e3) * e6 + e1, 6) AS y, round(e7 + e2, 6) AS z FROM p")
def pose_products(spark, d):
    both = geometry.product(_turn_and_shift("e3", "e0", "e1", "e2"), _turn_and_shift("e4", "e5", "e6", "e7"))
    p = points(spark, d).select("vec_id", both.alias("m"))
    return p.select("vec_id", *[r6(geometry.at(F.col("m"), r, c), n) for n, r, c in (("c", 0, 0), ("s", 1, 0), ("x", 0, 3), ("y", 1, 3), ("z", 2, 3))])


@query("axis_angle_turns", f"""WITH {POINTS}, a AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS t FROM p), k AS (SELECT *, e0 / t AS kx, e1 / t AS ky, e2 / t AS kz FROM a), s AS (SELECT *, (kx * e3 + ky * e4 + kz * e5) * (1 - cos(t)) AS d FROM k)
SELECT vec_id, round(e3 * cos(t) + (ky * e5 - kz * e4) * sin(t) + kx * d, 6) AS x, round(e4 * cos(t) + (kz * e3 - kx * e5) * sin(t) + ky * d, 6) AS y, round(e5 * cos(t) + (kx * e4 - ky * e3) * sin(t) + kz * d, 6) AS z FROM s""")
def axis_angle_turns(spark, d):
    """Vectors turned by matrices of axis-angle vectors; the SQL turns them without a matrix."""
    r, v = geometry.rodrigues(F.col("e0"), F.col("e1"), F.col("e2")), [F.col(f"e{i}") for i in (3, 4, 5)]
    return points(spark, d).select("vec_id", *[r6(sum((r[3 * i + j] * v[j] for j in range(3)), F.lit(0.0)), n) for i, n in enumerate("xyz")])


@query("headings", f"WITH {POINTS} SELECT vec_id, round(e0 * 30 - 2 * {PI} * floor((e0 * 30 + {PI}) / (2 * {PI})), 6) AS yaw, round(-{PI} / 2 - e1 * 3, 6) AS agent FROM p")
def headings(spark, d):
    """Headings of cameras turned by e0 * 30, and of agents whose quaternion turns by e1 * 3."""
    zero, h = F.lit(0.0), F.col("e0") * 30
    pose = F.array(zero, zero, F.sin(h), zero, zero, zero, F.cos(h), zero, *[zero] * 8)
    return points(spark, d).select("vec_id", r6(geometry.camera_yaw(pose), "yaw"), r6(geometry.agent_yaw(F.sin(F.col("e1") * 1.5), F.cos(F.col("e1") * 1.5)), "agent"))


@query("crop_borders", "SELECT p_partkey, least(greatest(round_even(p_size * 13 * 0.05::DOUBLE, 0)::INT, 0), (p_size * 13 - 1) // 2)::INT AS px FROM part")
def crop_borders(spark, d):
    return table(spark, d, "part").select("p_partkey", geometry.border(F.col("p_size") * 13, F.lit(0.05)).alias("px"))


@query("patch_positions", f"WITH {POINTS} SELECT vec_id, round((vec_id % 16) / 15.0::DOUBLE * 32, 6) AS t, round((e0 + {PI} / 2) * 32 / {PI}, 6) AS y, round((e1 + {PI}) * 16 / {PI}, 6) AS x FROM p")
def patch_positions(spark, d):
    t, y, x = geometry.position(F.col("e1"), F.col("e0"), F.col("vec_id") % 16, F.lit(16), 32.0)
    return points(spark, d).select("vec_id", r6(t, "t"), r6(y, "y"), r6(x, "x"))


@query("ray_directions", f"WITH {POINTS}, n AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS n FROM p) SELECT vec_id, round(e0 / n, 6) AS x, round(-e2 / n, 6) AS y, round(e1 / n, 6) AS z FROM n")
def ray_directions(spark, d):
    """Canvas directions of points: back from longitude and latitude they are the points at distance one."""
    lon, lat, _ = geometry.spherical(F.col("e0"), F.col("e1"), F.col("e2"))
    return points(spark, d).select("vec_id", *[r6(c, n) for n, c in zip("xyz", geometry.direction(lat, lon), strict=True)])


@query("fourier_features", f"WITH {POINTS} SELECT vec_id, round(e0, 6) AS x, round(sin(e0), 6) AS s0, round(sin(e0 * 8), 6) AS s1, round(sin(e0 * 64), 6) AS s2, round(cos(e0), 6) AS c0, round(cos(e0 * 8), 6) AS c1, round(cos(e0 * 64), 6) AS c2 FROM p")
def fourier_features(spark, d):
    waves = geometry.fourier(F.col("e0"), 3, 64.0)
    return points(spark, d).select("vec_id", *[r6(F.get(waves, F.lit(i)), n) for i, n in enumerate(("x", "s0", "s1", "s2", "c0", "c1", "c2"))])


@query("gravity_alignments", f"WITH {POINTS} SELECT vec_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, -1.0::DOUBLE AS z, 1.0::DOUBLE AS det FROM p")
def gravity_alignments(spark, d):
    """The turned mean down of each vector, and the turn's determinant: always (0, 0, -1) and 1."""
    v = [F.col(f"e{i}") for i in range(3)]
    turned = points(spark, d).select("vec_id", *v, F.transform(F.array(*geometry.gravity_alignment(*v)), lambda x: x).alias("m"))
    m, n = [F.get("m", F.lit(i)) for i in range(9)], F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return turned.select("vec_id", *[_near(sum((m[3 * i + j] * v[j] for j in range(3)), F.lit(0.0)) / n, a) for i, a in enumerate("xyz")], _near(det, "det"))


_CORNERS = [(-320, -240), (320, -240), (320, 240), (-320, 240)]


@query("frustum_corners", f"WITH {POINTS}, c AS (SELECT vec_id, e0, e1, e2, cos(e3) AS c, sin(e3) AS s FROM p) " + " UNION ALL ".join(
    f"SELECT vec_id, {i + 1} AS corner, round(c * {u / 500!r} * 2 - s * {v / 500!r} * 2 + e0, 6) AS x, round(s * {u / 500!r} * 2 + c * {v / 500!r} * 2 + e1, 6) AS y, round(e2 + 2, 6) AS z FROM c" for i, (u, v) in enumerate(_CORNERS)
) + " UNION ALL SELECT vec_id, 0, round(e0, 6), round(e1, 6), round(e2, 6) FROM c")
def frustum_corners(spark, d):
    """Centre and image corners at depth two of cameras turned about z."""
    corners = geometry.frustum_points(_turn_and_shift("e3", "e0", "e1", "e2"), 2.0, F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), F.lit(640.0), F.lit(480.0))
    p = points(spark, d).select("vec_id", F.posexplode(corners).alias("corner", "p"))
    return p.select("vec_id", "corner", *[r6(F.get("p", F.lit(i)), a) for i, a in enumerate("xyz")])


@query("rotated_intrinsics", """WITH p AS (SELECT vec_id, (vec_id % 4)::INT AS k FROM embeddings) SELECT vec_id, CASE WHEN k % 2 = 0 THEN 500.0 ELSE 510.0 END::DOUBLE AS fx, CASE k WHEN 0 THEN 310.0 WHEN 1 THEN 480 - 250.0 WHEN 2 THEN 640 - 310.0 ELSE 250.0 END::DOUBLE AS cx,
CASE k WHEN 0 THEN 250.0 WHEN 1 THEN 310.0 WHEN 2 THEN 480 - 250.0 ELSE 640 - 310.0 END::DOUBLE AS cy, CASE WHEN k % 2 = 0 THEN 640.0 ELSE 480.0 END::DOUBLE AS width FROM p""")
def rotated_intrinsics(spark, d):
    k = geometry.rotated_intrinsics(*map(F.lit, (500.0, 510.0, 310.0, 250.0, 640.0, 480.0)), F.col("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", k.alias("k")).select("vec_id", "k.fx", "k.cx", "k.cy", "k.width")


@query("typed_rows", "SELECT event_id, event_type AS question_type FROM events WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL AND value IS NOT NULL")
def typed_rows(spark, d):
    """Rows of wanted types that have all that they need."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("question_type"))
    kept = annotations.of_types(annotations.usable(e, ("user_id", "value")), ("click", "view", "purchase"), ("purchase",))
    return kept.select("event_id", "question_type")


@query("clean_answers", "SELECT p_partkey, p_name || '<|box_start|>' AS text FROM part")
def clean_answers(spark, d):
    """Texts without media and chat marks; those of boxes stay."""
    raw = F.concat(F.lit("<image>\n<video> \n"), F.col("p_name"), F.lit("<|im_end|><|box_start|><|end|>"))
    return table(spark, d, "part").select("p_partkey", text.without_media(text.cleaned(raw)).alias("text"))


@query("multi_grounding", "SELECT round(avg(l_discount * 10), 6) AS f1_25, round(avg(l_tax * 10), 6) AS f1_50, count(*) AS n, count(*) AS total FROM lineitem")
def multi_grounding(spark, d):
    out = reports.multi_grounding(table(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_tax") * 10)
    return out.select(r6(F.col("f1_25"), "f1_25"), r6(F.col("f1_50"), "f1_50"), "n", "total")


@query("override_join", """WITH o AS (SELECT o_custkey, min(row(o_orderdate, o_totalprice)) AS m FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_nationkey, struct_extract_at(m, 2) AS c_acctbal FROM customer JOIN o ON o_custkey = c_custkey""")
def override_join(spark, d):
    """Balances of customers replaced by their first order's total; customers without orders go."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("c_acctbal"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(None).cast(o.schema["day"].dataType).alias("day"))
    return joins.overridden(c, o, ["c_custkey"], ["day", "c_acctbal"]).select("c_custkey", "c_nationkey", "c_acctbal")


@query("dense_rows", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_discount > 0.011")
def dense_rows(spark, d):
    """Rows that pass, where no return flag loses more than half of its rows."""
    return reports.dense(table(spark, d, "lineitem"), "l_returnflag", F.col("l_discount") > 0.011).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("frame_sizes", """WITH s AS (SELECT p_size * 16 AS w, p_size * 12 AS h FROM part), e AS (SELECT *, least(least(320 / w, 200 / h), 1.0::DOUBLE) AS k FROM s)
SELECT w AS width, h AS height, greatest(round_even(w * k, 0)::INT, 1) AS effective_width, greatest(round_even(h * k, 0)::INT, 1) AS effective_height, count(*) AS scenes, 0::BIGINT AS mismatches FROM e GROUP BY ALL""")
def frame_sizes(spark, d):
    """Sizes that frames are read at under a ceiling, with how many scenes have them."""
    scenes = table(spark, d, "part").select((F.col("p_size") * 16).alias("width"), (F.col("p_size") * 12).alias("height"))
    found = annotations.sizes_achieved(annotations.sized(scenes, (320, 200), "cap", most=(320, 200)))
    return found.select("width", "height", F.col("effective.width").alias("effective_width"), F.col("effective.height").alias("effective_height"), "scenes", "mismatches")
