"""Column functions on values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import boxes, geometry, relations, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(float(x))


@pytest.mark.parametrize(("raw", "want"), [("The  Red-Chair!", "redchair"), ("A", ""), ("an apple, a day", "apple day"), ("th'e", "the")])
def test_normalized(spark, raw, want):
    assert value(spark, text.normalized(F.lit(raw))) == want


@pytest.mark.parametrize(("pred", "target", "want"), [(10, 10, 1.0), (9, 10, 0.9), (11, 10, 0.9), (8, 10, 0.6), (5, 10, 0.1), (4.9, 10, 0.0), (0.72, 0.78, 0.9), (0, 0, 1.0), (1, 0, 0.0)])
def test_relative_accuracy(spark, pred, target, want):
    assert value(spark, text.relative_accuracy(lit(pred), lit(target))) == pytest.approx(want)


def test_matches(spark):
    assert value(spark, text.exact_match(F.lit("A"), F.array(F.lit("The")))) == 1
    assert value(spark, text.refined_match(F.lit("A"), F.array(F.lit("A")))) == 0
    assert value(spark, text.refined_match(F.lit("red chair"), F.array(F.lit("a redchair leg")))) == 1
    assert value(spark, text.first_token(F.lit(" B. because"))) == "b"
    assert value(spark, text.regression_value(F.lit("p1=3, dist=1.5, dist = -2.25"))) == -2.25
    assert value(spark, text.number(F.lit("nan"))) is None
    assert value(spark, text.number(F.lit(" 1e3 "))) == 1000
    assert value(spark, text.turn_score(F.lit("turn left, turn left"), F.lit("Turn Left, Turn Right, Turn Back"))) == pytest.approx(1 / 3)
    assert value(spark, text.cleaned(F.lit("<|im_end|>x<|box_start|>(1)"))) == "x<|box_start|>(1)"
    assert value(spark, text.answer_tag(F.lit("so <Answer> B </answer>."))) == "B"


def array(*v):
    return F.array(*map(lit, v))


@pytest.mark.parametrize(("other", "want"), [((0, 0, 0, 2, 2, 2), 1), ((1, 0, 0, 2, 2, 2), 1 / 3), ((2, 0, 0, 2, 2, 2), 0), ((0.5, 0.5, 0.5, 2, 2, 2), 0.26732673)])
def test_iou(spark, other, want):
    assert value(spark, boxes.iou(array(0, 0, 0, 2, 2, 2), array(*other))) == pytest.approx(want)


def test_oriented(spark):
    got = value(spark, boxes.aligned(array(1, 2, 3, 4, 2, 1, math.pi / 6, 0, 0)))
    assert got == pytest.approx([1, 2, 3, 4.464102, 3.732051, 1.0], abs=1e-6)
    got = value(spark, boxes.aligned(array(0, 0, 0, 4, 2, 1, 0.3, 0.2, 0.1)))
    assert got[3:] == pytest.approx([4.511861, 3.283899, 1.763883], abs=1e-6)
    corners = value(spark, boxes.corners(array(0, 0, 0, 4, 2, 1, 0.3, 0.2, 0.1)))
    assert [max(c[i] for c in corners) - min(c[i] for c in corners) for i in range(3)] == pytest.approx(got[3:])


def test_panorama(spark):
    assert tuple(value(spark, boxes.panoramic(array(1, 2, 2, 1, 1, 1))))[:3] == pytest.approx((574, 268, 3.0))
    assert tuple(value(spark, boxes.panoramic(array(0, 1, 0, 1, 1, 1))))[:3] == pytest.approx((500, 500, 1.0))


def test_parsing(spark):
    many = lambda s: value(spark, boxes.parsed_many(F.lit(s)))
    assert many("none") == []
    assert many("(1, 2, 3, 4, 5, 6); (1,1,1,1,1,-1.5)") == [[1, 2, 3, 4, 5, 6], [1, 1, 1, 1, 1, -1.5]]
    assert many('x [{"bbox_3d": [1,2,3,4,5,6]}] y') == [[1, 2, 3, 4, 5, 6]]
    assert len(many('[{"bbox_3d": [1,2,3,4,5,6,0,0,0]}]')[0]) == 6
    assert value(spark, boxes.parsed(F.lit("no box"))) is None
    assert value(spark, boxes.parsed(F.lit("(1, 2, 3, 4, 5, 1.2.3)"))) is None


def test_greedy_f1(spark):
    a, b = (0, 0, 0, 2, 2, 2), (1, 0, 0, 2, 2, 2)
    assert boxes._f1([a, b], [a], 0.25) == pytest.approx(2 / 3)
    assert (boxes._f1([b], [a], 0.25), boxes._f1([b], [a], 0.5), boxes._f1([], [], 0.25)) == (1.0, 0.0, 1.0)


def test_surface_points():
    import numpy as np

    box = np.array([0, 0, 0, 2, 2, 2, 0, 0, 0], float)
    assert len(boxes.surface_points(box, 100, 0)) == 100 and len(np.unique(boxes.surface_points(box, 100, 0), axis=0)) > 8
    assert len(boxes.surface_points(box, 4, 0)) == 8


@pytest.mark.parametrize(("p", "want"), [((0, 1, 0), (0, 0, 1)), ((1, 0, 0), (1.570796, 0, 1)), ((0, 0, 1), (0, -1.570796, 1)), ((1, 2, 2), (0.463648, -0.729728, 3))])
def test_spherical(spark, p, want):
    assert [value(spark, c) for c in geometry.spherical(*map(lit, p))] == pytest.approx(want, abs=1e-6)


def test_unproject_and_pixels(spark):
    k = geometry.resized_intrinsics(lit(500), lit(500), lit(320), lit(240), lit(20 / 640), lit(15 / 480))
    assert [value(spark, c) for c in geometry.unprojected(lit(3.5), lit(2.5), lit(2), *k)] == pytest.approx((-0.832 + 0.0, -0.64, 2))
    assert value(spark, geometry.nearest_exact(F.lit(3), F.lit(640), F.lit(20))) == 112


@pytest.mark.parametrize(("p", "q", "want"), [((0, 0, 0), (4, 0, 0), True), ((0, 0, 0), (1, 0, 0), False), ((0, 2, 0), (4, 2, 0), False), ((0, 0, 0), (0.9, 0, 0), False)])
def test_segment(spark, p, q, want):
    assert value(spark, geometry.segment_hits_box(*(tuple(map(lit, v)) for v in (p, q, (1, -1, -1), (2, 1, 1))))) is want


def test_camera_round_trip(spark):
    a = 0.7
    pose = array(math.cos(a), -math.sin(a), 0, 1, math.sin(a), math.cos(a), 0, 2, 0, 0, 1, 3, 0, 0, 0, 1)
    world = geometry.transformed(pose, lit(0.5), lit(-1), lit(2))
    assert [value(spark, c) for c in geometry.inverse_applied(pose, *world)] == pytest.approx((0.5, -1, 2))


def test_rotated_intrinsics(spark):
    r = value(spark, geometry.rotated_intrinsics(lit(1), lit(2), lit(3), lit(4), lit(10), lit(20), F.lit(1)))
    assert (r.fx, r.fy, r.cx, r.cy, r.width, r.height) == (2, 1, 16, 3, 20, 10)


@pytest.mark.parametrize(("t", "easy", "hard", "hour"), [((0.1, 1), "right", "front-right", 12), ((1, 0), "right", "back-right", 3), ((-0.2, -1), "left", "back-left", 6), ((1, -1), "right", "back-right", 4)])
def test_relations(spark, t, easy, hard, hour):
    h = (lit(0), lit(1), lit(t[0]), lit(t[1]))
    assert value(spark, relations.label(*h, "easy")) == easy
    assert value(spark, relations.label(*h, "hard")) == hard
    dot, cross, _ = relations.dot_cross(*h)
    assert value(spark, relations.hour(dot, cross)) == hour


def test_box_text_is_read_again(spark):
    rows = [([1234.567, -0.004, 2.5, 0.125, 1e-9, 7.0],), ([0.0] * 6,), (None,)]
    df = spark.createDataFrame(rows, "box array<double>")
    got = df.select(boxes.formatted(F.col("box")).alias("t")).select("t", boxes.parsed(F.col("t")).alias("b")).collect()
    assert got[0].t == "(1234.57, -0.00, 2.50, 0.13, 0.00, 7.00)" and got[0].b == [1234.57, -0.0, 2.5, 0.13, 0.0, 7.0]
    assert got[1].b == [0.0] * 6 and got[2].t is None


def test_directions_of_short_vectors(spark):
    short = [lit(v) for v in (0.0004, 0.0, 0.0, 0.5)]
    assert [value(spark, relations.label(*short, k)) for k in ("easy", "4way")] == ["right", "front"]
    assert [value(spark, relations.label(*short, k, least=0.0)) for k in ("easy", "4way")] == ["left", "left"]
    # as engines do that take 0 / 0 as NaN, above every number
    still = [lit(v) for v in (0.0, 0.0, 0.0, 0.5)]
    assert [value(spark, relations.label(*still, k, least=0.0)) for k in ("easy", "medium", "hard", "4way")] == ["left", "left", "front-left", "front"]
    unknown = [F.lit(None).cast("double"), lit(0.0), lit(0.0), lit(0.5)]
    assert [value(spark, relations.label(*unknown, k, least=0.0)) for k in ("easy", "hard")] == ["right", "back-right"]


@pytest.mark.parametrize(("raw", "want"), [
    ("la enan la onè oueauré. la", "la"), ("la enan on", "enan"), ("the cup\n", "object"), ("the red\x0bcup is", "object"), ("a \u0130s in", "is"), ("the big red box, then", "box"), ("say 'so' of the box", "so"), ("a " + "word " * 30_000 + "è", "object"),
])
def test_short_label(spark, raw, want):
    import duckdb
    from orrery.plans import asked  # noqa: F401
    from orrery.plans.base import SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT 1 AS conv_id, 1 AS turn, ? AS text", [raw])
    assert con.execute(SQL["short_labels"]).fetchone()[2] == want
    assert value(spark, text.short_label(F.lit(raw))) == want
