"""Spatial relations between points on the horizontal plane (x right, z forward), as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BACK = math.cos(math.radians(135))
DIAGONAL = math.cos(math.radians(45))


def dot_cross(hx: Column, hz: Column, tx: Column, tz: Column, least: float = 1e-3) -> tuple[Column, Column, Column]:
    """Cosine and sine from heading to target (sine > 0: left), and whether either vector is too short."""
    a, b = F.sqrt(hx * hx + hz * hz), F.sqrt(tx * tx + tz * tz)
    short = (a < least) | (b < least)
    ux, uz = hx / F.nullif(a, F.lit(0.0)), hz / F.nullif(a, F.lit(0.0))
    vx, vz = tx / F.nullif(b, F.lit(0.0)), tz / F.nullif(b, F.lit(0.0))
    return ux * vx + uz * vz, ux * vz - uz * vx, short


def label(hx: Column, hz: Column, tx: Column, tz: Column, kind: str, least: float = 1e-3) -> Column:
    """Where the target is: kind is easy, medium, hard or 4way. Vectors shorter than ``least`` count as straight ahead;
    with ``least`` 0 none does, and one without extent has cosine and sine NaN, which is above every number."""
    dot, cross, short = dot_cross(hx, hz, tx, tz, least)
    still = ((hx == 0) & (hz == 0)) | ((tx == 0) & (tz == 0))
    dot, cross = (F.when(still & (hx + hz + tx + tz).isNotNull(), float("nan")).otherwise(c) for c in (dot, cross))
    dot, cross = F.when(short, 1.0).otherwise(dot), F.when(short, 0.0).otherwise(cross)
    side = F.when(cross > 0, "left").otherwise("right")
    if kind == "easy":
        return side
    if kind == "medium":
        return F.when(dot < BACK, "back").otherwise(side)
    if kind == "4way":
        return F.when(dot > DIAGONAL, "front").when(dot < -DIAGONAL, "back").otherwise(side)
    return F.concat(F.when(dot > 0, "front-").otherwise("back-"), side)


def turn(hx: Column, hz: Column, tx: Column, tz: Column, unit: bool = False) -> Column:
    """The turn from a heading to a target. The side is read off the vectors as they are, or with ``unit`` off their unit
    vectors: where both point one way, that cross product is seldom exactly zero."""
    a, b = F.sqrt(hx * hx + hz * hz), F.sqrt(tx * tx + tz * tz)
    if unit:
        dot, cross, _ = dot_cross(hx, hz, tx, tz)
    else:
        dot, cross = (hx * tx + hz * tz) / F.nullif(a * b, F.lit(0.0)), hx * tz - hz * tx
    side = F.when(cross > 0, "Turn Left").otherwise("Turn Right")
    return F.when((a < 1e-3) | (b < 1e-3), "Turn Right").when(dot < BACK, "Turn Back").otherwise(side)


def hour(dot: Column, cross: Column) -> Column:
    """Clock direction, 12 ahead and 3 right, rounded half to even."""
    value = F.pmod(F.bround(F.atan2(-cross, dot) / (2 * math.pi) * 12).cast("int"), F.lit(12))
    return F.when(value == 0, 12).otherwise(value)


def side(dot: Column, cross: Column, margin: float) -> Column:
    """Cardinal side, null within ``margin`` of a diagonal."""
    a, b = F.abs(dot), F.abs(cross)
    plain = F.when(-cross >= a, "right").when(cross >= a, "left").when(dot >= b, "front").otherwise("back")
    return F.when(F.abs(a - b) >= margin, plain)


def parity(count: Column) -> Column:
    return F.when(count % 2 == 0, "even").otherwise("odd")


def longest_cm(*dims: Column) -> Column:
    return F.bround(F.greatest(*dims) * 100).cast("int")


def pose_class(n: Column, finite: Column, largest: Column, span: Column, over_50: Column, over_500: Column) -> Column:
    return (
        F.when(n == 0, "no_data")
        .when(finite == 0, "all_nonfinite")
        .when((largest > 500) | (over_500 > 0.01), "broken")
        .when((largest > 50) | (span > 30) | (over_50 > 0.1), "borderline")
        .otherwise("ok")
    )
