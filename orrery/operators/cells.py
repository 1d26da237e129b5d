"""Spatial joins by grid cells: what lies near a path, and what cuts a segment, without pairs of a scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry

AXES = "xyz"


def finite(columns: Sequence[Column]) -> Column:
    return F.forall(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def width_for(size: Column, least: float) -> Column:
    """The width of the first grid, doubling from ``least``, whose cells are as wide as ``size``."""
    return F.lit(float(least)) * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size / least, F.lit(1.0)))))


def spanned(low: Column, high: Column, width: Column) -> Column:
    """Numbers of the cells of a grid that lie between two coordinates."""
    return F.sequence(F.floor(low / width - 1e-6), F.floor(high / width + 1e-6))


def clipped(p: Sequence[Column], q: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> tuple[Column, Column]:
    """Where the segment from p to q enters and leaves a box, as shares of its length; enter > leave: not at all."""
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, lo, hi in zip(p, q, low, high, strict=True):
        d = F.nullif(b - a, F.lit(0.0))
        one, two = (lo - a) / d, (hi - a) / d
        inside = (a >= lo) & (a <= hi)
        enter.append(F.when(d.isNull(), F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(one, two)))
        leave.append(F.when(d.isNull(), F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(one, two)))
    return F.greatest(*enter), F.least(*leave)


def pieces(segments: DataFrame, p: Sequence[str], q: Sequence[str], width: str, pad: Column, low: Sequence[str], high: Sequence[str]) -> DataFrame:
    """Rows of ``segments`` for each cell (columns __c0, __c1, …) that their parts inside a box come nearer than ``pad`` to.

    A segment is clipped to the box first and walked in pieces no longer than a cell, so its rows grow with the box,
    not with its own length.
    """
    enter, leave = clipped([F.col(c) for c in p], [F.col(c) for c in q], [F.col(c) - pad for c in low], [F.col(c) + pad for c in high])
    s = segments.withColumns({"__enter": enter, "__leave": leave}).where("__enter <= __leave")
    longest = F.greatest(*[F.abs(F.col(b) - F.col(a)) for a, b in zip(p, q, strict=True)]) * (F.col("__leave") - F.col("__enter"))
    s = s.withColumn("__n", F.greatest(F.ceil(longest / F.col(width)), F.lit(1))).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__p"))
    at = lambda k: F.col("__enter") + (F.col("__leave") - F.col("__enter")) * (F.col("__p") + k) / F.col("__n")
    for i, (a, b) in enumerate(zip(p, q, strict=True)):
        one, two = (F.col(a) + (F.col(b) - F.col(a)) * at(k) for k in (0, 1))
        s = s.select("*", F.explode(spanned(F.least(one, two) - pad, F.greatest(one, two) + pad, F.col(width))).alias(f"__c{i}"))
    return s.drop("__enter", "__leave", "__n", "__p")


def distance_to_segment(x: Sequence[Column], p: Sequence[Column], q: Sequence[Column]) -> Column:
    d = [b - a for a, b in zip(p, q, strict=True)]
    square = sum((v * v for v in d), F.lit(0.0))
    along = sum(((c - a) * v for c, a, v in zip(x, p, d, strict=True)), F.lit(0.0)) / F.nullif(square, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.sqrt(sum(((c - a - t * v) ** 2 for c, a, v in zip(x, p, d, strict=True)), F.lit(0.0)))


def distance_to_box(x: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Of a point from an axis-aligned box; 0 inside."""
    gaps = [F.greatest(lo - c, c - hi, F.lit(0.0)) for c, lo, hi in zip(x, low, high, strict=True)]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def near_paths(points: DataFrame, paths: DataFrame, scene: str, reach: float, cell: float = 0.5, also: Column | None = None) -> DataFrame:
    """Rows of ``points`` (x, y, z, r: a sphere) that come nearer than r + radius to a path of their scene.

    ``paths``: x0..z0 to x1..z1 and a radius: capsules; a path of no length is a sphere. ``reach`` is the largest r
    that counts (of rows with a larger one hits may be missed). A capsule lies in the cells along it of a grid twice as
    wide as it, clipped to where its scene has points; a point looks into one cell of each grid of its scene. ``also``
    may ask for more, with columns of the points as p.… and of the paths as o.…. Rows with a null or a number that is not
    finite, or without a scene, meet nothing.
    """
    o = paths.where(finite([F.col(a + e).cast("double") for e in "01" for a in AXES] + [F.col("radius").cast("double")]))
    o = o.withColumn("__pad", F.col("radius") + reach).where("__pad >= 0")
    o = o.withColumn("__width", width_for(2 * F.col("__pad"), cell))
    p = points.where(finite([F.col(c).cast("double") for c in (*AXES, "r")]))
    region = p.groupBy(F.col(scene).alias("__scene")).agg(*[f(a).alias(n + a) for a in AXES for f, n in ((F.min, "__lo"), (F.max, "__hi"))])
    o = o.join(region, F.col(scene) == F.col("__scene"))
    o = pieces(o, [a + "0" for a in AXES], [a + "1" for a in AXES], "__width", F.col("__pad"), ["__lo" + a for a in AXES], ["__hi" + a for a in AXES])
    grids = paths.where(F.col("radius").isNotNull()).select(F.col(scene).alias("__scene"), width_for(2 * (F.col("radius") + reach), cell).alias("__width")).distinct()
    p = p.join(grids, F.col(scene) == F.col("__scene")).drop("__scene")
    for i, a in enumerate(AXES):
        p = p.withColumn(f"__c{i}", F.floor(F.col(a) / F.col("__width")))
    far = distance_to_segment([F.col(f"p.{a}") for a in AXES], [F.col(f"o.{a}0") for a in AXES], [F.col(f"o.{a}1") for a in AXES])
    met = [F.col(f"p.{scene}") == F.col(f"o.{scene}"), F.col("p.__width") == F.col("o.__width"), *[F.col(f"p.__c{i}") == F.col(f"o.__c{i}") for i in range(3)], far < F.col("p.r") + F.col("o.radius")]
    hit = p.alias("p").join(o.alias("o"), [*met, also] if also is not None else met, "left_semi")
    return hit.select(*points.columns).distinct()


def near_boxes(points: DataFrame, boxes: DataFrame, scene: str, reach: float, cell: float = 0.5) -> DataFrame:
    """Rows of ``points`` (x, y, z, r) that come nearer than r to an axis-aligned box (lx..lz, hx..hz) of their scene.

    A box, grown by ``reach`` (the largest r), lies in the few cells of the first grid as wide as it. Rows with a null
    or a number that is not finite meet nothing.
    """
    o = boxes.where(finite([F.col(e + a).cast("double") for e in "lh" for a in AXES]))
    longest = F.greatest(*[F.col("h" + a) - F.col("l" + a) for a in AXES]) + 2 * reach
    o = o.withColumn("__width", width_for(longest, cell))
    grids = o.select(F.col(scene).alias("__scene"), "__width").distinct()
    p = points.where(finite([F.col(c).cast("double") for c in (*AXES, "r")])).join(grids, F.col(scene) == F.col("__scene")).drop("__scene")
    for i, a in enumerate(AXES):
        o = o.select("*", F.explode(spanned(F.col("l" + a) - reach, F.col("h" + a) + reach, F.col("__width"))).alias(f"__c{i}"))
        p = p.withColumn(f"__c{i}", F.floor(F.col(a) / F.col("__width")))
    far = distance_to_box([F.col(f"p.{a}") for a in AXES], [F.col(f"o.l{a}") for a in AXES], [F.col(f"o.h{a}") for a in AXES])
    met = [F.col(f"p.{scene}") == F.col(f"o.{scene}"), F.col("p.__width") == F.col("o.__width"), *[F.col(f"p.__c{i}") == F.col(f"o.__c{i}") for i in range(3)], far < F.col("p.r")]
    return p.alias("p").join(o.alias("o"), met, "left_semi").select(*points.columns).distinct()


def cut_segments(segments: DataFrame, occluders: DataFrame, scene: str, cell: float, own: str | None = None) -> DataFrame:
    """Distinct (scene, x0..z0, x1..z1[, own]) as __k0, … of the segments that a box of their scene cuts.

    Boxes lie in the few cells that they touch of the first grid as wide as their longest side; a segment, clipped to
    where its scene has boxes, goes along the cells of each grid of its scene and meets the boxes of these cells alone.
    A box whose ``own`` equals the segment's does not count. Rows with a null or a number that is not finite, or
    without a scene, take no part.
    """
    edges = [(F.col("l" + a).cast("double").alias("__l" + a), F.col("h" + a).cast("double").alias("__h" + a)) for a in AXES]
    o = occluders.select(F.col(scene).alias("__scene"), *[c for pair in edges for c in pair], *([F.col(own).alias("__own")] if own else []))
    o = o.where(finite([F.col(f"__{e}{a}") for a in AXES for e in "lh"]))
    for a in AXES:
        o = o.withColumns({"__l" + a: F.least("__l" + a, "__h" + a), "__h" + a: F.greatest("__l" + a, "__h" + a)})
    longest = F.greatest(*[F.col("__h" + a) - F.col("__l" + a) for a in AXES])
    o = o.withColumn("__width", width_for(longest, cell))
    grids = o.groupBy("__scene", "__width").agg(*[f(f"__{e}{a}").alias(f"__{n}{a}") for a in AXES for f, e, n in ((F.min, "l", "lo"), (F.max, "h", "hi"))])
    keys = [scene, *[a + end for end in "01" for a in AXES], *([own] if own else [])]
    s = segments.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{a}{e}`").cast("double").alias(f"__{a}{e}") for e in "01" for a in AXES])
    s = s.where(finite([F.col(f"__{a}{e}") for e in "01" for a in AXES])).distinct().join(grids, F.col("__k0") == F.col("__scene")).drop("__scene")
    s = pieces(s, [f"__{a}0" for a in AXES], [f"__{a}1" for a in AXES], "__width", F.lit(0.0), ["__lo" + a for a in AXES], ["__hi" + a for a in AXES])
    for i, a in enumerate(AXES):
        o = o.select("*", F.explode(spanned(F.col("__l" + a), F.col("__h" + a), F.col("__width"))).alias(f"__b{i}"))
    met = [F.col("__k0") == F.col("__scene"), F.col("s.__width") == F.col("o.__width"), *[F.col(f"__c{i}") == F.col(f"__b{i}") for i in range(3)]]
    cut = geometry.segment_hits_box(*[[F.col(f"__{a}{e}") for a in AXES] for e in "01"], [F.col("__l" + a) for a in AXES], [F.col("__h" + a) for a in AXES])
    if own:
        met.append(~F.col(f"__k{len(keys) - 1}").eqNullSafe(F.col("__own")))
    return s.alias("s").join(o.alias("o"), [*met, cut], "left_semi").select(*[f"__k{i}" for i in range(len(keys))]).distinct()
