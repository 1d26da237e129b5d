"""Nearest points by a tree of cells: branches that cannot hold the nearest are left out level by level.

Every set's box is halved along each axis, level by level; a node of a level is a cell that holds points, with the box
of its points. From the root, what looks (a point, or a node of the other set) goes on to the children of its nodes,
and keeps those whose least possible distance is no more than the least of all largest possible ones. So a few nodes a
level are looked at, wherever the points crowd, and a leaf holds few points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.cells import finite
from orrery.operators.rounds import kept

#: Points of a leaf that are aimed at, and levels at most (points that crowd closer stay in one leaf).
LEAF, DEEPEST = 16, 20


def _numbered(points: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """Distinct finite points with the number of their cell on each axis at the deepest level (i0, i1, …)."""
    p = points.where(finite([F.col(a) for a in axes]) & F.col(key).isNotNull())
    box = p.groupBy(F.col(key).alias("__key")).agg(*[f(a).alias(n + a) for a in axes for f, n in ((F.min, "__lo"), (F.max, "__hi"))])
    both = p.join(box, F.col(key) == F.col("__key"))
    # halves, so that the span of any two doubles is one
    share = lambda a: (F.col(a) / 2 - F.col("__lo" + a) / 2) / F.nullif(F.col("__hi" + a) / 2 - F.col("__lo" + a) / 2, F.lit(0.0))
    cell = lambda a: F.least(F.floor(F.coalesce(share(a), F.lit(0.0)) * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("int")
    return both.select(*points.columns, *[cell(a).alias(f"i{k}") for k, a in enumerate(axes)])


def _at(level: int, names: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.shiftright(F.col(n), DEEPEST - level).alias(prefix + n) for n in names]


def _levels(points: DataFrame, key: str, cells: Sequence[str]) -> int:
    """The first level on which no leaf holds more than a few times LEAF points, from where an even spread has LEAF."""
    most = points.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    level = max(0, math.ceil(math.log2(most / LEAF) / len(cells))) if most > LEAF else 0
    while level < DEEPEST and most > LEAF:
        if points.groupBy(key, *_at(level, cells)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 4 * LEAF:
            break
        level += 1
    return min(level, DEEPEST)


def _nodes(points: DataFrame, key: str, axes: Sequence[str], cells: Sequence[str], level: int, side: str) -> DataFrame:
    """Nodes of a level with the box of their points; names begin with ``side``."""
    at = [c.alias(f"{side}{n}") for c, n in zip(_at(level, cells), cells, strict=True)]
    return points.groupBy(F.col(key).alias(f"{side}key"), *at).agg(*[f(a).alias(f"{side}{n}{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))])


def _below(frontier: DataFrame, nodes: DataFrame, side: str, cells: Sequence[str]) -> DataFrame:
    """``frontier`` with each node of a side replaced by its children."""
    child = nodes.select(F.col(f"{side}key").alias("__key"), *[F.shiftright(F.col(f"{side}{n}"), 1).alias(f"__up{n}") for n in cells], *[F.col(c).alias("__" + c) for c in nodes.columns if c != f"{side}key"])
    rest = [c for c in frontier.columns if c not in nodes.columns or c == f"{side}key"]
    met = [F.col(f"{side}key") == F.col("__key"), *[F.col(f"{side}{n}") == F.col(f"__up{n}") for n in cells]]
    return frontier.join(child, met).select(*rest, *[F.col("__" + c).alias(c) for c in nodes.columns if c != f"{side}key"])


def nearest_pair(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Least distance between two point sets (x, y, z) of each pair of sets (a_key, b_key): (a_key, b_key, distance).

    Both sets are walked down together; a pair of nodes stays while it may hold the pair's least distance. Points with
    a null or a number that is not finite count for nothing: a pair whose set has no others has a null distance. Pairs
    with a set that is not there have no row; repeated pairs have one.
    """
    axes, cells = ["x", "y", "z"], ["i0", "i1", "i2"]
    pairs = pairs.select("a_key", "b_key").distinct()
    left, right = (kept(_numbered(s.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in axes]).distinct(), key, axes), "points") for s in (a, b))
    depth = max(_levels(left, key, cells), _levels(right, key, cells))
    frontier = pairs.join(_nodes(left, key, axes, cells, 0, "p"), F.col("a_key") == F.col("pkey")).join(_nodes(right, key, axes, cells, 0, "q"), F.col("b_key") == F.col("qkey"))
    for level in range(1, depth + 1):
        frontier = _below(frontier, _nodes(left, key, axes, cells, level, "p"), "p", cells)
        frontier = _below(frontier, _nodes(right, key, axes, cells, level, "q"), "q", cells)
        gap = [F.greatest(F.col(f"qlo{x}") - F.col(f"phi{x}"), F.col(f"plo{x}") - F.col(f"qhi{x}"), F.lit(0.0)) for x in axes]
        far = [F.greatest(F.col(f"qhi{x}") - F.col(f"plo{x}"), F.col(f"phi{x}") - F.col(f"qlo{x}")) for x in axes]
        square = lambda v: reduce(lambda s, g: s + g * g, v, F.lit(0.0))
        frontier = kept(frontier.withColumns({"__near": square(gap), "__far": square(far)}), "frontier")
        least = frontier.groupBy(F.col("a_key").alias("__a"), F.col("b_key").alias("__b")).agg(F.min("__far").alias("__least"))
        frontier = frontier.join(least, (F.col("a_key") == F.col("__a")) & (F.col("b_key") == F.col("__b"))).where("__near <= __least").drop("__a", "__b", "__near", "__far", "__least")
    leaves = [s.select(F.col(key).alias(f"__{n}key"), *[F.col(x).alias(f"__{n}{x}") for x in axes], *_at(depth, cells, f"__{n}")) for s, n in ((left, "p"), (right, "q"))]
    for leaf, n in zip(leaves, "pq", strict=True):
        frontier = frontier.join(leaf, [F.col(f"{n}key") == F.col(f"__{n}key"), *[F.col(f"{n}{c}") == F.col(f"__{n}{c}") for c in cells]])
    each = reduce(lambda s, x: s + (F.col(f"__p{x}") - F.col(f"__q{x}")) ** 2, axes, F.lit(0.0))
    found = frontier.groupBy("a_key", "b_key").agg(F.sqrt(F.min(each)).alias("distance"))
    for s, side in ((a, "a_key"), (b, "b_key")):
        pairs = pairs.join(s.select(F.col(key).alias(side)).distinct(), side, "left_semi")
    return pairs.join(found, ["a_key", "b_key"], "left")


def nearest_patch(pixels: DataFrame, patches: DataFrame, frame: str) -> DataFrame:
    """(row, col) of each pixel to the index of the frame's nearest patch: ring distance, then rows, then columns, then
    the least index; 0 where its frame has none. Pixels or patches with a null place find, and are, nothing."""
    axes, cells = ["row", "col"], ["i0", "i1"]
    p = patches.where("idx IS NOT NULL").groupBy(frame, "row", "col").agg(F.min("idx").alias("idx"))
    p = kept(_numbered(p.select(F.col(frame), *[F.col(c).cast("double").alias(c) for c in axes], "idx"), frame, axes), "patches")
    wanted = pixels.select(frame, "row", "col").distinct()
    depth = _levels(p, frame, cells)
    frontier = wanted.where(F.col("row").isNotNull() & F.col("col").isNotNull()).join(_nodes(p, frame, axes, cells, 0, "q"), F.col(frame) == F.col("qkey"))
    for level in range(1, depth + 1):
        frontier = _below(frontier, _nodes(p, frame, axes, cells, level, "q"), "q", cells)
        near = F.greatest(*[F.greatest(F.col(f"qlo{x}") - F.col(x), F.col(x) - F.col(f"qhi{x}"), F.lit(0.0)) for x in axes])
        far = F.greatest(*[F.greatest(F.abs(F.col(f"qhi{x}") - F.col(x)), F.abs(F.col(x) - F.col(f"qlo{x}"))) for x in axes])
        frontier = kept(frontier.withColumns({"__near": near, "__far": far}), "frontier")
        least = frontier.groupBy(*[F.col(c).alias("__" + c) for c in (frame, *axes)]).agg(F.min("__far").alias("__least"))
        frontier = frontier.join(least, [F.col(c) == F.col("__" + c) for c in (frame, *axes)]).where("__near <= __least").select(*[c for c in frontier.columns if c not in ("__near", "__far")])
    leaf = p.select(F.col(frame).alias("__key"), *[F.col(c).alias("__" + c) for c in (*axes, "idx")], *_at(depth, cells, "__"))
    met = frontier.join(leaf, [F.col("qkey") == F.col("__key"), *[F.col(f"q{c}") == F.col(f"__{c}") for c in cells]])
    dy, dx = (F.abs(F.col(x) - F.col("__" + x)) for x in axes)
    best = met.groupBy(*[F.col(c).alias("__own" + c) for c in (frame, *axes)]).agg(F.min(F.struct(F.greatest(dy, dx).alias("ring"), dy.alias("dy"), dx.alias("dx"), F.col("__idx").alias("idx"))).alias("__best"))
    out = wanted.join(best, [F.col(c).eqNullSafe(F.col("__own" + c)) for c in (frame, *axes)], "left")
    return out.select(frame, "row", "col", F.coalesce("__best.idx", F.lit(0)).alias("idx"))
