"""Floors made of rectangles that may overlap: area and outline of their union, by a sweep over coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import cells
from orrery.operators.placing import between, log_between
from orrery.operators.rounds import kept

SIDES = ("lx", "lz", "hx", "hz")


def _merged(rows: DataFrame, by: list[str], near: str, far: str) -> DataFrame:
    """Intervals of each group, those that overlap or touch as one."""
    order = Window.partitionBy(*by).orderBy(near, far)
    before = F.max(far).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(before.isNull() | (F.col(near) > before), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__island").agg(F.min(near).alias(near), F.max(far).alias(far)).drop("__island")


def _passing(r: DataFrame, near: str, far: str, most: int) -> DataFrame:
    """(scene_id, __lo, __wide, strip, near, far): what the strips that rectangles pass right through have of them, joined.

    A run of strips is a few aligned runs of 2^h strips. From the longest on these are joined and handed to both halves,
    so rectangles that overlap are one long before they reach a strip, and the work grows as the rectangles do.
    """
    runs = r.where("__last > __first").select("scene_id", "__lo", "__wide", near, far, "__first", "__last", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("__h"))
    size = lambda h: F.pow(F.lit(2.0), h)
    low = lambda h: F.ceil(F.col("__first") / size(h))  # noqa: E731  __first to __last, the latter not included
    high = lambda h: F.floor(F.col("__last") / size(h)) - 1
    h, up = F.col("__h"), F.col("__h") + 1
    ends = F.when(low(h) <= high(h), F.array_distinct(F.array(low(h), high(h)))).otherwise(F.array().cast("array<bigint>"))
    own = F.filter(ends, lambda n: ~((F.floor(n / 2) >= low(up)) & (F.floor(n / 2) <= high(up))) | (h == most))
    runs = kept(runs.select("scene_id", "__lo", "__wide", near, far, "__h", F.explode(own).alias("strip")), "runs")
    by, carried = ["scene_id", "__lo", "__wide", "strip"], None
    for level in range(most, -1, -1):
        here = runs.where(F.col("__h") == level).select(*by, near, far)
        if carried is not None:
            halves = F.explode(F.array(F.col("strip") * 2, F.col("strip") * 2 + 1)).alias("strip")
            here = here.unionByName(carried.select("scene_id", "__lo", "__wide", halves, near, far))
        carried = _merged(here, by, near, far)
    return carried


def _swept(rects: DataFrame, a: str, b: str, strips: int) -> DataFrame:
    """(scene_id, area, edges): the union's area and the length of its edges along ``a``.

    A scene's span along ``a`` is cut into strips, so that a scene with many rectangles is many tasks' work; a strip
    is cut into slabs at the sides that lie in it. Within a slab the rectangles are intervals along ``b``, joined in
    order; rectangles that pass a strip from side to side come joined before (``_passing``).
    """
    low, high, near, far = "l" + a, "h" + a, "l" + b, "h" + b
    span = rects.groupBy("scene_id").agg(F.min(low).alias("__lo"), F.max(high).alias("__hi"), F.count("*").alias("__n"))
    largest = span.agg(F.max("__n")).first()[0] or 1
    most = min(int(math.log2(strips)), max(math.ceil(math.log2(largest / 8)), 0))
    count = F.pow(F.lit(2.0), F.least(F.ceil(F.log2(F.greatest(F.col("__n") / 8, F.lit(1.0)))), F.lit(most)))
    r = rects.join(span, "scene_id").withColumn("__wide", (F.col("__hi") - F.col("__lo")) / count)
    strip = lambda c: F.floor((F.col(c) - F.col("__lo")) / F.col("__wide"))
    r = r.withColumns({"__first": strip(low) + 1, "__last": strip(high)}).select("scene_id", *SIDES, "__lo", "__wide", "__first", "__last")
    cut = r.select("scene_id", "__lo", "__wide", low, high, near, far, F.explode(F.array_distinct(F.array(F.col("__first") - 1, F.col("__last")))).alias("strip"))
    begin, end = F.col("__lo") + F.col("strip") * F.col("__wide"), F.col("__lo") + (F.col("strip") + 1) * F.col("__wide")
    cut = cut.withColumns({"__from": F.greatest(F.col(low), begin), "__to": F.least(F.col(high), end)}).where("__from < __to")
    through = _passing(r, near, far, most).withColumns({"__from": begin, "__to": end})
    columns = ["scene_id", "strip", "__from", "__to", near, far]
    r = cut.select(*columns).unionByName(through.select(*columns))
    cuts = r.select("scene_id", "strip", F.explode(F.array("__from", "__to")).alias("at")).distinct()
    order = Window.partitionBy("scene_id", "strip").orderBy("at")
    slabs = cuts.withColumn("next", F.lead("at").over(order)).where("next IS NOT NULL")
    both = r.join(slabs, ["scene_id", "strip"]).where((F.col("__from") <= F.col("at")) & (F.col("__to") >= F.col("next")))
    slab = Window.partitionBy("scene_id", "strip", "at").orderBy(near, far).rowsBetween(Window.unboundedPreceding, -1)
    joined = both.withColumn("__before", F.max(far).over(slab))
    fresh = F.col("__before").isNull() | (F.col(near) > F.col("__before"))
    length = F.greatest(F.lit(0.0), F.col(far) - F.greatest(F.col(near), F.coalesce("__before", F.col(near))))
    wide = F.col("next") - F.col("at")
    return joined.groupBy("scene_id").agg(F.sum(length * wide).alias("area"), F.sum(F.when(fresh, 2 * wide).otherwise(0.0)).alias("edges"))


def unions(rects: DataFrame, strips: int = 4096) -> DataFrame:
    """(scene_id, area, outline) of the union of each scene's rectangles (lx, lz, hx, hz).

    What overlaps counts once; ``outline`` is the length of all edges of the union, holes included. Rectangles with a
    null or a number that is not finite, or without extent, count for nothing: a scene of such alone has area and
    outline 0. Repeated rectangles change nothing. A null scene_id is no scene.
    """
    sound = cells.finite([F.col(c).cast("double") for c in SIDES]) & (F.col("lx") < F.col("hx")) & (F.col("lz") < F.col("hz"))
    r = rects.where(F.col("scene_id").isNotNull() & sound).select("scene_id", *[F.col(c).cast("double").alias(c) for c in SIDES]).distinct()
    r = kept(r, "rectangles")
    x, z = _swept(r, "x", "z", strips), _swept(r, "z", "x", strips).select("scene_id", F.col("edges").alias("__more"))
    out = rects.where(F.col("scene_id").isNotNull()).select("scene_id").distinct().join(x.join(z, "scene_id"), "scene_id", "left")
    return out.select("scene_id", F.coalesce("area", F.lit(0.0)).alias("area"), F.coalesce(F.col("edges") + F.col("__more"), F.lit(0.0)).alias("outline"))


def two_part_floors(scenes: DataFrame, seed: int = 12) -> DataFrame:
    """A floor of two rectangles that share an edge for each scene (scene_id, lx, lz, hx, hz: where its middle may lie).

    Sides are log-uniform in 1.5 to 10 m, the second part lies on a drawn side of the first and is slid along the
    shared edge, of which 0.3 m at least stay. Gives (scene_id, part, cx, cz, dx, dz, yaw, area), two rows a scene: both
    parts are turned by one angle about the middle of their centres, and ``area`` is that of both. Scenes with a null or
    a number that is not finite have none.
    """
    sound = scenes.where(F.col("scene_id").isNotNull() & cells.finite([F.col(c).cast("double") for c in SIDES]))
    key = F.col("scene_id")
    u = lambda name, lo=0.0, hi=1.0: between(F.lit(lo), F.lit(hi), key, F.lit(name), seed=seed)
    side = lambda name: log_between(F.lit(1.5), F.lit(10.0), key, F.lit(name), seed=seed)
    f = sound.select("scene_id", *SIDES, *[side(n).alias(n) for n in ("ax", "az", "bx", "bz")], F.floor(u("side") * 4).alias("side"), u("slide", -1.0, 1.0).alias("slide"), u("yaw", 0.0, 2 * math.pi).alias("yaw"))
    along_x = F.col("side") < 2
    sign = F.when(F.col("side") % 2 == 0, 1.0).otherwise(-1.0)
    room = lambda p, q: F.greatest(F.lit(0.0), (F.least(p, q) - 0.3) / 2) * F.col("slide")
    f = f.withColumns({
        "ox": F.when(along_x, sign * (F.col("ax") + F.col("bx")) / 2).otherwise(room("ax", "bx")),
        "oz": F.when(along_x, room("az", "bz")).otherwise(sign * (F.col("az") + F.col("bz")) / 2),
        "mx": F.col("lx") + u("mx") * (F.col("hx") - F.col("lx")), "mz": F.col("lz") + u("mz") * (F.col("hz") - F.col("lz")),
        "area": F.col("ax") * F.col("az") + F.col("bx") * F.col("bz"),
    })
    c, s = F.cos("yaw"), F.sin("yaw")
    turned = lambda k: (F.col("mx") + k * (c * F.col("ox") - s * F.col("oz")), F.col("mz") + k * (s * F.col("ox") + c * F.col("oz")))
    parts = F.array(*[F.struct(F.lit(i).alias("part"), turned(k)[0].alias("cx"), turned(k)[1].alias("cz"), F.col(n + "x").alias("dx"), F.col(n + "z").alias("dz")) for i, (n, k) in enumerate((("a", -0.5), ("b", 0.5)))])
    return f.select("scene_id", "yaw", "area", F.inline(parts)).select("scene_id", "part", "cx", "cz", "dx", "dz", "yaw", "area")
