"""Joins: by key with a rule for repeated keys, with fallback, nearest in time, spatial, and against leakage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import boxes, geometry
from orrery.operators import cells
from orrery.operators.nearby import nearest_pair, nearest_patch  # noqa: F401  joins too


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: that with the largest ``order``."""
    return _one(df, keys, order, F.max_by)


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: that with the smallest ``order``."""
    return _one(df, keys, order, F.min_by)


def _one(df: DataFrame, keys: Sequence[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__row"))
    return chosen.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Left join with one row a key at most: the last one of ``right``."""
    return left.join(last_wins(right, keys, order), list(keys), "left")


def list_lookup(lists: DataFrame, ids: str, objects: DataFrame, key: str, value: str, whole: bool, by: Sequence[str]) -> DataFrame:
    """For each row's list ``ids`` the found values in list order, by ``by`` (unique) and object ``key``.

    ``whole``: a row with a miss gets null instead of the found part. Adds ``found`` and ``missed``.
    """
    flat = lists.select(*by, F.posexplode(ids).alias("__pos", key))
    hit = flat.join(objects.select(key, F.col(value).alias("__v")), key, "left")
    grouped = hit.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("__pos", "__v")))), lambda x: x["__v"]).alias("found"),
        F.count_if(F.col("__v").isNull()).alias("missed"),
    )
    if whole:
        grouped = grouped.withColumn("found", F.when(F.col("missed") == 0, F.col("found")))
    return lists.join(grouped, list(by), "left")


def with_fallback(left: DataFrame, right: DataFrame, full: Sequence[str], part: Sequence[str], value: str, order: str) -> DataFrame:
    """``value`` by all keys, else by fewer; ``matched`` tells which. The last row of a repeated key counts."""
    best = last_wins(right.select(*full, value, order), full, order).select(*[F.col(k).alias(f"__f_{k}") for k in full], F.col(value).alias("__full"))
    next_ = last_wins(right.select(*part, value, order), part, order).select(*[F.col(k).alias(f"__p_{k}") for k in part], F.col(value).alias("__part"))
    on_full = [F.col(k) == F.col(f"__f_{k}") for k in full]
    on_part = [F.col(k) == F.col(f"__p_{k}") for k in part]
    joined = left.join(best, on_full, "left").join(next_, on_part, "left")
    how = F.when(F.col("__full").isNotNull(), "full").when(F.col("__part").isNotNull(), "part").otherwise("none")
    return joined.select(*left.columns, F.coalesce("__full", "__part").alias(value), how.alias("matched"))


def without_leakage(rows: DataFrame, held_out: DataFrame, key: str, when: Column | None = None) -> DataFrame:
    """Rows whose ``key`` is not held out; ``when`` limits which rows the rule is for."""
    ids = held_out.select(F.col(key).alias("__key")).distinct()
    condition = F.col(key) == F.col("__key")
    return rows.join(ids, condition if when is None else condition & when, "left_anti")


def leakage_report(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Kept and dropped rows and keys, in one pass over the joined rows."""
    marked = rows.join(held_out.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    dropped = F.col("__in").isNotNull()
    return marked.agg(
        F.count_if(~dropped).alias("kept"),
        F.count_if(dropped).alias("dropped"),
        F.countDistinct(F.when(~dropped, F.col(key))).alias("kept_keys"),
        F.countDistinct(F.when(dropped, F.col(key))).alias("dropped_keys"),
    )


def allowed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def overridden(rows: DataFrame, truth: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows whose key ``truth`` has, with ``columns`` taken from there and all others as they were.

    Of several rows of a key in ``truth`` the least values count; a null key has no match.
    """
    key = list(key)
    best = truth.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min(F.struct(*columns)).alias("__new"))
    both = rows.join(best, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(key)])
    return both.select(*[F.col(f"__new.{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str, tolerance: float | None = None, later: bool = False, width: float = 3600.0) -> DataFrame:
    """``value`` and its time of the row of ``right`` nearest in time within ``by``.

    Equal distances take the earlier one, or the later if ``later``; beyond ``tolerance`` there is none. Both sides
    are merged and the last value before and the first after come from sorted windows over spans of ``width`` (in the
    unit of ``time``), so a key with most of the rows is many tasks' work; spans pass on their last and first value
    through a table with a row a span. No pairs are made. Columns __value and __time are added; a null key or time
    has none.
    """
    by = list(by)
    cell = F.floor(F.col("__t") / width)
    none = F.lit(None).cast(right.schema[value].dataType)
    own = left.select(*by, F.col(time).alias("__t"), F.struct(*left.columns).alias("__left"), none.alias("__v"), F.lit(1).alias("__side"))
    other = right.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("__t"), F.lit(None).cast(own.schema["__left"].dataType).alias("__left"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    merged = own.unionByName(other).withColumn("__cell", cell)
    mark = F.when(F.col("__side") == 0, F.struct("__t", "__v"))
    up = Window.partitionBy(*by, "__cell").orderBy("__t", "__side", F.col("__v"))
    before = F.last(mark, True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(*by, "__cell").orderBy(F.col("__t").desc(), "__side", F.col("__v").desc())
    after = F.last(mark, True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    seen = merged.withColumns({"__b": before, "__a": after}).where("__side = 1")
    # what earlier and later spans of a key pass on
    ends = merged.groupBy(*by, "__cell").agg(F.max(mark).alias("__last"), F.min(mark).alias("__first"))
    spans = Window.partitionBy(*by).orderBy("__cell")
    carried = ends.select(
        *[F.col(k).alias(f"__k_{k}") for k in by], F.col("__cell").alias("__k_cell"),
        F.last("__last", True).over(spans.rowsBetween(Window.unboundedPreceding, -1)).alias("__cb"),
        F.first("__first", True).over(spans.rowsBetween(1, Window.unboundedFollowing)).alias("__ca"),
    )
    on = [F.col(k) == F.col(f"__k_{k}") for k in by] + [F.col("__cell") == F.col("__k_cell")]
    seen = seen.join(carried, on, "left").withColumns({"__b": F.coalesce("__b", "__cb"), "__a": F.coalesce("__a", "__ca")})
    past, ahead = F.col("__t") - F.col("__b.__t"), F.col("__a.__t") - F.col("__t")
    take_after = F.col("__b").isNull() | (F.col("__a").isNotNull() & ((ahead <= past) if later else (ahead < past)))
    best = F.when(take_after, F.col("__a")).otherwise(F.col("__b"))
    out = seen.select("__left", best.alias("__best"), F.col("__t").alias("__own"))
    if tolerance is not None:
        out = out.withColumn("__best", F.when(F.abs(F.col("__best.__t") - F.col("__own")) <= tolerance, F.col("__best")))
    return out.select("__left.*", F.col("__best.__t").alias("__time"), F.col("__best.__v").alias("__value"))


def inside_boxes(points: DataFrame, objects: DataFrame, scene: str, box: str, xyz: Sequence[str], inflation: float = 0.0) -> DataFrame:
    """Points with every oriented box of their scene that holds them.

    An equi-join on the scene; a point meets the boxes of its scene only. A box is turned once, not once a point.
    """
    o = objects.withColumn("__turned", F.array(*boxes.turned(F.col(box), inflation)))
    return points.join(o, scene).where(boxes.holds_turned(F.col("__turned"), *[F.col(c) for c in xyz])).drop("__turned")


#: Distinct points of a chunk; boxes of a block; blocks that a scene's boxes are dealt into while they hold fewer than CHUNK.
CHUNK, BLOCK, BLOCKS = 65536, 4096, 16


def held_counts(points: DataFrame, objects: DataFrame, scene: str, key: str, box: str, xyz: Sequence[str], inflation: float = 0.0) -> DataFrame:
    """(key, n): how many points of their scene oriented boxes hold; those that hold none are left out.

    Equal points are counted first. A scene's points are cut into chunks of neighbouring cells, and by a hash where one
    cell has more than a chunk; its boxes are dealt into blocks. Each block meets each chunk in a task, where boxes go
    down a tree of the chunk's points (``boxes.held``), so that no pairs are made and no scene is one task's.
    """
    p = points.where(F.forall(F.array(*xyz), lambda v: v.isNotNull()) & F.col(scene).isNotNull())
    p = p.groupBy(F.col(scene).alias("__scene"), *[F.col(c).cast("double").alias(f"__{a}") for c, a in zip(xyz, "xyz", strict=True)]).agg(F.count("*").alias("__w"))
    o = objects.select(F.col(scene).alias("__scene"), F.col(key).alias("__key"), F.array(*boxes.turned(F.col(box), inflation)).alias("__box"))
    o = o.where(F.forall("__box", lambda v: v.isNotNull()) & F.col("__scene").isNotNull())
    # where a point lies among 16 x 16 x 16 cells of its scene; those that are not finite in one more
    whole = [F.when(cells.finite([F.col(f"__{a}") for a in "xyz"]), F.col(f"__{a}")) for a in "xyz"]
    span = p.groupBy("__scene").agg(*[f(c).alias(f"__{n}{a}") for c, a in zip(whole, "xyz", strict=True) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    share = lambda a: (F.col(f"__{a}") / 2 - F.col(f"__lo{a}") / 2) / F.nullif(F.col(f"__hi{a}") / 2 - F.col(f"__lo{a}") / 2, F.lit(0.0))
    at = [F.least(F.floor(F.coalesce(share(a), F.lit(0.0)) * 16), F.lit(15)) for a in "xyz"]
    curve = sum((F.shiftleft(F.shiftright(n, b).bitwiseAND(1), 3 * b + i) for i, n in enumerate(at) for b in range(4)), F.lit(0).cast("bigint"))
    p = p.join(span, "__scene").withColumn("__cell", F.when(cells.finite([F.col(f"__{a}") for a in "xyz"]), curve).otherwise(-1)).select("__scene", "__x", "__y", "__z", "__w", "__cell")
    before = F.sum("__n").over(Window.partitionBy("__scene").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))  # 4,097 rows at most
    held = p.groupBy("__scene", "__cell").agg(F.count("*").alias("__n"))
    held = held.select("__scene", "__cell", F.floor(F.coalesce(before, F.lit(0)) / CHUNK).alias("__first"), F.ceil(F.col("__n") / CHUNK).alias("__parts"))
    chunks = held.select("__scene", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__parts") - 1)).alias("__chunk")).distinct()
    dealt = o.groupBy("__scene").agg(F.count("*").alias("__n"))
    dealt = dealt.select("__scene", F.greatest(F.least(F.ceil(F.col("__n") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("__n") / CHUNK)).alias("__blocks"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["__scene", "__chunk", "__block"]
    left = p.join(held, ["__scene", "__cell"]).join(dealt, "__scene")
    left = left.withColumn("__chunk", F.col("__first") + F.pmod(F.xxhash64("__x", "__y", "__z"), F.col("__parts")))
    left = left.select("__scene", "__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)).alias("__block"), "__x", "__y", "__z", "__w")
    right = o.join(dealt, "__scene").withColumn("__block", F.pmod(F.xxhash64("__key"), F.col("__blocks"))).join(chunks, "__scene").select(*by, "__key", "__box")

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"__key": b["__key"][:0], "__n": np.zeros(0, np.int64)})
        found = boxes.held(a[["__x", "__y", "__z"]].to_numpy(), a["__w"].to_numpy(), np.stack(b["__box"].to_numpy()))
        return pd.DataFrame({"__key": b["__key"], "__n": found})[found > 0]

    # dealt by number: groups are few and small in bytes, and would be coalesced into one task
    both = left.repartition(n, *by).groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by))
    counts = both.applyInPandas(met, f"`__key` {o.schema['__key'].dataType.simpleString()}, `__n` bigint")
    return counts.groupBy(F.col("__key").alias(key)).agg(F.sum("__n").alias("n"))


def visible(points: DataFrame, cameras: DataFrame, scene: str) -> DataFrame:
    """(points x, y, z) × (cameras pose, fx, fy, cx, cy, width, height) of a scene where the point is in view."""
    both = points.join(cameras, scene)
    local = geometry.inverse_applied(F.col("pose"), F.col("x"), F.col("y"), F.col("z"))
    both = both.withColumns({"__x": local[0], "__y": local[1], "__z": local[2]})
    u, v = geometry.projected(F.col("__x"), F.col("__y"), F.col("__z"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    seen = both.withColumns({"u": u, "v": v}).where(geometry.in_frustum(F.col("u"), F.col("v"), F.col("__z"), F.col("width"), F.col("height")))
    return seen.drop("__x", "__y", "__z")


def unblocked(segments: DataFrame, occluders: DataFrame, scene: str, cell: float = 0.25, own: str | None = None) -> DataFrame:
    """Segments (x0..z0, x1..z1) that no box (lx..lz, hx..hz) of their scene cuts, met by grid cells.

    With ``own``, a column of both sides, a box does not cut segments of the same value: the thing that is looked at, or
    from. A box with a coordinate that is null or not finite cuts nothing, and such a segment or one without a scene
    stays; equal segments share their fate; other columns pass.
    """
    hits = cells.cut_segments(segments, occluders, scene, cell, own)
    keys = [scene, *[a + end for end in "01" for a in "xyz"], *([own] if own else [])]
    return segments.join(hits, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) if k == own else F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)], "left_anti")


def first_existing(wanted: DataFrame, listing: DataFrame, key: str, path: str, priority: str) -> DataFrame:
    """For each key the candidate path of least priority that the listing has."""
    there = wanted.join(listing.select(path).distinct(), path, "left_semi")
    best = there.groupBy(key).agg(F.min_by(path, priority).alias(path))
    return wanted.select(key).distinct().join(best, key, "left")
