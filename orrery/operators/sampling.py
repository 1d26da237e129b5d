"""Deterministic sampling: an order by hash takes the place of a seeded shuffle, so the partitioning does not matter."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.rounds import kept


def draw(*key: Column, seed: int = 0) -> Column:
    """A number for a row that looks random: the first 15 hex digits of an MD5, as other engines can compute it."""
    text = F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(*key: Column, seed: int = 0) -> Column:
    """``draw`` in [0, 1)."""
    return draw(*key, seed=seed) / float(16**15)


def hash_rank(rows: DataFrame, order: Column, key: str, out: str) -> DataFrame:
    """Adds ``out``: the place (from 1) of each row by ``order``, a ``draw``, and key.

    Rows are ranked within 4096 ranges of the draw; counts of the ranges (as many rows at most) give the rest.
    """
    cell = F.shiftright(order, 48)
    counts = rows.groupBy(cell.alias("__c")).agg(F.count("*").alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__c", F.coalesce(below, F.lit(0)).alias("__below"))
    ranked = rows.withColumn("__c", cell).withColumn("__row", F.row_number().over(Window.partitionBy("__c").orderBy(order, key)))
    return ranked.join(counts, "__c").select(*rows.columns, (F.col("__below") + F.col("__row")).alias(out))


#: Bits of a draw that a pass of ``first_of_each`` counts by, and passes: rows of one cell of the last are ranked.
CELL_BITS, PASSES = 12, 2


def first_of_each(rows: DataFrame, kind: str, order: Column, key: str, quota: DataFrame, count: str) -> tuple[DataFrame, DataFrame]:
    """The first rows of each kind by ``order`` (a ``draw``) and key, as many as ``quota`` (kind as __kind, ``count``) says, and
    all other rows of the kinds in it.

    Counts by the leading bits of the draw say in which cell a kind's cut lies, then those by the next bits within that
    cell; rows before it are taken as they are and only the cell of the cut is ranked: no kind is sorted whole.
    """
    marked = rows.withColumn("__draw", order)
    cell = lambda turn: F.shiftright(F.col("__draw"), 60 - CELL_BITS * (turn + 1))  # noqa: E731  all leading bits so far
    cuts = quota.select("__kind", F.col(count).cast("bigint").alias("__left"), F.lit(0).cast("bigint").alias("__cut"))
    for turn in range(PASSES):
        inside = marked.join(cuts.select("__kind", "__cut"), F.col(kind).eqNullSafe(F.col("__kind")))
        inside = inside.where(cell(turn - 1) == F.col("__cut")) if turn else inside
        counts = inside.groupBy("__kind", cell(turn).alias("__cell")).agg(F.count("*").alias("__n"))
        before = Window.partitionBy("__kind").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # 2^CELL_BITS rows at most
        counts = counts.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        counts = counts.select(F.col("__kind").alias("__k"), "__cell", "__n", "__below")
        both = cuts.join(counts, F.col("__kind").eqNullSafe(F.col("__k")) & (F.col("__below") < F.col("__left")) & (F.col("__left") <= F.col("__below") + F.col("__n")), "left")
        # a quota of none cuts before the first cell, one of more than there are behind the last
        past = F.when(F.col("__left") > 0, F.lit(1 << 61)).otherwise(F.lit(-1).cast("bigint"))
        cuts = both.select("__kind", F.coalesce("__cell", past).alias("__cut"), F.coalesce(F.col("__left") - F.col("__below"), F.col("__left")).alias("__left"))
    final = cuts.select("__kind", "__cut", "__left")
    joined = marked.join(final, F.col(kind).eqNullSafe(F.col("__kind")))
    at = cell(PASSES - 1)
    edge = joined.where(at == F.col("__cut")).withColumn("__rank", F.row_number().over(Window.partitionBy(kind).orderBy("__draw", key)))
    first = joined.where(at < F.col("__cut")).select(*rows.columns).unionByName(edge.where("__rank <= __left").select(*rows.columns))
    other = joined.where(at > F.col("__cut")).select(*rows.columns).unionByName(edge.where("__rank > __left").select(*rows.columns))
    return first, other


def stratified(rows: DataFrame, kind: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with equal shares of each kind; what a share lacks is filled from all other rows.

    The remainder of n over the kinds goes to the largest ones (equal sizes by name). The allocation is a table with
    a row a kind; where a kind's share ends is found by counts (``first_of_each``), and only rows near there are ranked.
    """
    order = draw(F.col(key), seed=seed)
    sizes = rows.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("__size"))
    every = Window.partitionBy(F.lit(0))  # one row a kind
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("__size").desc(), "__kind"))
    share = sizes.withColumns({"__k": F.count("*").over(every), "__rank": rank})
    share = share.withColumn("__alloc", F.floor(F.lit(n) / F.col("__k")) + F.when(F.col("__rank") <= F.lit(n) % F.col("__k"), 1).otherwise(0))
    share = kept(share.select("__kind", "__size", "__alloc"), "shares")
    first, other = first_of_each(rows, kind, order, key, share, "__alloc")
    taken = share.agg(F.sum(F.least("__alloc", "__size")).alias("__taken"))
    fill = other.orderBy(draw(F.col(key), seed=seed + 1), key).limit(n)
    fill = fill.withColumn("__f", F.row_number().over(Window.orderBy(draw(F.col(key), seed=seed + 1), key)))
    fill = fill.crossJoin(taken).where(F.col("__f") <= F.lit(n) - F.col("__taken"))  # at most n rows and one row
    return first.unionByName(fill.select(*rows.columns))


def fraction(rows: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """The greatest of 1 and the whole part of ``rate`` of the rows, in hash order; none of an empty table."""
    want = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") * rate)).alias("__want"))  # one row
    ranked = hash_rank(rows, draw(F.col(key), seed=seed), key, "__rank")
    return ranked.crossJoin(want).where("__rank <= __want").select(*rows.columns)


def mixture_weights(rows: DataFrame, dataset: str, weights: Mapping[str, float]) -> DataFrame:
    """Weight of an item: its dataset's (1 if none is given) over the dataset's rows."""
    sizes = rows.groupBy(dataset).agg(F.count("*").alias("n"))
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col(dataset) == name, w).otherwise(weight)
    return sizes.select(dataset, "n", (weight / F.col("n")).alias("weight"))


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, as often as the weights say: (draw, key).

    Weights are summed by 256 hash buckets first; a draw picks its bucket, then its row by the bucket's running sums.
    """
    bucket = F.pmod(draw(F.col(key), seed=seed), F.lit(256))
    rows = rows.where(F.col(weight) > 0).select(F.col(key), F.col(weight).alias("__w"), bucket.alias("__b"))
    up = Window.partitionBy("__b").orderBy(key)
    inside = rows.withColumns({"__hi": F.sum("__w").over(up)}).withColumn("__lo", F.col("__hi") - F.col("__w"))
    per = rows.groupBy("__b").agg(F.sum("__w").alias("__bw"))
    ups = Window.partitionBy(F.lit(0)).orderBy("__b")
    per = per.withColumns({"__bhi": F.sum("__bw").over(ups), "__all": F.sum("__bw").over(Window.partitionBy(F.lit(0)))})
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed=seed + 1).alias("__u"))
    cuts = per.agg(F.array_sort(F.collect_list(F.struct("__bhi", "__b", "__bw"))).alias("__cuts"), F.max("__all").alias("__total"))  # 256 at most
    picked = draws.crossJoin(cuts).withColumn("__at", F.col("__u") * F.col("__total"))
    picked = picked.withColumn("__c", F.try_element_at(F.filter("__cuts", lambda c: c["__bhi"] > F.col("__at")), F.lit(1)))
    picked = picked.select("draw", F.col("__c.__b").alias("__b"), (F.col("__at") - F.col("__c.__bhi") + F.col("__c.__bw")).alias("__x"))
    hit = picked.join(inside, "__b").where((F.col("__x") >= F.col("__lo")) & (F.col("__x") < F.col("__hi")))
    return hit.select("draw", key)


def fixed_composition(probes: DataFrame, others: DataFrame, key: str, slots: int, block: int, seed: int = 0) -> DataFrame:
    """Blocks of ``block`` rows with exactly ``slots`` probes; the other rows follow without replacement: (key, block, place)."""

    def dealt(rows: DataFrame, per: int, first: int) -> DataFrame:
        ranked = hash_rank(rows.select(key), draw(F.col(key), seed=seed), key, "__r").withColumn("__i", F.col("__r") - 1)
        return ranked.select(key, F.floor(F.col("__i") / per).alias("block"), (F.col("__i") % per + first).alias("place"))

    return dealt(probes, slots, 0).unionByName(dealt(others, block - slots, slots))


def hash_limit(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows in hash order."""
    return rows.orderBy(draw(F.col(key), seed=seed), key).limit(n)


def sliced(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of ``order``, to the end without a limit."""
    rest = rows.orderBy(*order).offset(offset)
    return rest if limit is None else rest.limit(limit)


def linspace_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows a group, spread evenly with both ends: those at int(i * (T - 1) / (n - 1))."""
    w = Window.partitionBy(*by)
    t = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__t": F.count("*").over(w)})
    step = (F.col("__t") - 1).cast("double") / max(n - 1, 1)
    marks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == n - 1) & F.lit(n > 1), F.col("__t") - 1).otherwise((i * step).cast("long")))
    return t.where((F.col("__t") <= n) | F.array_contains(marks, F.col("__i").cast("long"))).drop("__i", "__t")


def inner_linspace(t: Column, n: int) -> Column:
    """Indices of n + 2 even points of 0..t-1 without both ends."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * ((t - 1).cast("double") / (n + 1))).cast("long"))


def bucket_random(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """One row by hash from each of ``n`` even runs of a group."""
    w = Window.partitionBy(*by)
    t = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__t": F.count("*").over(w)})
    t = t.withColumn("__run", F.least(F.floor(F.col("__i") * n / F.col("__t")), F.lit(n - 1)))
    pick = F.row_number().over(Window.partitionBy(*by, "__run").orderBy(draw(F.col(key), seed=seed), key))
    return t.withColumn("__p", pick).where("__p = 1").drop("__i", "__t", "__run", "__p")


def compacted(rows: DataFrame, by: Sequence[str], key: str, position: str | None = None) -> DataFrame:
    """New dense indices of the ids that are used: by id, or by first use if ``position`` is given."""
    first = rows.groupBy(*by, key).agg(F.min(position if position else key).alias("__first"))
    return first.select(*by, key, (F.dense_rank().over(Window.partitionBy(*by).orderBy("__first", key)) - 1).alias("index"))


def remapped_time(rows: DataFrame, by: Sequence[str], frame: str, last: int) -> DataFrame:
    """Frames moved to start at 0, compressed evenly where their spread is more than ``last``, and clamped: column t."""
    w = Window.partitionBy(*by)
    low, high = F.min(frame).over(w), F.max(frame).over(w)
    spread = high - low
    scaled = F.when(spread <= last, F.col(frame) - low).otherwise((F.col(frame) - low) * last / F.greatest(spread, F.lit(1)))
    return rows.withColumn("t", F.least(F.greatest(F.bround(scaled).cast("int"), F.lit(0)), F.lit(last)))


def contiguous_shards(rows: DataFrame, order: Sequence[str], world: int, cells: int = 256) -> DataFrame:
    """Shard of each row in order of ``order`` (the first column a number); the last one takes the remainder.

    Approximate quantiles of the first column cut the order into cells; cells are counted, and rows ranked inside.
    The quantiles depend on the order in which parts are merged: they are written, so that both uses see the same cells.
    """
    cuts = rows.agg(F.array_distinct(F.percentile_approx(order[0], [k / cells for k in range(1, cells)])).alias("__cuts"), F.count("*").alias("__n"))
    cuts = kept(cuts, "cuts")
    placed = rows.crossJoin(cuts)  # one row
    placed = placed.withColumn("__cell", F.size(F.filter("__cuts", lambda c: c < F.col(order[0]))))
    counts = placed.groupBy("__cell").agg(F.count("*").alias("__c"))
    below = F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__cell", F.coalesce(below, F.lit(0)).alias("__below"))
    ranked = placed.withColumn("__row", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) - 1).join(counts, "__cell")
    size = F.greatest(F.floor(F.col("__n") / world), F.lit(1))
    return ranked.select(*rows.columns, F.least(F.floor((F.col("__below") + F.col("__row")) / size), F.lit(world - 1)).cast("int").alias("shard"))


def farthest_points(points: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Greedy farthest-point sample of each group's (id, x, y, z): (by, id, rank), the first farthest from the mean.

    A round finds the next point of all groups at once by a maximum that is made before anything moves, so no group meets
    in one task; from round to round only the points chosen so far are carried, at most ``n`` a group. Of equally far
    points the least id is taken. Null keys are a group; points with an id that is chosen are not chosen again; points
    without an id or a finite place are left out; a group with fewer ids than ``n`` gives all of them.
    """
    keys, place = [f"__b{i}" for i in range(len(by))], ("x", "y", "z")
    sound = F.col("id").isNotNull()
    for c in place:
        sound = sound & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    own = [F.col(c).cast("double").alias(c) for c in place]
    rows = points.where(sound).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("id").cast("long").alias("id"), *own)

    def square(p: Column) -> Column:
        return sum(((F.col(f"r.{c}") - p[c]) * (F.col(f"r.{c}") - p[c]) for c in place), F.lit(0.0))

    middle = F.struct(F.lit(None).cast("long").alias("id"), *[F.avg(c).alias(c) for c in place])
    chosen = kept(rows.groupBy(*keys).agg(F.array(middle).alias("chosen")), "farthest")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    for turn in range(n):
        near = F.array_min(F.transform("chosen", square))
        new = ~F.coalesce(F.array_contains("chosen.id", F.col("r.id")), F.lit(False))
        open_ = rows.alias("r").join(chosen.alias("c"), same).where(new)
        # the least id has the greatest of what is left of all longs below it
        far = F.struct(near.alias("gap"), (-1 - F.col("r.id")).alias("back"), *[F.col(f"r.{c}").alias(c) for c in place])
        best = open_.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(F.max(far).alias("best"))
        point = F.struct((-1 - F.col("best.back")).alias("id"), *[F.col(f"best.{c}").alias(c) for c in place])
        so_far = F.slice("chosen", 2, n) if turn == 0 else F.col("chosen")
        added = F.when(F.col("best").isNull(), so_far).otherwise(F.concat(so_far, F.array(point)))
        joined = chosen.alias("r").join(best.alias("c"), same, "left")
        chosen = kept(joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], added.alias("chosen")), "farthest")
    out = chosen.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.posexplode("chosen").alias("__rank", "__p"))
    return out.select(*by, F.col("__p.id").alias("id"), F.col("__rank").cast("long").alias("rank"))


def hypergeometric_split(counts: DataFrame, by: str, budget: int, seed: int = 0) -> DataFrame:
    """A budget split over the pools (pool, n) of each group without replacement, by a seeded draw: adds take."""
    kind = counts.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pool", ignore_index=True)
        n = pdf["n"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf[by].iloc[0]).encode())])
        pdf["take"] = rng.multivariate_hypergeometric(n, min(budget, int(n.sum())), method="marginals")
        return pdf[[by, "pool", "n", "take"]]

    return counts.select(by, "pool", "n").groupBy(by).applyInPandas(run, f"{by} {kind}, pool string, n long, take long")


def grouped_draws(items: DataFrame, groups: Mapping[str, float], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws: a group by weight, then a scene of it evenly, then an item of the scene evenly: (draw, group, scene, item)."""
    total = sum(groups.values())
    high, at = [], 0.0
    for name, w in groups.items():
        at += w / total
        high.append((name, at))
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"))
    u = uniform(F.col("draw"), seed=seed)
    picked = F.lit(high[-1][0])
    for name, h in reversed(high[:-1]):
        picked = F.when(u < h, name).otherwise(picked)
    draws = draws.withColumn("group", picked)
    scenes = items.select("group", "scene").distinct()
    scenes = scenes.withColumns({"__s": F.row_number().over(Window.partitionBy("group").orderBy("scene")) - 1, "__ns": F.count("*").over(Window.partitionBy("group"))})
    per = scenes.groupBy("group").agg(F.max("__ns").alias("__ns"))
    with_scene = draws.join(per, "group").withColumn("__s", F.floor(uniform(F.col("draw"), seed=seed + 1) * F.col("__ns"))).drop("__ns")
    with_scene = with_scene.join(scenes.drop("__ns"), ["group", "__s"]).drop("__s")
    w = Window.partitionBy("group", "scene")
    ranked = items.withColumns({"__i": F.row_number().over(w.orderBy("item")) - 1, "__ni": F.count("*").over(w)})
    sizes = ranked.groupBy("group", "scene").agg(F.max("__ni").alias("__ni"))
    with_item = with_scene.join(sizes, ["group", "scene"]).withColumn("__i", F.floor(uniform(F.col("draw"), seed=seed + 2) * F.col("__ni"))).drop("__ni")
    return with_item.join(ranked.select("group", "scene", "item", "__i"), ["group", "scene", "__i"]).select("draw", "group", "scene", "item")
