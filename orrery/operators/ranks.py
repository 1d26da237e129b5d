"""Exact quantiles by counting: a range is narrowed by counts of its cells until few values are left, and only these are
ordered. No group's values meet in one task, however many it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.rounds import kept

#: Values of a range that one task may order, and cells that a range is cut into by a pass.
FEW, CELLS = 50_000, 1024


def _cell(value: Column, low: Column, high: Column) -> Column:
    """The cell of a value in a range: greater values never lie in a lower cell. Infinities and NaN have their own."""
    share = (value / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
    inf = float("inf")
    return F.when(F.isnan(value), CELLS + 1).when(value == inf, CELLS).when(value == -inf, -1).otherwise(inside).cast("int")


def quantiles(rows: DataFrame, by: Sequence[str], values: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``by`` and for each of ``values`` an array of its exact quantiles, in the order of ``shares``, as <value>_q.

    Linear between the two values beside a place, as ``percentile`` does. Nulls do not count and NaN is greater than
    all numbers; a group without values has null quantiles. Null keys are a group. With no ``by`` all rows are one
    group; of an empty table there is one row then, with nulls, and none otherwise. Every pass counts cells of the
    ranges that still hold more than FEW values, in all groups at once, with sums made before anything moves.
    """
    by = list(by)
    keys = [f"__b{i}" for i in range(len(by))]
    flat = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("__v", "v"))
    flat = flat.where("v IS NOT NULL")
    group = [*keys, "__v"]
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    of = lambda extra: [F.count("*").alias("n"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"), *extra]
    whole = flat.groupBy(*group).agg(*of([]))
    # the places beside each share, counted from 0
    wanted = F.array(*[F.lit(float(q)) for q in shares])
    at = F.transform(wanted, lambda q: q * (F.col("n") - 1))
    places = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    ranges = kept(whole.withColumn("places", places).withColumn("below", F.lit(0).cast("bigint")), "ranges")
    sizes = ranges.select(*group, F.col("n").alias("__n"))
    found: list[DataFrame] = []
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in group]
    while True:
        # all values of a range equal: every place in it has that value
        flat_ones = ranges.where("least = most")
        found.append(flat_ones.select(*group, F.explode("places").alias("place"), F.col("least").alias("value")))
        small = ranges.where((F.col("least") != F.col("most")) & (F.col("n") <= FEW))
        inside = (F.col("f.v") >= F.col("r.least")) & (F.col("f.v") <= F.col("r.most"))
        near = flat.alias("f").join(small.alias("r"), [*same("f", "r"), inside])
        order = Window.partitionBy(*[F.col(f"r.{k}") for k in group], "r.below").orderBy("f.v")
        ordered = near.select(*[F.col(f"r.{k}").alias(k) for k in group], "r.places", "r.below", "f.v", (F.row_number().over(order) - 1 + F.col("r.below")).alias("place"))
        found.append(kept(ordered.where(F.array_contains("places", F.col("place"))).select(*group, "place", F.col("v").alias("value")), "places"))
        large = ranges.where((F.col("least") != F.col("most")) & (F.col("n") > FEW))
        if large.isEmpty():
            break
        both = flat.alias("f").join(large.alias("r"), [*same("f", "r"), inside])
        both = both.select(*[F.col(f"r.{k}").alias(k) for k in group], "r.places", "r.below", "f.v", _cell(F.col("f.v"), F.col("r.low"), F.col("r.high")).alias("cell"))
        counts = both.groupBy(*group, "below", "cell").agg(*of([F.first("places").alias("places")]))
        before = Window.partitionBy(*group, "below").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS + 3 rows at most
        counts = counts.withColumn("__under", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        mine = F.filter("places", lambda p: (p >= F.col("__under")) & (p < F.col("__under") + F.col("n")))
        ranges = kept(counts.withColumn("places", mine).where(F.size("places") > 0).select(*group, "n", "low", "high", "least", "most", "places", F.col("__under").alias("below")), "ranges")
    known = found[0]
    for f in found[1:]:
        known = known.unionByName(f)
    pairs = known.groupBy(*group).agg(F.map_from_entries(F.collect_set(F.struct("place", "value"))).alias("known"))  # two places a share at most
    done = sizes.alias("s").join(pairs.alias("k"), same("s", "k")).select(*[F.col(f"s.{k}").alias(k) for k in group], "__n", "known")

    def between(q: Column) -> Column:
        x = q * (F.col("__n") - 1)
        low, high = (F.element_at("known", f(x)) for f in (F.floor, F.ceil))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    done = done.withColumn("q", F.transform(wanted, between))
    pick = [F.max(F.when(F.col("__v") == i, F.col("q"))).alias(f"{v}_q") for i, v in enumerate(values)]
    if not by:
        return done.agg(*pick)
    out = done.groupBy(*keys).agg(*pick)
    every = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]).distinct()
    joined = every.alias("e").join(out.alias("o"), [F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left")
    return joined.select(*[F.col(f"e.{k}").alias(b) for b, k in zip(by, keys, strict=True)], *[f"{v}_q" for v in values])
