"""Scores of results rolled up: micro, macro and pooled means, grouping sets, statistics, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import boxes
from orrery.functions.relations import pose_class
from orrery.operators import ranks


def family_of(kind: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """The family of a subtype; a type of no family is its own."""
    return reduce(lambda out, f: F.when(kind.isin(list(f[1])), f[0]).otherwise(out), families.items(), kind)


def by_type(results: DataFrame, kind: str, score: str) -> DataFrame:
    return results.groupBy(kind).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def official_overall(results: DataFrame, kind: str, family: str, score: str) -> DataFrame:
    """Mean over families of the mean over a family's subtypes of their means."""
    sub = results.groupBy(family, kind).agg(F.avg(score).alias("m"))
    return sub.groupBy(family).agg(F.avg("m").alias("m")).agg(F.avg("m").alias("official_overall"))


def pooled(results: DataFrame, family: str, score: str) -> DataFrame:
    """Mean of all samples of a family together."""
    return results.groupBy(family).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))


def displayed_overall(results: DataFrame, family: str, score: str, digits: int) -> DataFrame:
    """Mean of the families' pooled means, each as it is displayed, with ``digits`` decimals."""
    return pooled(results, family, score).agg(F.avg(F.round("mean", digits)).alias("official_overall"))


def micro(results: DataFrame, score: str) -> DataFrame:
    return results.agg(F.avg(score).alias("all_questions_average"), F.count("*").alias("n"))


def balanced(results: DataFrame, split: str, category: str, kind: str, score: str) -> DataFrame:
    """Rows for (split, category), (split, type) and split, in one pass."""
    sets = results.groupingSets([[F.col(split), F.col(category)], [F.col(split), F.col(kind)], [F.col(split)]], split, category, kind)
    return sets.agg(F.avg(score).alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def regression(rows: DataFrame, value: Column, target: Column) -> DataFrame:
    """Error statistics of pairs where both are finite numbers; none of fewer than two."""
    ok = value.isNotNull() & target.isNotNull() & ~F.isnan(value) & ~F.isnan(target)
    d = rows.where(ok).select(value.alias("p"), target.alias("g"), F.abs(value - target).alias("e"))
    within = {"1cm": 0.01, "5cm": 0.05, "10cm": 0.10, "0_5m": 0.5, "1_0m": 1.0, "2_0m": 2.0}
    stats = d.agg(
        F.count("*").alias("reg_n"),
        F.avg("e").alias("reg_mae"),
        *[F.avg(F.when(F.col("e") <= t, 1.0).otherwise(0.0)).alias(f"reg_within_{n}") for n, t in within.items()],
        F.avg("p").alias("reg_pred_mean"),
        F.stddev_pop("p").alias("reg_pred_std"),
        F.avg("g").alias("reg_gt_mean"),
        F.when((F.stddev_pop("p") > 0) & (F.stddev_pop("g") > 0), F.corr("p", "g")).otherwise(0.0).alias("reg_pearson_r"),
    )
    middle = ranks.quantiles(d, [], ["e"], [0.5]).select(F.get("e_q", F.lit(0)).alias("reg_medae"))
    return stats.where("reg_n >= 2").crossJoin(middle)  # a row each


def grounding(rows: DataFrame, overlap: Column, distance: Column) -> DataFrame:
    """Accuracies over the parsed predictions (overlap not null), parse rate over all."""
    d = rows.select(overlap.alias("i"), distance.alias("d"))
    share = lambda c, t, up: F.avg(F.when(F.col(c).isNotNull(), F.when((F.col(c) >= t) if up else (F.col(c) <= t), 1.0).otherwise(0.0)))
    middle = ranks.quantiles(d, [], ["i", "d"], [0.5]).select(F.get("i_q", F.lit(0)).alias("median_iou"), F.get("d_q", F.lit(0)).alias("centre_median"))
    stats = d.agg(
        *[share("i", t, True).alias(n) for n, t in (("acc_0_25", 0.25), ("acc_0_5", 0.5), ("acc_0_1", 0.1), ("acc_0_05", 0.05))],
        F.avg("i").alias("mean_iou"),
        (F.count("i") / F.greatest(F.count("*"), F.lit(1))).alias("parse_rate"),
        F.count("i").alias("n"),
        F.count("*").alias("total"),
        F.avg("d").alias("centre_mean"),
        *[share("d", t, False).alias(n) for n, t in (("within_0_5m", 0.5), ("within_1m", 1.0), ("within_2m", 2.0))],
    )
    return stats.crossJoin(middle)  # a row each


def multi_grounding(rows: DataFrame, f1_25: Column, f1_50: Column) -> DataFrame:
    return rows.agg(F.avg(f1_25).alias("f1_25"), F.avg(f1_50).alias("f1_50"), F.count(f1_25).alias("n"), F.count("*").alias("total"))


def binary(rows: DataFrame, label: Column) -> DataFrame:
    """Counts of yes and no, and what always saying the commoner one would score."""
    d = rows.select(label.alias("l")).where(F.col("l").isin("yes", "no"))
    yes, n = F.count_if(F.col("l") == "yes"), F.count("*")
    out = d.agg(n.alias("binary_n"), yes.alias("binary_yes"), (n - yes).alias("binary_no"), (yes / F.nullif(n, F.lit(0))).alias("yes_frac"), (F.greatest(yes, n - yes) / F.nullif(n, F.lit(0))).alias("majority"))
    return out.where("binary_n > 0")


def pose_audit(poses: DataFrame, scene: str, x: str, y: str, z: str) -> DataFrame:
    """Statistics of camera translations and a verdict per scene."""
    ok = F.lit(True)
    for c in (x, y, z):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    keep = lambda c: F.when(ok, c)
    norm = keep(F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2))
    spans = [F.max(keep(F.col(c))) - F.min(keep(F.col(c))) for c in (x, y, z)]
    over = lambda t: F.avg(F.when(norm.isNotNull(), F.when(norm > t, 1.0).otherwise(0.0)))
    s = poses.groupBy(scene).agg(
        F.count("*").alias("n"), F.count(norm).alias("n_finite"), F.max(norm).alias("max_t"),
        F.greatest(*spans).alias("span"), over(50).alias("frac_over_50"), over(500).alias("frac_over_500"),
    )
    far = ranks.quantiles(poses.select(F.col(scene).alias("__scene"), norm.alias("r")), ["__scene"], ["r"], [0.95, 0.5])
    s = s.join(far, F.col(scene).eqNullSafe(F.col("__scene"))).select(scene, "n", "n_finite", "max_t", F.get("r_q", F.lit(0)).alias("p95_t"), F.get("r_q", F.lit(1)).alias("p50_t"), "span", "frac_over_50", "frac_over_500")
    return s.withColumn("label", pose_class(F.col("n"), F.col("n_finite"), F.col("max_t"), F.col("span"), F.col("frac_over_50"), F.col("frac_over_500")))


def worst(audit: DataFrame, label: str, value: str, key: str, n: int = 30) -> DataFrame:
    """The ``n`` rows of largest ``value`` per label, with their rank."""
    w = Window.partitionBy(label).orderBy(F.col(value).desc(), key)
    return audit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def displayed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with their place: listed keys in list order, all others after them by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    at = F.when(place > 0, place).otherwise(len(order) + 1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at, key)))


def axis_quantiles(points: DataFrame, by: Sequence[str], axes: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of each axis, found by counting (``ranks.quantiles``)."""
    found = ranks.quantiles(points, by, axes, qs)
    return found.select(*by, *[F.get(f"{a}_q", F.lit(i)).alias(f"{a}_p{round(100 * q)}") for a in axes for i, q in enumerate(qs)])


def bounds(points: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Centre and size of the axis-aligned box of a group's points, rounded to 2 decimals."""
    out = points.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return out.select(*by, *[F.bround((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2, 2).alias(f"c_{a}") for a in axes], *[F.bround(F.col(f"hi_{a}") - F.col(f"lo_{a}"), 2).alias(f"d_{a}") for a in axes])


def footprints(points: DataFrame, by: str, x: str, z: str, part: int = 10_000) -> DataFrame:
    """by, area of the convex hull of each group's points, null where they span none.

    Each group is dealt by a hash of its points into parts of about ``part``; the corners of a part's hull go on to the
    group's.
    Points with a null or a number that is not finite count for nothing; a group of such points alone has a null area.
    """
    ok = F.forall(F.array(F.col(x).cast("double"), F.col(z).cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    corners = lambda g: g.agg(F.collect_list("__x").alias("xs"), F.collect_list("__z").alias("zs"))
    p = points.select(F.col(by), *[F.when(ok, F.col(c)).cast("double").alias(n) for c, n in ((x, "__x"), (z, "__z"))])
    sizes = p.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.count("*") / part).alias("__parts"))
    p = p.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    dealt = corners(p.groupBy(by, F.pmod(F.xxhash64("__x", "__z"), F.col("__parts")).alias("__part")))
    hulls = dealt.select(by, F.explode_outer(boxes.hull_corners()(F.col("xs"), F.col("zs"))).alias("c"))
    whole = corners(hulls.select(by, F.col("c.x").alias("__x"), F.col("c.z").alias("__z")).groupBy(by))
    return whole.select(by, boxes.footprint_area()(F.col("xs"), F.col("zs")).alias("area"))


def lower_median(values: Column) -> Column:
    """The middle of a list's non-null, non-NaN values, the lower one of two; null of none."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.get(kept, F.floor((F.size(kept) - 1) / 2).cast("int"))


def circular(rows: DataFrame, by: Sequence[str], angle: str) -> DataFrame:
    """Circular mean, its quarter turn, and the share of a group that rounds to that quarter."""
    import math

    quarter = lambda c: F.pmod(F.bround(c / (math.pi / 2)).cast("int"), F.lit(4))
    mean = rows.groupBy(*by).agg(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))).alias("mean"))
    mean = mean.withColumn("quarter", quarter(F.col("mean")))
    per = rows.groupBy(*by, quarter(F.col(angle)).alias("__q")).agg(F.count("*").alias("__n"))
    joined = per.join(mean, list(by))
    return joined.groupBy(*by, "mean", "quarter").agg((F.sum(F.when(F.col("__q") == F.col("quarter"), F.col("__n")).otherwise(0)) / F.sum("__n")).alias("agreement"))


def first_visible(seen: DataFrame, key: Sequence[str], frame: str, visible: Column) -> DataFrame:
    """The least frame in which a key is visible, -1 if none."""
    return seen.groupBy(*key).agg(F.coalesce(F.min(F.when(visible, F.col(frame))), F.lit(-1)).alias("first_frame"))


def appearance_order(first: DataFrame, scene: str, key: str, frame: str) -> DataFrame:
    """Order of first appearance; scenes where two appear at once, or one never, have none."""
    w = Window.partitionBy(scene)
    ok = first.withColumns({"__n": F.count("*").over(w), "__d": F.size(F.collect_set(frame).over(w)), "__lo": F.min(frame).over(w)})
    ok = ok.where((F.col("__n") == F.col("__d")) & (F.col("__lo") >= 0)).drop("__n", "__d", "__lo")
    return ok.withColumn("order", F.rank().over(w.orderBy(frame)))


def visible_fraction(rays: DataFrame, key: Sequence[str], blocked: Column, least: float = 0.10) -> DataFrame:
    free = F.avg(F.when(blocked, 0.0).otherwise(1.0))
    return rays.groupBy(*key).agg(free.alias("fraction"), F.when(free >= least, "yes").otherwise("no").alias("answer"))


def histogram(rows: DataFrame, reason: str) -> DataFrame:
    """Counts by what stands before the first colon of a reason."""
    return rows.groupBy(F.get(F.split(reason, ":"), F.lit(0)).alias("kind")).agg(F.count("*").alias("n"))


def checked_count(rows: DataFrame, expected: int) -> DataFrame:
    """One row with the count; fails where it is not ``expected``."""
    n = rows.agg(F.count("*").alias("n"))
    return n.select(F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} rows, found "), F.col("n").cast("string"))).cast("long")).alias("n"))


def dense(rows: DataFrame, by: str, kept: Column, most: float = 0.5) -> DataFrame:
    """Rows where ``kept`` holds; fails where a group of ``by`` would lose more than the share ``most`` of its rows.

    A null in ``kept`` drops the row; rows with a null in ``by`` are a group.
    """
    holds = F.coalesce(kept, F.lit(False))
    counts = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.count_if(~holds).alias("__gone"))
    said = F.concat(F.col("__gone").cast("string"), F.lit(" of "), F.col("__n").cast("string"), F.lit(" rows dropped of "), F.coalesce(F.col("__by").cast("string"), F.lit("null")))
    marked = rows.join(counts, F.col(by).eqNullSafe(F.col("__by")))
    sound = F.when(F.col("__gone") > F.col("__n") * most, F.raise_error(said).cast("boolean")).otherwise(holds)
    return marked.where(sound).select(*rows.columns)


def consistency(expected: DataFrame, actual: DataFrame, scene: str, stem: str) -> DataFrame:
    """Per scene the tags of what is missing or extra, and OK or BAD."""
    e = expected.select(scene, stem).distinct().withColumn("__e", F.lit(1))
    a = actual.select(scene, stem).distinct().withColumn("__a", F.lit(1))
    both = e.join(a, [scene, stem], "full")
    out = both.groupBy(scene).agg(F.count_if(F.col("__a").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("extra"), F.count("*").alias("n"))
    tags = F.filter(F.array(F.when(F.col("missing") > 0, F.concat(F.lit("missing:"), F.col("missing"))), F.when(F.col("extra") > 0, F.concat(F.lit("extra:"), F.col("extra")))), lambda t: t.isNotNull())
    return out.withColumn("tags", tags).withColumn("status", F.when(F.size("tags") == 0, "OK").otherwise("BAD"))


def similarity_fit(pairs: DataFrame, by: str) -> DataFrame:
    """Scale, yaw, translation and residual of the similarity that takes (px, py, pz) to (qx, qy, qz), per group.

    Means and the cross-covariance are aggregates; the 3 x 3 decomposition of a group's one row runs in an Arrow
    batch. Groups of fewer than three pairs have no fit.
    """
    axes = "xyz"
    moments = pairs.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.avg(f"{s}{a}").alias(f"m{s}{a}") for s in "pq" for a in axes],
        *[F.covar_pop(f"q{a}", f"p{b}").alias(f"c{a}{b}") for a in axes for b in axes],
        sum((F.var_pop(f"p{a}") for a in axes), F.lit(0.0)).alias("vp"),
        sum((F.var_pop(f"q{a}") for a in axes), F.lit(0.0)).alias("vq"),
    ).where("n >= 3 AND vp > 0")
    kind = pairs.schema[by].dataType.simpleString()

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c = np.array([[getattr(row, f"c{a}{b}") for b in axes] for a in axes])
                u, d, vt = np.linalg.svd(c)
                sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
                r = u @ sign @ vt
                s = float((d * np.diag(sign)).sum() / row.vp)
                t = np.array([getattr(row, f"mq{a}") for a in axes]) - s * r @ np.array([getattr(row, f"mp{a}") for a in axes])
                rest = max(0.0, row.vq - s * float((d * np.diag(sign)).sum()))
                out.append((getattr(row, by), int(row.n), s, float(np.arctan2(r[1, 0], r[0, 0])), *map(float, t), rest**0.5))
            import pandas as pd

            yield pd.DataFrame(out, columns=[by, "n", "scale", "yaw", "tx", "ty", "tz", "rmse"])

    return moments.mapInPandas(solve, f"{by} {kind}, n long, scale double, yaw double, tx double, ty double, tz double, rmse double")
