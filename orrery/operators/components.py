"""Principal components of features as colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("r", "g", "b")


def _summed(parts: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of (i, j, v); a row for each pair of dimensions at most comes to the driver."""
    return {(r.i, r.j): r.v for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _partial(batches: Iterator[pa.RecordBatch], dims: int, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, np.zeros(dims), np.zeros((dims, dims))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        n += len(x)
        if mean is None:
            total += x.sum(axis=0)
        else:
            square += (x - mean).T @ (x - mean)
    i, j = (np.concatenate([[-1], np.arange(dims)]), np.full(dims + 1, -1)) if mean is None else (a.ravel() for a in np.indices((dims, dims)))
    v = np.concatenate([[n], total]) if mean is None else square.ravel()
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], names=["i", "j", "v"])


def component_colours(rows: DataFrame, features: str) -> tuple[DataFrame, list[float]]:
    """``rows`` with r, g and b: the three first components of ``features``, each scaled from 0 to 1 over all rows; and the
    share of the variance of each.

    The covariance is a sum of tasks' sums, centred before multiplying. A component's largest entry is positive. Lists
    that are null, hold a null or a number that is not finite, or have another length than most (of equally common ones
    the longest) have null colours, and so has every row where fewer components than three have a spread, for the missing
    ones; a component without spread among the rows is 0.
    """
    sound = F.forall(F.col(features), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    marked = rows.withColumn("__x", F.when(sound, F.col(features).cast("array<double>")))
    length = marked.where("__x IS NOT NULL").groupBy(F.size("__x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), F.col("d").desc()).head()
    dims = length.d if length else 0
    x = marked.where(F.size("__x") == dims).select("__x")
    none = [F.lit(None).cast("double").alias(n) for n in NAMES]
    if not dims:
        return rows.select("*", *none), []
    schema = "i int, j int, v double"
    sums = _summed(x.mapInArrow(lambda b: _partial(b, dims, None), schema))
    n = sums[-1, -1]
    mean = np.array([sums[i, -1] for i in range(dims)]) / n
    square = _summed(x.mapInArrow(lambda b: _partial(b, dims, mean), schema))
    values, axes = np.linalg.eigh(np.array([[square[i, j] for j in range(dims)] for i in range(dims)]) / n)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    kept = min(3, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    axes = axes[:, :kept] * np.where(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    shares = (values[:kept] / values.sum()).tolist() if values.sum() > 0 else []
    own = F.when(F.size("__x") == dims, F.col("__x"))
    along = lambda k: F.aggregate(F.zip_with(own, F.array(*[F.lit(float(v)) for v in axes[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    placed = marked.withColumns({f"__c{k}": along(k) for k in range(kept)})
    bounds = placed.agg(*[f(f"__c{k}").alias(f"__{m}{k}") for k in range(kept) for f, m in ((F.min, "lo"), (F.max, "hi"))]) if kept else None
    placed = placed.crossJoin(bounds) if kept else placed  # one row
    colours = [F.coalesce((F.col(f"__c{k}") - F.col(f"__lo{k}")) / F.nullif(F.col(f"__hi{k}") - F.col(f"__lo{k}"), F.lit(0.0)), F.when(F.col(f"__c{k}").isNotNull(), 0.0)).alias(NAMES[k]) for k in range(kept)]
    return placed.select(*rows.columns, *colours, *none[kept:]), shares
