"""Whitening of embeddings by an exact covariance of their fixed-point numbers.

A block of distinct vectors is cut into bit planes: bit k of a dimension, less the block's least number there, packed 64
rows to a word. The scatter of two dimensions is the sum over their planes of the counts of common bits (AND, then
popcount) weighted by powers of two: whole numbers without rounding, in pieces that Spark adds up. What comes to the
driver is one number for each pair of dimensions; it is centred as whole numbers and only then becomes a double matrix
for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import written

#: Fixed values of the fixed-point form: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block of bit planes; limbs of LIMB bits that carry a whole number of any size through a sum of longs.
BLOCK, LIMBS, LIMB = 8192, 6, 32
#: An eigenvalue below this share of the largest is rounding, not a direction of the data.
LEAST = 1e-12


def fixed_point(vectors: DataFrame, column: str, out: str = "x") -> DataFrame:
    """Adds ``out``, the whole numbers of each vector, and drops vectors with an entry that is null or not finite.

    An entry whose number does not fit a long counts as not finite.
    """
    c = F.col(column)
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < 9e18))
    numbers = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.withColumn(out, F.when(sound, numbers)).where(F.col(out).isNotNull())


def _planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each plane, its dimension and its bit; planes lie by dimension. ``u``: rows times dimensions, unsigned."""
    rows, dims = u.shape
    bits = [int(m).bit_length() for m in u.max(axis=0)]
    padded = np.zeros((-rows % 64 + rows, dims), np.uint64)
    padded[:rows] = u
    made = np.zeros((sum(bits), len(padded) // 64), np.uint64)
    dim, bit = np.repeat(np.arange(dims), bits), np.concatenate([np.arange(b) for b in bits] or [[]]).astype(np.int64)
    for k in range(max(bits, default=0)):
        packed = np.packbits((padded >> np.uint64(k) & np.uint64(1)).astype(bool), axis=0, bitorder="little")
        at = np.flatnonzero(bit == k)
        made[at] = np.ascontiguousarray(packed.T[dim[at]]).view(np.uint64)
    return made, dim, bit


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (objects: whole numbers of any size) of a block of rows of whole numbers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    u = x.astype(np.uint64) - low.astype(np.uint64)  # wraps to the true difference
    planes, dim, bit = _planes(u)
    sums, cross = np.zeros(dims, object), np.zeros((dims, dims), object)
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    for d, k, n in zip(dim, bit, ones, strict=True):
        sums[d] += int(n) << int(k)
    small = 2 * int(bit.max(initial=0)) + 2 + rows.bit_length() < 63
    first = np.searchsorted(dim, np.arange(dims + 1))
    for p in range(len(planes)):
        # planes of this dimension and those after it; within a dimension every ordered pair of planes counts
        at = first[dim[p]]
        both = np.bitwise_count(planes[p] & planes[at:]).sum(axis=1, dtype=np.int64)
        weighed = both << (bit[at:] + bit[p]) if small else both.astype(object) * np.array([1 << int(b + bit[p]) for b in bit[at:]], object)
        there = np.unique(dim[at:])
        cross[dim[p], there] += np.add.reduceat(weighed, first[there] - at).astype(object)
    cross = np.triu(cross) + np.triu(cross, 1).T
    origin = low.astype(object)
    cross = cross + np.outer(sums, origin) + np.outer(origin, sums) + rows * np.outer(origin, origin)
    return sums + rows * origin, cross


def _rows(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, limbs): cross-products for i <= j, sums for i = -1, and the number of rows for i = j = -1."""
    n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for batch in batches:
        x = _rows(batch, "x", dims)
        for at in range(0, len(x), BLOCK):
            part = scatter(x[at : at + BLOCK])
            sums, cross, n = sums + part[0], cross + part[1], n + len(x[at : at + BLOCK])
    if n:
        i, j = np.triu_indices(dims)
        i, j = np.concatenate([[-1], np.full(dims, -1), i]), np.concatenate([[-1], np.arange(dims), j])
        values = [n, *sums, *cross[np.triu_indices(dims)]]
        limbs = [[int(v) >> LIMB * t & (1 << LIMB) - 1 if t < LIMBS - 1 else int(v) >> LIMB * t for v in values] for t in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], names=["i", "j", *(f"l{t}" for t in range(LIMBS))])


def exact_scatter(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of ``x`` over all rows; the driver gets a row for each pair of dimensions."""
    parts = fit.select("x").mapInArrow(lambda b: _sums(b, dims), "i int, j int, " + ", ".join(f"l{t} long" for t in range(LIMBS)))
    n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for r in parts.groupBy("i", "j").agg(*[F.sum(f"l{t}").alias(f"l{t}") for t in range(LIMBS)]).collect():
        value = sum(r[f"l{t}"] << LIMB * t for t in range(LIMBS))
        if r.j < 0:
            n = value
        elif r.i < 0:
            sums[r.j] = value
        else:
            cross[r.i, r.j] = cross[r.j, r.i] = value
    return n, sums, cross


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, as longs where they hold it and as whole numbers of any size elsewhere."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    return n * x - sums.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - sums


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_exact) for every vector kept.

    Vectors that are null or hold a null or an entry that is not finite are dropped, and those of another length than
    most have (of equally common lengths the longest counts). The fit list is each distinct vector of whole numbers
    once, n of them. Components are numbered from 1 by falling eigenvalue; directions in which the fit list has no
    spread (an eigenvalue below 1e-12 of the largest) have no component, so fewer than ``components`` may come, none
    where all vectors are equal or there are none. ``deviation`` is the sum over dimensions of (n*x - S)^2, null where
    no long holds it; ``deviation_exact`` (a decimal of 38 digits) has it then, and is null beyond that. Repeated rows
    and null keys are rows like others; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = fixed_point(vectors.select(F.col(key), F.col(column)), column).select(F.col(key).alias("key"), "x")
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), F.col("d").desc()).head()
    dims = length.d if length else 0
    rows = rows.where(F.size("x") == dims)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not dims:
        return spark.createDataFrame([], schema)
    fit = written(rows.select("x").distinct(), "fit")
    n, sums, cross = exact_scatter(fit, dims)
    central = n * cross - np.outer(sums, sums)  # n^2 times the covariance, whole numbers
    covariance = np.array([[int(v) / (n * n) for v in row] for row in central])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > LEAST * max(float(values[0]), 0.0)).sum())) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)])
    explained = values[:kept] / (sum(int(central[d, d]) for d in range(dims)) / (n * n))
    sent = spark.sparkContext.broadcast((n, sums, axes / np.sqrt(values[:kept]), explained))  # dimensions times components

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, sums, turn, _ = sent.value
        whole = _centred(x, n, sums)
        return whole, (whole / n).astype(float) @ turn

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = projected(_rows(batch, "x", dims))[1]
            total, square = total + w.sum(axis=0), square + w.T @ w
        i, j = (a.ravel() for a in np.indices((kept, kept)))
        at = np.concatenate([i, np.full(kept, -1)]), np.concatenate([j, np.arange(kept)])
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(np.concatenate([square.ravel(), total]))], names=["i", "j", "v"])

    sums_ = {(r.i, r.j): r.v / n for r in fit.mapInArrow(measured, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    error = max(abs(sums_[i, j] - sums_[-1, i] * sums_[-1, j] - (i == j)) for i in range(kept) for j in range(kept))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = sent.value[3]
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(low, BLOCK)
                m = batch.num_rows
                whole, w = projected(_rows(batch, "x", dims))
                if whole.dtype != object and int(np.abs(whole).max(initial=0)) ** 2 * dims < 1 << 63:
                    square = pa.array((whole * whole).sum(axis=1), pa.int64())
                    exact = square.cast(pa.decimal128(38, 0))
                else:
                    big = [int(v) for v in (whole.astype(object) ** 2).sum(axis=1)]
                    square = pa.array([v if v < 1 << 63 else None for v in big], pa.int64())
                    exact = pa.array([Decimal(v) if v < 10**38 else None for v in big], pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(m), kept))
                columns = [batch.column("key").take(at), pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), pa.array(np.full(m * kept, n), pa.int64()), square.take(at)]
                columns += [pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * kept, error)), exact.take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(out, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` on up to 16 components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
