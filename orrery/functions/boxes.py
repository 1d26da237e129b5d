"""Boxes: parsing, formatting, overlap. A box is an array (cx, cy, cz, dx, dy, dz), oriented ones have three angles more."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"\s*(-?[\d.]+)\s*"
BINS = 1000


def _tuple(n: int) -> str:
    return r"\(" + ",".join([_NUM] * n) + r"\)"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|box_start\|>|<\|box_end\|>", "")


def _json(text: Column) -> Column:
    """The boxes of the JSON array between the first [ and the last ], null where that is none."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.transform(F.from_json(body, "array<struct<bbox_3d: array<double>>>"), lambda x: x["bbox_3d"])


def _doubles(texts: Column) -> Column:
    got = F.transform(texts, lambda v: v.try_cast("double"))
    return F.when(F.forall(got, lambda v: v.isNotNull()), got)


def parsed(text: Column, n: int = 6) -> Column:
    """One box of ``n`` numbers: the first of a JSON array, else the first (…) tuple, else null."""
    first = F.try_element_at(_json(text), F.lit(1))
    found = F.regexp_extract_all(_plain(text), F.lit(_tuple(n)), F.lit(0))
    numbers = F.regexp_extract_all(F.try_element_at(found, F.lit(1)), F.lit(r"-?[\d.]+"), F.lit(0))
    return F.coalesce(F.when((F.size(first) == n) & F.forall(first, lambda v: v.isNotNull()), first), _doubles(numbers))


def parsed_many(text: Column) -> Column:
    """All boxes of an answer; "none" is the empty list, oriented JSON boxes become axis-aligned."""
    made = _json(text)
    fits = F.forall(made, lambda b: F.coalesce(F.size(b).isin(6, 9), F.lit(False)) & F.forall(b, lambda v: v.isNotNull()))
    boxes = F.transform(made, lambda b: F.when(F.size(b) == 9, aligned(b)).otherwise(b))
    found = F.regexp_extract_all(_plain(text), F.lit(_tuple(6)), F.lit(0))
    tuples = F.filter(F.transform(found, lambda t: _doubles(F.regexp_extract_all(t, F.lit(r"-?[\d.]+"), F.lit(0)))), lambda b: b.isNotNull())
    none = F.lower(F.trim(text)) == "none"
    return F.when(none, F.array().cast("array<array<double>>")).when((F.size(made) > 0) & fits, boxes).otherwise(tuples)


def formatted(box: Column, digits: int = 2) -> Column:
    """``(a, b, …)`` with fixed decimals, half up as the JVM formats."""
    parts = F.transform(box, lambda v: F.format_string(f"%.{digits}f", v.cast("double")))
    return F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def formatted_many(boxes: Column, digits: int = 2) -> Column:
    return F.when(F.size(boxes) == 0, "none").otherwise(F.array_join(F.transform(boxes, lambda b: formatted(b, digits)), "; "))


def _side(box: Column, axis: int, sign: float) -> Column:
    return F.get(box, F.lit(axis)) + sign * F.get(box, F.lit(axis + 3)) / 2


def iou(a: Column, b: Column) -> Column:
    """Overlap of axis-aligned boxes over their union; 0 where they do not overlap or have no volume."""
    spans = [F.least(_side(a, i, 1), _side(b, i, 1)) - F.greatest(_side(a, i, -1), _side(b, i, -1)) for i in range(3)]
    inside = spans[0] * spans[1] * spans[2]
    volumes = [F.get(x, F.lit(3)) * F.get(x, F.lit(4)) * F.get(x, F.lit(5)) for x in (a, b)]
    union = volumes[0] + volumes[1] - inside
    return F.when((F.least(*spans) <= 0) | (union <= 0), 0.0).otherwise(inside / F.nullif(union, F.lit(0.0)))


def rotation(r1: Column, r2: Column, r3: Column) -> list[Column]:
    """Rz(r1) Rx(r2) Ry(r3), nine entries by row."""
    c1, s1, c2, s2, c3, s3 = F.cos(r1), F.sin(r1), F.cos(r2), F.sin(r2), F.cos(r3), F.sin(r3)
    return [c1 * c3 - s1 * s2 * s3, -s1 * c2, c1 * s3 + s1 * s2 * c3, s1 * c3 + c1 * s2 * s3, c1 * c2, s1 * s3 - c1 * s2 * c3, -c2 * s3, s2, c2 * c3]


def aligned(box: Column) -> Column:
    """The axis-aligned box around an oriented one: half extents are |R| times its own."""
    v = [F.get(box, F.lit(i)) for i in range(9)]
    r = rotation(*v[6:])
    sizes = [sum((F.abs(r[3 * i + j]) * v[3 + j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    return F.array(*v[:3], *sizes)


def oriented_iou(a: Column, b: Column) -> Column:
    return iou(aligned(a), aligned(b))


def corners(box: Column) -> Column:
    """The eight corners of an oriented box."""
    v = [F.get(box, F.lit(i)) for i in range(9)]
    r = rotation(*v[6:])
    made = []
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            for sz in (-0.5, 0.5):
                d = (sx * v[3], sy * v[4], sz * v[5])
                made.append(F.array(*[v[i] + sum((r[3 * i + j] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)]))
    return F.array(*made)


def turned(box: Column, inflation: float = 0.0) -> list[Column]:
    """Centre, rotation by row and half sides, inflated, of an oriented box: what a test of a point needs of it."""
    v = [F.get(box, F.lit(i)) for i in range(9)]
    return [*v[:3], *rotation(*v[6:]), *[v[3 + j] / 2 + inflation for j in range(3)]]


def holds_turned(t: Column, x: Column, y: Column, z: Column) -> Column:
    """Whether a box, given as an array of what ``turned`` makes of it, holds a point (its faces included)."""
    v = [F.get(t, F.lit(i)) for i in range(15)]
    d = (x - v[0], y - v[1], z - v[2])
    inside = F.lit(True)
    for j in range(3):
        own = v[3 + j] * d[0] + v[6 + j] * d[1] + v[9 + j] * d[2]
        inside = inside & (F.abs(own) <= v[12 + j])
    return inside


def holds(box: Column, x: Column, y: Column, z: Column, inflation: float = 0.0) -> Column:
    """Whether an oriented box, inflated on every side, holds a point (its faces included)."""
    return holds_turned(F.array(*turned(box, inflation)), x, y, z)


#: Points of a leaf, and pairs of a box and a point that are looked at together.
LEAF, TOGETHER = 128, 1 << 15


def held(points: np.ndarray, weights: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The weight of the points (n x 3) that each of the boxes (m x 15, as ``turned``) holds, as ``holds_turned`` has it.

    Points are halved along their widest axis down to leaves; boxes go down from the root together, and only those that
    a node's sides cut go on, so a box looks at the points near its faces alone. Nodes are judged with room for rounding.
    """
    out = np.zeros(len(boxes), np.int64)
    c, r, h = boxes[:, :3], boxes[:, 3:12].reshape(-1, 3, 3), boxes[:, 12:]
    odd, single = np.isnan(h), bool((weights == 1).all())
    some = odd.any()

    def tested(at: np.ndarray, p: np.ndarray, w: np.ndarray) -> None:
        step = max(1, TOGETHER // max(1, len(p)))
        for low in range(0, len(at), step):
            k = at[low : low + step]
            d = [p[:, i] - c[k, i, None] for i in range(3)]
            inside = np.ones((len(k), len(p)), bool)
            for j in range(3):
                own = r[k, 0, j, None] * d[0]
                own += r[k, 1, j, None] * d[1]
                own += r[k, 2, j, None] * d[2]
                within = np.abs(own, out=own) <= h[k, j, None]
                inside &= within | odd[k, j, None] if some else within  # Spark's NaN is at most NaN
            out[k] += np.count_nonzero(inside, axis=1) if single else inside @ w

    with np.errstate(all="ignore"):
        finite = np.isfinite(points).all(axis=1)
        tested(np.flatnonzero(~np.isfinite(h).all(axis=1)), points[~finite], weights[~finite])
        todo = [(points[finite], weights[finite], np.arange(len(boxes)))]
        while todo:
            p, w, at = todo.pop()
            if not len(p) or not len(at):
                continue
            low, high = p.min(axis=0), p.max(axis=0)
            middle, half = low / 2 + high / 2, high / 2 - low / 2
            own = np.abs(np.einsum("bij,bi->bj", r[at], middle - c[at]))
            reach = np.einsum("bij,i->bj", np.abs(r[at]), half)
            slack = 1e-12 * (np.abs(middle).sum() + half.sum() + np.abs(c[at]).sum(axis=1, keepdims=True))
            inside = (own + reach <= h[at] - slack).all(axis=1)
            outside = (own - reach > h[at] + slack).any(axis=1)
            out[at[inside]] += w.sum()
            at = at[~inside & ~outside]
            if len(p) <= LEAF or not (high > low).any():
                tested(at, p, w)
                continue
            order = np.argpartition(p[:, (high - low).argmax()], len(p) // 2)
            for part in (order[: len(p) // 2], order[len(p) // 2 :]):
                todo.append((p[part], w[part], at))
    return out


def centre_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((F.get(a, F.lit(i)) - F.get(b, F.lit(i))) ** 2 for i in range(3)), F.lit(0.0)))


def panoramic(box: Column) -> Column:
    """(u, v, depth, sizes) of a centred box: bins half-even rounded, u wraps, v is clamped."""
    x, y, z = F.get(box, F.lit(0)), -F.get(box, F.lit(2)), F.get(box, F.lit(1))
    lon = F.atan2(x, z)
    lat = F.atan2(y, F.greatest(F.sqrt(x * x + z * z), F.lit(1e-8)))
    u = F.pmod(F.bround((lon + math.pi) / (2 * math.pi) * BINS).cast("int"), F.lit(BINS))
    v = F.greatest(F.lit(0), F.least(F.bround((math.pi / 2 + lat) / math.pi * BINS).cast("int"), F.lit(BINS - 1)))
    depth = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(0.1))
    return F.struct(u.alias("u"), v.alias("v"), depth.alias("depth"), *[F.get(box, F.lit(3 + i)).alias(f"s{i}") for i in range(3)])


def from_panoramic(u: Column, v: Column, depth: Column) -> tuple[Column, Column, Column]:
    """The centre at the middle of a bin."""
    lon = (u + 0.5) / BINS * 2 * math.pi - math.pi
    lat = (v + 0.5) / BINS * math.pi - math.pi / 2
    across = depth * F.cos(lat)
    return across * F.sin(lon), across * F.cos(lon), -depth * F.sin(lat)


def recentred(box: Column, ox: Column, oy: Column, oz: Column, yaw: Column) -> Column:
    """A box from another origin and heading; its sides become those around the turned box."""
    v = [F.get(box, F.lit(i)) for i in range(6)]
    c, s = F.cos(yaw), F.sin(yaw)
    x, y = v[0] - ox, v[1] - oy
    return F.array(c * x - s * y, s * x + c * y, v[2] - oz, F.abs(c) * v[3] + F.abs(s) * v[4], F.abs(s) * v[3] + F.abs(c) * v[4], v[5])


def nearest_first(boxes: Column) -> Column:
    """Boxes by distance of the centre from the origin, equal ones as they were."""
    square = lambda b: sum((F.get(b, F.lit(i)) * F.get(b, F.lit(i)) for i in range(3)), F.lit(0.0))
    return F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(square(b).alias("d"), i.alias("i"), b.alias("b")))), lambda x: x["b"])


# --- what goes step by step


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.maximum(a[:, None, :3] - a[:, None, 3:6] / 2, b[None, :, :3] - b[None, :, 3:6] / 2)
    high = np.minimum(a[:, None, :3] + a[:, None, 3:6] / 2, b[None, :, :3] + b[None, :, 3:6] / 2)
    span = high - low
    inside = np.where((span > 0).all(-1), span.prod(-1), 0.0)
    union = a[:, 3:6].prod(-1)[:, None] + b[:, 3:6].prod(-1)[None] - inside
    return np.where(union > 0, inside / np.where(union > 0, union, 1), 0.0)


def _f1(pred, truth, threshold: float) -> float:
    if len(pred) == 0 or len(truth) == 0:
        return float(len(pred) == len(truth))
    overlap = _iou(np.array([list(p) for p in pred], float), np.array([list(t) for t in truth], float))
    free, hits = np.ones(len(truth), bool), 0
    for row in np.argsort(-overlap.max(1), kind="stable"):
        if free.any():
            best = int(np.where(free, overlap[row], -1).argmax())
            if overlap[row, best] >= threshold:
                free[best] = False
                hits += 1
    return 2 * hits / (len(pred) + len(truth))


def greedy_f1(threshold: float):
    """Arrow function of two columns of box lists: F1 when each prediction, best overlap first, takes its best free truth."""

    @F.pandas_udf("double")
    def run(pred: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([_f1(p, t, threshold) for p, t in zip(pred, truth, strict=True)])

    return run


def surface_points(box: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """``budget`` points on an oriented box: its corners first, the rest spread over the faces by area."""
    half, (r1, r2, r3) = box[3:6] / 2, box[6:9]
    c1, s1, c2, s2, c3, s3 = (f(r) for r in (r1, r2, r3) for f in (math.cos, math.sin))
    turn = np.array([[c1 * c3 - s1 * s2 * s3, -s1 * c2, c1 * s3 + s1 * s2 * c3], [s1 * c3 + c1 * s2 * s3, c1 * c2, s1 * s3 - c1 * s2 * c3], [-c2 * s3, s2, c2 * c3]])
    signs = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
    more = max(0, budget - 8)
    rng = np.random.default_rng(seed)
    areas = np.array([half[1] * half[2], half[0] * half[2], half[0] * half[1]])
    axis = rng.choice(3, more, p=areas / areas.sum() if areas.sum() > 0 else None)
    local = rng.uniform(-1, 1, (more, 3))
    local[np.arange(more), axis] = rng.choice((-1.0, 1.0), more)
    return np.concatenate([signs, local]) * half @ turn.T + box[:3]


def surface_distance(budget: int = 100):
    """Arrow function of two columns of oriented boxes: least distance between points of their surfaces."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                p, q = surface_points(np.asarray(x, float), budget, 1), surface_points(np.asarray(y, float), budget, 2)
                out.append(float(np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1).min())))
            yield pd.Series(out, dtype=float)

    return run


def _frames(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, half sides and rotations (n, 3, 3) of oriented boxes (n, 9)."""
    c1, s1, c2, s2, c3, s3 = (f(boxes[:, 6 + k]) for k in range(3) for f in (np.cos, np.sin))
    turn = np.stack([c1 * c3 - s1 * s2 * s3, -s1 * c2, c1 * s3 + s1 * s2 * c3, s1 * c3 + c1 * s2 * s3, c1 * c2, s1 * s3 - c1 * s2 * c3, -c2 * s3, s2, c2 * c3], axis=1)
    return boxes[:, :3], np.abs(boxes[:, 3:6]) / 2, turn.reshape(-1, 3, 3)


_SIGNS = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
_EDGES = np.array([(i, j) for i in range(8) for j in range(i + 1, 8) if np.abs(_SIGNS[i] - _SIGNS[j]).sum() == 2])


def _segments_apart(p: np.ndarray, u: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least distance of the segments from p along u and from q along v."""
    w = p - q
    a, b, c, d, e = ((x * y).sum(-1) for x, y in ((u, u), (u, v), (v, v), (u, w), (v, w)))
    bent = a * c - b * b
    safe = lambda x: np.where(x > 0, x, 1.0)
    s = np.where(bent > 1e-12 * a * c, np.clip((b * e - c * d) / safe(bent), 0, 1), 0.0)
    t = np.where(c > 0, np.clip((b * s + e) / safe(c), 0, 1), 0.0)
    s = np.where(a > 0, np.clip((b * t - d) / safe(a), 0, 1), 0.0)  # the best s for this t; t stays the best for it
    t = np.where(c > 0, np.clip((b * s + e) / safe(c), 0, 1), 0.0)
    gap = w + s[..., None] * u - t[..., None] * v
    return np.sqrt((gap * gap).sum(-1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact distance of the surfaces of oriented boxes (n, 9), 0 where they meet.

    Apart, boxes are nearest at a corner of one and a face of the other or at two edges; they are apart where one of
    the fifteen axes of their faces and edges separates them.
    """
    (ca, ha, ra), (cb, hb, rb) = _frames(a), _frames(b)
    corners = [c[:, None] + (_SIGNS * h[:, None]) @ r.transpose(0, 2, 1) for c, h, r in ((ca, ha, ra), (cb, hb, rb))]
    best = np.full(len(a), np.inf)
    for points, (c, h, r) in ((corners[0], (cb, hb, rb)), (corners[1], (ca, ha, ra))):
        over = np.maximum(np.abs((points - c[:, None]) @ r) - h[:, None], 0)
        best = np.minimum(best, np.sqrt((over * over).sum(-1)).min(1))
    p, q = (k[:, _EDGES[:, 0]] for k in corners)
    u, v = (k[:, _EDGES[:, 1]] - k[:, _EDGES[:, 0]] for k in corners)
    best = np.minimum(best, _segments_apart(p[:, :, None], u[:, :, None], q[:, None], v[:, None]).min((1, 2)))
    axes = np.concatenate([ra, rb, np.cross(ra.transpose(0, 2, 1)[:, :, None], rb.transpose(0, 2, 1)[:, None]).reshape(-1, 9, 3).transpose(0, 2, 1)], axis=2)
    reach = sum((np.abs(np.einsum("nij,nik->njk", r, axes)) * h[:, :, None]).sum(1) for r, h in ((ra, ha), (rb, hb)))
    apart = (np.abs(np.einsum("ni,nik->nk", cb - ca, axes)) > reach).any(1)
    return np.where(apart, best, 0.0)


def box_distance(rows: int = 2048):
    """Arrow function of two columns of oriented boxes: the exact distance of their surfaces, 0 where they meet.

    Null where a box is null or has an entry that is null or not finite.
    """

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        flat = lambda x: np.array([v if v is not None and len(v) == 9 else [np.nan] * 9 for v in x], float).reshape(-1, 9)
        p, q = flat(a), flat(b)
        ok = np.isfinite(p).all(1) & np.isfinite(q).all(1)
        out = np.full(len(p), np.nan)
        at = np.flatnonzero(ok)
        for low in range(0, len(at), rows):
            part = at[low : low + rows]
            out[part] = distances(p[part], q[part])
        return pd.Series(np.where(np.isnan(out), None, out), dtype=object)

    return run


#: A point within a text (fixed value): three plain decimals in brackets.
POINT = re.compile(r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]")


def points_moved():
    """Arrow function (text, x, y, z, yaw): points of a text seen from a centre and turned about z, with two decimals.

    Decimals round as Python prints them, which no built-in function does. A null text stays; so does a text whose
    centre or yaw is null.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, cx: pd.Series, cy: pd.Series, cz: pd.Series, yaw: pd.Series) -> pd.Series:
        out = []
        for text, *move in zip(texts, cx, cy, cz, yaw, strict=True):
            if text is None or any(pd.isna(v) for v in move):
                out.append(text)
                continue
            *centre, angle = move
            c, s = math.cos(angle), math.sin(angle)

            def moved(found: re.Match) -> str:
                x, y, z = (float(g) - o for g, o in zip(found.groups(), centre, strict=True))
                return f"[{c * x - s * y:.2f}, {s * x + c * y:.2f}, {z:.2f}]"

            out.append(POINT.sub(moved, text))
        return pd.Series(out, dtype=object)

    return run


def hull_corners():
    """Arrow function: corners of the convex hull of points on the plane, all of them where they span none."""

    @F.pandas_udf("array<struct<x:double,z:double>>")
    def run(xs: pd.Series, zs: pd.Series) -> pd.Series:
        out = []
        for x, z in zip(xs, zs, strict=True):
            flat = sorted(set(zip(map(float, x), map(float, z), strict=True)))
            out.append([{"x": a, "z": b} for a, b in (_hull(flat) if len(flat) > 2 else flat)])
        return pd.Series(out, dtype=object)

    return run


def footprint_area():
    """Arrow function: area of the convex hull of points on the plane, null where it is none."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, zs: pd.Series) -> pd.Series:
        return pd.Series([_hull_area(sorted(set(zip(map(float, x), map(float, z), strict=True)))) for x, z in zip(xs, zs, strict=True)], dtype=object)

    return run


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull of sorted points, once around."""

    def chain(side: list[tuple[float, float]]) -> list[tuple[float, float]]:
        hull: list[tuple[float, float]] = []
        for p in side:
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]) <= 0:
                hull.pop()
            hull.append(p)
        return hull[:-1]

    return chain(points) + chain(points[::-1])


def _hull_area(points: list[tuple[float, float]]) -> float | None:
    if len(points) < 3:
        return None
    ring = _hull(points)
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    return area if area > 0 else None
