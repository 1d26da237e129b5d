"""Camera and panorama geometry as Columns; matrices are arrays of 16 doubles, row by row, camera to world."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR, FAR = 0.1, 50.0


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def at(matrix: Column, row: int, col: int) -> Column:
    return F.get(matrix, F.lit(4 * row + col))


def finite(values: Column) -> Column:
    """All 16 values there and finite."""
    return (F.size(values) == 16) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def in_band(z: Column, near: float = NEAR, far: float = FAR) -> Column:
    """Depth in metres inside the open band and not NaN."""
    return ~F.isnan(z) & (z > near) & (z < far)


def unprojected(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    return (u - _num(cx)) * z / _num(fx), (v - _num(cy)) * z / _num(fy), z


def transformed(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(at(matrix, r, 0) * x + at(matrix, r, 1) * y + at(matrix, r, 2) * z + at(matrix, r, 3) for r in range(3))


def product(a: Column, b: Column) -> Column:
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)])


def inverse_applied(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """World point in the camera frame: the affine inverse by adjugate over determinant."""
    d = [c - at(matrix, r, 3) for r, c in enumerate((x, y, z))]
    m = [[at(matrix, r, c) for c in range(3)] for r in range(3)]

    def minor(i: int, j: int) -> Column:
        r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]

    det = m[0][0] * minor(0, 0) - m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    return tuple(sum(((-1.0) ** (i + j) * minor(j, i) * d[j] for j in range(3)), F.lit(0.0)) / det for i in range(3))


def turned(x: Column, y: Column, yaw: Column) -> tuple[Column, Column]:
    return F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and distance on the canvas (x, -z, y); a point straight behind lies at +pi."""
    across = F.sqrt(x * x + y * y)
    return F.atan2(x, y), F.atan2(-z, F.greatest(across, F.lit(1e-8))), F.sqrt(x * x + y * y + z * z)


def equirect_bin(lon: Column, lat: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    """Pixel column, row and flat index of a direction; truncated, the last pixel clamped."""
    u = F.least(((lon + math.pi) / (2 * math.pi) * width).cast("int"), F.lit(width - 1))
    v = F.least(F.greatest(((lat + math.pi / 2) / math.pi * height).cast("int"), F.lit(0)), F.lit(height - 1))
    return u, v, v * width + u


def direction(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a canvas direction."""
    return F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)


def projected(x: Column, y: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column]:
    depth = F.greatest(z, F.lit(1e-6))
    return _num(fx) * x / depth + _num(cx), _num(fy) * y / depth + _num(cy)


def in_frustum(u: Column, v: Column, z: Column, width, height) -> Column:
    return (z > 0) & (u >= 0) & (u < _num(width)) & (v >= 0) & (v < _num(height))


def segment_hits_box(p: tuple, q: tuple, low: tuple, high: tuple) -> Column:
    """Whether an open segment passes through a box; touching an end is no hit."""
    near, far = [], []
    for a, b, lo, hi in zip(p, q, low, high, strict=True):
        d = b - a
        flat, inside = F.abs(d) <= 1e-8, (a >= lo) & (a <= hi)
        t0, t1 = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        inf = float("inf")
        near.append(F.when(flat, F.when(inside, -inf).otherwise(inf)).otherwise(F.least(t0, t1)))
        far.append(F.when(flat, F.when(inside, inf).otherwise(-inf)).otherwise(F.greatest(t0, t1)))
    enter, leave = F.greatest(*near), F.least(*far)
    return (enter < leave) & (leave > 0) & (enter < 1)


def rodrigues(ax: Column, ay: Column, az: Column) -> list[Column]:
    """The nine entries of the rotation of an axis-angle vector."""
    angle = F.sqrt(ax * ax + ay * ay + az * az)
    unit = F.nullif(angle, F.lit(0.0))
    x, y, z = (F.coalesce(a / unit, F.lit(0.0)) for a in (ax, ay, az))
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c]


def camera_yaw(matrix: Column) -> Column:
    """Heading of the optical axis, in [-pi, pi)."""
    return F.pmod(F.atan2(at(matrix, 0, 2), at(matrix, 1, 2)) + math.pi, F.lit(2 * math.pi)) - math.pi


def agent_yaw(qz: Column, qw: Column) -> Column:
    return -math.pi / 2 - 2 * F.atan2(qz, qw)


def resized_intrinsics(fx, fy, cx, cy, sx: Column, sy: Column) -> tuple[Column, ...]:
    return fx * sx, fy * sy, cx * sx, cy * sy


def rotated_intrinsics(fx, fy, cx, cy, width: Column, height: Column, quarter_turns: Column) -> Column:
    """Intrinsics after clockwise quarter turns; corner-origin pixels, so cx' = height - cy after one."""
    turn = F.pmod(quarter_turns, F.lit(4))

    def made(a, b, c, d, w, h) -> Column:
        return F.struct(a.alias("fx"), b.alias("fy"), c.alias("cx"), d.alias("cy"), w.alias("width"), h.alias("height"))

    return (
        F.when(turn == 0, made(fx, fy, cx, cy, width, height))
        .when(turn == 1, made(fy, fx, height - cy, cx, height, width))
        .when(turn == 2, made(fx, fy, width - cx, height - cy, width, height))
        .otherwise(made(fy, fx, cy, width - cx, height, width))
    )


def border(size: Column, ratio: Column) -> Column:
    """Pixels to crop at one side, half-even rounded, less than half the size."""
    return F.least(F.greatest(F.bround(size * ratio).cast("int"), F.lit(0)), ((size - 1) / 2).cast("int"))


def nearest_exact(i: Column, n_in: Column, n_out: Column) -> Column:
    """Source pixel at the centre of output pixel ``i``."""
    return F.floor((i + 0.5) * n_in / n_out).cast("int")


def fourier(x: Column, bands: int, top: float) -> Column:
    """x followed by sines and cosines at log-spaced frequencies up to ``top``."""
    freqs = [top ** (k / max(bands - 1, 1)) for k in range(bands)]
    waves = [f(x * q) for f in (F.sin, F.cos) for q in freqs]
    return F.array(x, *waves)


def position(lon: Column, lat: Column, index: Column, count: Column, span: float) -> tuple[Column, Column, Column]:
    """Time, row and column positions in [0, span] of a patch on the canvas."""
    t = index / F.greatest(count - 1, F.lit(1)) * span
    return t, (lat + math.pi / 2) / math.pi * span, (lon + math.pi) / (2 * math.pi) * span


def permuted(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """World axes to the canvas frame."""
    return x, -z, y


def unpermuted(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, z, -y


def rotation_from_yaw(yaw: Column) -> list[Column]:
    c, s, o, i = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    return [c, -s, o, s, c, o, o, o, i]


def upright_turns(theta: Column) -> Column:
    """Clockwise quarter turns that set a camera rolled by ``theta`` upright."""
    return F.pmod(F.bround(theta / (math.pi / 2)).cast("int"), F.lit(4))


def gravity_alignment(dx: Column, dy: Column, dz: Column) -> list[Column]:
    """Rotation that takes the unit vector (dx, dy, dz), the mean down, to (0, 0, -1)."""
    n = F.sqrt(dx * dx + dy * dy + dz * dz)
    x, y, z = dx / n, dy / n, dz / n
    ax, ay, c = -y, x, -z  # cross((x, y, z), (0, 0, -1)) and their cosine
    s2 = F.nullif(ax * ax + ay * ay, F.lit(0.0))
    k = F.coalesce((1 - c) / s2, F.lit(0.0))
    plain = [1 - k * ay * ay, k * ax * ay, ay, k * ax * ay, 1 - k * ax * ax, -ax, -ay, ax, 1 - k * (ax * ax + ay * ay)]
    flip = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    return [F.when(s2.isNull() & (c < 0), v).otherwise(p) for p, v in zip(plain, flip, strict=True)]


def frustum_points(matrix: Column, depth: float, fx, fy, cx, cy, width, height) -> Column:
    """The camera's centre and the world corners of its image plane at ``depth``."""
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    points = [F.array(at(matrix, 0, 3), at(matrix, 1, 3), at(matrix, 2, 3))]
    for u, v in corners:
        x, y, z = unprojected(_num(u) * _num(width), _num(v) * _num(height), F.lit(depth), fx, fy, cx, cy)
        points.append(F.array(*transformed(matrix, x, y, z)))
    return F.array(*points)
