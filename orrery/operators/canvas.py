"""The panoramic canvas: patches of posed depth frames as directions and distances around a scene's centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import geometry
from orrery.operators.reports import lower_median


def centres(frames: DataFrame) -> DataFrame:
    """Mean translation of a scene's finite poses, the origin if it has none."""
    ok = geometry.finite(F.col("pose"))
    mean = lambda i: F.coalesce(F.avg(F.when(ok, F.get("pose", F.lit(i)))), F.lit(0.0))
    return frames.groupBy("scene_id").agg(mean(3).alias("ox"), mean(7).alias("oy"), mean(11).alias("oz"))


def patches(frames: DataFrame, depth: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row for each cell of a frame's grid with the depth (mm) of the pixel at its centre.

    ``frames`` (scene_id, frame_idx, pose, fx, fy, cx, cy, width, height), ``depth`` (scene_id, frame_idx, row, col,
    depth_mm, and the depth map's height and width as dh, dw).
    """
    grid = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("prow")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("pcol"))
    sizes = depth.groupBy("scene_id", "frame_idx").agg(F.max("dh").alias("dh"), F.max("dw").alias("dw"))
    grid = grid.join(sizes, ["scene_id", "frame_idx"], "left")
    grid = grid.withColumns({"row": geometry.nearest_exact(F.col("prow"), F.col("dh"), F.lit(rows)), "col": geometry.nearest_exact(F.col("pcol"), F.col("dw"), F.lit(cols))})
    found = grid.join(depth.select("scene_id", "frame_idx", "row", "col", "depth_mm"), ["scene_id", "frame_idx", "row", "col"], "left")
    return found.drop("row", "col", "dh", "dw")


def coarsened(cells: DataFrame, k: int) -> DataFrame:
    """Depths replaced by the lower median of the valid ones of their k × k block; invalid cells stay as they are."""
    if k <= 1:
        return cells
    valid = geometry.in_band(F.col("depth_mm") / 1000)
    block = Window.partitionBy("scene_id", "frame_idx", F.floor(F.col("prow") / k), F.floor(F.col("pcol") / k))
    middle = lower_median(F.collect_list(F.when(valid, F.col("depth_mm").cast("double"))).over(block))
    return cells.withColumn("depth_mm", F.when(valid, middle).otherwise(F.col("depth_mm")))


def scene_geometry(cells: DataFrame, origins: DataFrame, rows: int, cols: int, yaw: Column | float = 0.0) -> DataFrame:
    """scene_id, frame_idx, valid_index, lon, lat, depth, idx of the valid cells, idx in frame, row, column order.

    Cells are numbered within their frame and frames by their counts, so no task sorts a scene's cells.
    """
    angle = yaw if isinstance(yaw, Column) else F.lit(float(yaw))
    sx, sy = cols / F.col("width"), rows / F.col("height")
    z = F.col("depth_mm") / 1000.0
    fx, fy, cx, cy = geometry.resized_intrinsics(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), sx, sy)
    local = geometry.unprojected(F.col("pcol") + 0.5, F.col("prow") + 0.5, z, fx, fy, cx, cy)
    c = cells.join(origins, "scene_id").where(geometry.in_band(z) & geometry.finite(F.col("pose")))
    c = c.withColumns(dict(zip(("lx", "ly", "lz"), local, strict=True)))
    c = c.withColumns(dict(zip(("wx", "wy", "wz"), geometry.transformed(F.col("pose"), F.col("lx"), F.col("ly"), F.col("lz")), strict=True)))
    x, y = geometry.turned(F.col("wx") - F.col("ox"), F.col("wy") - F.col("oy"), angle)
    c = c.withColumns({"x": x, "y": y, "z": F.col("wz") - F.col("oz")})
    lon, lat, far = geometry.spherical(F.col("x"), F.col("y"), F.col("z"))
    c = c.withColumns({"lon": lon, "lat": lat, "depth": F.greatest(far, F.lit(0.01))})
    c = c.withColumn("valid_index", (F.col("frame_idx") * rows + F.col("prow")) * cols + F.col("pcol"))
    frames = c.groupBy("scene_id", "frame_idx").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("scene_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1))
    frames = frames.select(F.col("scene_id").alias("__scene"), F.col("frame_idx").alias("__frame"), F.coalesce(before, F.lit(0)).alias("__before"))
    c = c.join(frames, F.col("scene_id").eqNullSafe(F.col("__scene")) & F.col("frame_idx").eqNullSafe(F.col("__frame")))
    idx = F.col("__before") + F.row_number().over(Window.partitionBy("scene_id", "frame_idx").orderBy("valid_index")) - 1
    return c.select("scene_id", "frame_idx", "valid_index", "lon", "lat", "depth", "x", "y", "z", idx.alias("idx"))


def with_features(geometry_rows: DataFrame, features: DataFrame) -> DataFrame:
    """Cells with their feature vectors (scene_id, valid_index, features)."""
    return geometry_rows.join(features, ["scene_id", "valid_index"])


def supported(points: DataFrame, key: list[str], least_patches: int, least_frames: int) -> DataFrame:
    """Keys with enough patches from enough frames."""
    n = points.groupBy(*key).agg(F.count("*").alias("patches"), F.countDistinct("frame_idx").alias("frames"))
    return n.where((F.col("patches") >= least_patches) & (F.col("frames") >= least_frames))
