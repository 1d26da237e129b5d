"""Scenes on disk: frames with their pose, depth file, intrinsics and alignment, joined by stem across listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.geometry import finite
from orrery.sources.readers import listing

#: Names in a scene's parameter file.
INTRINSICS = {"fx": "fx_color", "fy": "fy_color", "cx": "mx_color", "cy": "my_color"}
SIZE, ALIGNMENT = ("colorWidth", "colorHeight"), "axisAlignment"
#: Why a frame is left out, the first that holds.
REASONS = ("no_intrinsics", "bad_intrinsics", "no_pose", "bad_pose", "no_depth")


def _decimals(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width and height of PNG files, from their headers; other files have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.where(is_png).select("path", number(17).alias("width"), number(21).alias("height"))


def scene_frames(spark: SparkSession, root: str, images: str = "color", sizes: DataFrame | None = None) -> DataFrame:
    """One row for each image ``<root>/<scene>/<images>/<stem>.*``, whole or with the reason why it cannot be used.

    (scene_id, stem, image, depth, pose, fx, fy, cx, cy, alignment, reason). A pose comes from ``pose/<stem>.txt``, a depth
    file's path from ``depth/<stem>.*``, intrinsics and alignment from ``<scene>/<scene>.txt`` (``key = value`` lines).
    With ``sizes`` (path, width, height) intrinsics of a file that names its own size are scaled to the image's. Reasons, in
    order: no_intrinsics, bad_intrinsics (one is missing or no number), no_pose, bad_pose (not sixteen finite numbers),
    no_depth. Of several images of a stem the first path counts. Only listings and small text files are read.
    """
    found = listing(spark, root).withColumn("scene_id", F.element_at(F.split("path", "/"), -3))
    first = lambda folder, name: found.where(F.col("folder") == folder).groupBy("scene_id", "stem").agg(F.min("path").alias(name))
    frames = first(images, "image").join(first("depth", "depth"), ["scene_id", "stem"], "left")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    text = text.withColumns({"folder": F.element_at(F.split("path", "/"), -2), "stem": F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")})
    poses = text.where("folder = 'pose'").select(F.element_at(F.split("path", "/"), -3).alias("scene_id"), "stem", _decimals(F.col("value")).alias("__pose"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.reverse(F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("key"), F.trim(F.split(x, "=", 2)[1]).alias("value"))))
    params = text.where("folder = stem").select(F.col("folder").alias("scene_id"), pairs.alias("__p"))
    both = frames.join(poses, ["scene_id", "stem"], "left").join(params, "scene_id", "left")
    said = lambda name: F.get(F.filter("__p", lambda x: x["key"] == name), F.lit(0))["value"]  # noqa: E731  the last of a name that is given twice
    number = lambda name: said(name).try_cast("double")
    scale = {"x": F.lit(1.0), "y": F.lit(1.0)}
    if sizes is not None:
        both = both.join(sizes.select(F.col("path").alias("__path"), "width", "height"), F.col("image") == F.col("__path"), "left").drop("__path")
        scale = {a: F.coalesce(F.col(n) / F.nullif(number(own), F.lit(0.0)), F.lit(1.0)) for a, n, own in (("x", "width", SIZE[0]), ("y", "height", SIZE[1]))}
    made = both.withColumns({c: number(name) * scale[c[1]] for c, name in INTRINSICS.items()})
    aligned = _decimals(said(ALIGNMENT))
    sound = F.coalesce(finite(F.col("__pose")), F.lit(False))
    known = F.lit(True)
    for c in INTRINSICS:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    reason = F.when(F.col("__p").isNull(), REASONS[0]).when(~known, REASONS[1]).when(F.col("__pose").isNull(), REASONS[2]).when(~sound, REASONS[3]).when(F.col("depth").isNull(), REASONS[4])
    return made.select("scene_id", "stem", "image", "depth", F.when(sound, F.col("__pose")).alias("pose"), *INTRINSICS, F.when(F.coalesce(finite(aligned), F.lit(False)), aligned).alias("alignment"), reason.alias("reason"))


def scene_audit(frames: DataFrame) -> DataFrame:
    """A row for each scene: how many frames it has, how many are whole, how many are left out for each reason."""
    return frames.groupBy("scene_id").agg(F.count("*").alias("frames"), F.count_if(F.col("reason").isNull()).alias("whole"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
