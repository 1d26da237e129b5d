"""Readers for annotation, calibration, trajectory and binary sensor files; every row can keep the file it is from."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line, blank lines skipped; folders are read through, with the file's path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, wrapper: str | None = None) -> DataFrame:
    """Whole-file JSON: a list is its rows, an object one row; ``wrapper`` names a key that holds the list."""
    if wrapper:
        inner = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        outer = T.StructType([T.StructField(wrapper, T.ArrayType(inner))])
        return spark.read.schema(outer).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.inline(wrapper))
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def plain_list(spark: SparkSession, path: str) -> DataFrame:
    """An id a line; blank lines and # comments are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"))
    return lines.where((F.col("id") != "") & ~F.col("id").startswith("#"))


def scene_ids(spark: SparkSession, parquet: str | None = None, lines: str | None = None, documents: str | None = None) -> DataFrame:
    """Distinct scene ids of sources of three formats."""
    parts = []
    if parquet:
        parts.append(spark.read.parquet(parquet).select(F.col("scene_name").cast("string").alias("scene_id")))
    if lines:
        parts.append(spark.read.schema("scene_id string").json(lines).select("scene_id"))
    if documents:
        parts.append(json_documents(spark, documents, "scene_id string").select("scene_id"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where("scene_id IS NOT NULL").distinct()


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """file and a map of the ``key = value`` lines; the last of a repeated key counts."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\\r?\\n").alias("lines"))
    pairs = F.transform(F.filter("lines", lambda x: x.contains("=")), lambda x: F.split(x, "=", 2))
    flat = lines.select("file", F.posexplode(pairs).alias("pos", "kv")).select("file", "pos", F.trim(F.get("kv", F.lit(0))).alias("k"), F.trim(F.get("kv", F.lit(1))).alias("v"))
    return flat.groupBy("file", "k").agg(F.max_by("v", "pos").alias("v")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))


def _numbers(column: str):
    return F.transform(F.filter(F.split(F.col(column), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def _stem():
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """stem and 16 numbers of each file; files of another shape or with numbers that are not finite are left out."""
    from orrery.functions.geometry import finite

    rows = spark.read.text(path, wholetext=True).select(_stem().alias("stem"), _numbers("value").alias("pose"))
    return rows.where(finite(F.col("pose")))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """ts, axis-angle and translation of the lines that have seven numbers."""
    rows = spark.read.text(path).select(_stem().alias("scene_id"), _numbers("value").alias("n"))
    rows = rows.where((F.size("n") == 7) & F.forall("n", lambda v: v.isNotNull()))
    return rows.select("scene_id", *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("ts", "ax", "ay", "az", "tx", "ty", "tz"))])


def pincams(spark: SparkSession, path: str) -> DataFrame:
    """Intrinsics of one file a frame; the stem's last part is its time."""
    rows = spark.read.text(path, wholetext=True).select(_stem().alias("stem"), _numbers("value").alias("n")).where(F.size("n") >= 6)
    named = [F.get("n", F.lit(i)).alias(c) for i, c in enumerate(("width", "height", "fx", "fy", "cx", "cy"))]
    return rows.select("stem", F.element_at(F.split("stem", "_"), -1).try_cast("double").alias("ts"), *named)


def frame_poses(spark: SparkSession, path: str) -> DataFrame:
    """Frames of files that map a frame's name to its pose and intrinsics."""
    body = spark.read.text(path, wholetext=True).select(_stem().alias("scene_id"), F.from_json("value", "map<string, struct<pose: array<array<double>>, intrinsic: array<array<double>>>>").alias("m"))
    return body.select("scene_id", F.explode("m").alias("frame", "f")).select("scene_id", "frame", F.flatten("f.pose").alias("pose"), F.flatten("f.intrinsic").alias("intrinsic"))


def transforms(spark: SparkSession, path: str) -> DataFrame:
    """Frames of transform files, both lists of them."""
    frame = "array<struct<file_path: string, transform_matrix: array<array<double>>>>"
    body = spark.read.text(path, wholetext=True).select(_stem().alias("scene_id"), F.from_json("value", f"frames {frame}, test_frames {frame}").alias("j"))
    parts = [body.select("scene_id", F.lit(kind).alias("split"), F.inline(f"j.{kind}")) for kind in ("frames", "test_frames")]
    return parts[0].unionByName(parts[1]).select("scene_id", "split", "file_path", F.flatten("transform_matrix").alias("pose"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths, names, stems and sizes of all files below ``path``, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.element_at(F.split("path", "/"), -2).alias("folder"), "length")


def common_stems(*listings: DataFrame) -> DataFrame:
    """Stems that every listing has."""
    out = listings[0].select("stem").distinct()
    for other in listings[1:]:
        out = out.join(other.select("stem").distinct(), "stem", "left_semi")
    return out


def inline_frames(rows: DataFrame) -> DataFrame:
    """Frames that travel in annotations: one row each, with the place in its item."""
    return rows.select("question_id", F.posexplode("frames").alias("frame_idx", "f")).select("question_id", "frame_idx", "f.*")


# --- binary files


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def boxes_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, object_id (the row) and box of arrays of six numbers or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"path": path_, "object_id": np.arange(len(a)), "box": [row[:6].astype(float).tolist() for row in a]})

    return _binary(spark, path).mapInPandas(run, "path string, object_id long, box array<double>")


def ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    """path, vertex and x, y, z of binary little-endian files whose vertices take 16 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                head, _, body = content.partition(b"end_header\n")
                n = int(next(line.split()[2] for line in head.splitlines() if line.startswith(b"element vertex")))
                v = np.frombuffer(body, np.dtype([("p", "<f4", 3), ("c", "u1", 4)]), n)["p"].astype(float)
                yield pd.DataFrame({"path": path_, "vertex": np.arange(n), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    return _binary(spark, path).mapInPandas(run, "path string, vertex long, x double, y double, z double")


def length_prefixed(spark: SparkSession, path: str) -> DataFrame:
    """path, frame and payload of files of length-prefixed (little-endian, 32 bits) frames; a cut file is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                at, frames = 0, []
                while at < len(content):
                    if at + 4 > len(content) or at + 4 + (size := struct.unpack_from("<I", content, at)[0]) > len(content):
                        raise ValueError(f"{path_} ends inside a frame")
                    frames.append(content[at + 4 : at + 4 + size])
                    at += 4 + size
                yield pd.DataFrame({"path": path_, "frame": np.arange(len(frames)), "payload": frames})

    return _binary(spark, path).mapInPandas(run, "path string, frame long, payload binary")


def sensor_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, pose, times and colour and depth payloads of sensor streams, version 4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, data in zip(pdf["path"], pdf["content"], strict=True):
                version, n = struct.unpack_from("<IQ", data, 0)
                if version != 4:
                    raise ValueError(f"{path_} is of version {version}")
                at = 12 + n + 4 * 16 * 4  # the name, then intrinsics and extrinsics of both cameras
                at += 4 + 4 + 4 * 4 + 4  # compressions, sizes, depth shift
                (count,) = struct.unpack_from("<Q", data, at)
                at += 8
                rows = []
                for k in range(count):
                    pose = struct.unpack_from("<16f", data, at)
                    t_colour, t_depth, n_colour, n_depth = struct.unpack_from("<4Q", data, at + 64)
                    at += 96
                    rows.append((path_, k, [float(p) for p in pose], t_colour, t_depth, data[at : at + n_colour], data[at + n_colour : at + n_colour + n_depth]))
                    at += n_colour + n_depth
                yield pd.DataFrame(rows, columns=["path", "frame", "pose", "colour_ts", "depth_ts", "colour", "depth"])

    return _binary(spark, path).mapInPandas(run, "path string, frame long, pose array<double>, colour_ts long, depth_ts long, colour binary, depth binary")
