"""Readers and sinks on small files written here."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import annotations, joins
from orrery.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_json(spark, tmp_path):
    put(tmp_path / "a/x.jsonl", '{"scene_id": "s1"}\n\n{"scene_id": "s2"}\n')
    put(tmp_path / "a/b/y.jsonl", '{"scene_id": "s3"}\n')
    got = readers.json_lines(spark, str(tmp_path / "a"), "scene_id string").where("scene_id IS NOT NULL")
    assert {r.scene_id for r in got.collect()} == {"s1", "s2", "s3"} and all(r.file for r in got.collect())
    put(tmp_path / "l/x.json", json.dumps([{"scene_id": "s1"}, {"scene_id": "s2"}]))
    assert readers.json_documents(spark, str(tmp_path / "l"), "scene_id string").count() == 2
    put(tmp_path / "w/x.json", json.dumps({"questions": [{"scene_id": "s1"}, {"scene_id": "s4"}]}))
    assert {r.scene_id for r in readers.json_documents(spark, str(tmp_path / "w"), "scene_id string", "questions").collect()} == {"s1", "s4"}
    put(tmp_path / "g/x.json.gz", gzip.compress(b'{"scene_id": "z"}\n'))
    assert readers.json_lines(spark, str(tmp_path / "g"), "scene_id string").first().scene_id == "z"


def test_lists_and_ids(spark, tmp_path):
    ids = readers.plain_list(spark, put(tmp_path / "ids.txt", "# old\nscene1\n\n scene2 \n"))
    assert {r.id for r in ids.collect()} == {"scene1", "scene2"}
    spark.createDataFrame([("p1",), ("p1",)], "scene_name string").write.parquet(str(tmp_path / "p"))
    lines = put(tmp_path / "x.jsonl", '{"scene_id": "j1"}\n')
    docs = put(tmp_path / "d/x.json", '[{"scene_id": "j1"}, {"scene_id": "d1"}]')
    assert {r.scene_id for r in readers.scene_ids(spark, str(tmp_path / "p"), lines, docs).collect()} == {"p1", "j1", "d1"}
    assert readers.csv(spark, put(tmp_path / "r.csv", "scan_id,target_id,utterance\ns,3,the chair\n"), "scan_id string, target_id int, utterance string").first().target_id == 3


def test_calibration(spark, tmp_path):
    kv = readers.key_values(spark, put(tmp_path / "scene.txt", "fx_depth = 577.5\naxisAlignment = 1 0 0\nfx_depth = 578\nnote\n")).first()
    assert kv["values"] == {"fx_depth": "578", "axisAlignment": "1 0 0"}
    put(tmp_path / "pose/0.txt", "1 0 0 0\n0 1 0 0\n0 0 1 2.5\n0 0 0 1\n")
    put(tmp_path / "pose/1.txt", "1 0 0\n")
    put(tmp_path / "pose/2.txt", "-inf " * 16)
    poses = readers.matrices(spark, str(tmp_path / "pose")).collect()
    assert [(p.stem, p.pose[11]) for p in poses] == [("0", 2.5)]
    t = readers.trajectory(spark, put(tmp_path / "t.traj", "1.5 0 0 0 1 2 3\n1 2\n")).collect()
    assert [(r.ts, r.tz) for r in t] == [(1.5, 3.0)]
    put(tmp_path / "pin/41_12.25.pincam", "256 192 211 211 128 96")
    assert readers.pincams(spark, str(tmp_path / "pin")).first().asDict() == {"stem": "41_12.25", "ts": 12.25, "width": 256.0, "height": 192.0, "fx": 211.0, "fy": 211.0, "cx": 128.0, "cy": 96.0}


def test_poses(spark, tmp_path):
    eye = np.eye(4).tolist()
    p = put(tmp_path / "a/s1.json", json.dumps({"f0": {"pose": eye, "intrinsic": eye}, "f1": {"pose": eye, "intrinsic": eye}}))
    assert sorted((r.scene_id, r.frame, len(r.pose)) for r in readers.frame_poses(spark, p).collect()) == [("s1", "f0", 16), ("s1", "f1", 16)]
    p = put(tmp_path / "b/s2.json", json.dumps({"frames": [{"file_path": "a.jpg", "transform_matrix": eye}], "test_frames": [{"file_path": "b.jpg", "transform_matrix": eye}]}))
    assert {(r.split, r.file_path) for r in readers.transforms(spark, p).collect()} == {("frames", "a.jpg"), ("test_frames", "b.jpg")}


def test_binary(spark, tmp_path):
    np.save(tmp_path / "b.npy", np.arange(14.0).reshape(2, 7))
    assert [r.box for r in readers.boxes_npy(spark, str(tmp_path / "b.npy")).orderBy("object_id").collect()] == [[0, 1, 2, 3, 4, 5], [7, 8, 9, 10, 11, 12]]
    v = np.zeros(2, np.dtype([("p", "<f4", 3), ("c", "u1", 4)]))
    v["p"] = [[1, 2, 3], [4, 5, 6]]
    p = put(tmp_path / "m.ply", b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nend_header\n" + v.tobytes())
    assert [(r.x, r.z) for r in readers.ply_vertices(spark, p).orderBy("vertex").collect()] == [(1, 3), (4, 6)]
    p = put(tmp_path / "d.bin", struct.pack("<I", 3) + b"abc" + struct.pack("<I", 0))
    assert [bytes(r.payload) for r in readers.length_prefixed(spark, p).orderBy("frame").collect()] == [b"abc", b""]
    with pytest.raises(Exception, match="ends inside a frame"):
        readers.length_prefixed(spark, put(tmp_path / "cut.bin", struct.pack("<I", 9) + b"abc")).collect()
    head = struct.pack("<IQ", 4, 2) + b"ab" + struct.pack("<64f", *range(64)) + struct.pack("<ii4If", 2, 1, 4, 3, 4, 3, 1000.0)
    frame = struct.pack("<16f", *range(16)) + struct.pack("<4Q", 7, 8, 2, 3) + b"JJ" + b"DDD"
    r = readers.sensor_frames(spark, put(tmp_path / "s.sens", head + struct.pack("<Q", 1) + frame)).first()
    assert (r.pose[15], r.depth_ts, bytes(r.colour), bytes(r.depth)) == (15.0, 8, b"JJ", b"DDD")


def test_listing_and_sinks(spark, tmp_path):
    for n in ("c/1.jpg", "c/2.jpg", "d/1.png", "d/3.png"):
        put(tmp_path / "l" / n, "x")
    colour, depth = (readers.listing(spark, str(tmp_path / "l" / k)) for k in "cd")
    assert [r.stem for r in readers.common_stems(colour, depth).collect()] == ["1"]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    sinks.json_lines(rows, str(tmp_path / "o1"))
    sinks.by_source(rows, str(tmp_path / "o2"), "source")
    sinks.report(rows.agg(F.sum("n").alias("n")), str(tmp_path / "o3"))
    assert spark.read.json(str(tmp_path / "o1")).count() == 2 and spark.read.json(str(tmp_path / "o2/source=a")).count() == 1
    assert spark.read.json(str(tmp_path / "o3")).first().n == 3
    assert sinks.audit_groups(rows, "source", "n").count() == 2


def test_normalised_annotations(spark):
    raw = spark.createDataFrame(
        [
            (None, "sn", None, None, [("human", "<image>\nWhat is it?"), ("gpt", "a chair")], None, None, None, None),
            (None, None, ["x/scene0001_02/1.jpg"], None, None, "Is it red?", "yes", None, None),
            (None, None, ["images/h1/DSC1.jpg"], None, None, "Pick", None, "so <answer> B </answer>", ["A. x", "B. y"]),
            (None, None, None, "arkit/47.mp4", None, "Why", None, "plain", ["x", "y"]),
        ],
        "scene_id string, scene_name string, image array<string>, video string, conversations array<struct<from: string, value: string>>, question string, ground_truth string, solution string, options array<string>",
    )
    got = {r.scene_id: r for r in annotations.normalized(raw, {"arkit": "/data/arkit"}).collect()}
    assert (got["sn"].question, got["sn"].answers, got["sn"].question_type) == ("What is it?", ["a chair"], "What")
    assert (got["scene0001_02"].answers, got["scene0001_02"].question_type) == (["yes"], "Is")
    assert (got["h1"].question, got["h1"].answers) == ("Pick\nA. x\nB. y", ["B"])
    assert (got["47"].question, got["47"].answers, got["47"].data_path) == ("Why\n(A) x\n(B) y", ["plain"], "/data/arkit")
    assert annotations.usable(annotations.normalized(raw, {"arkit": "/data/arkit"})).count() == 1


def test_split_questions(spark):
    q = spark.createDataFrame([([(1, "s", "Here.", "What?"), (2, "s", None, "Is?")],)], "questions array<struct<question_id: int, scene_id: string, situation: string, question: string>>")
    a = spark.createDataFrame([([(1, [("x",)], "What"), (1, [("y",)], "What")],)], "annotations array<struct<question_id: int, answers: array<struct<answer: string>>, question_type: string>>")
    got = {r.question_id: r for r in annotations.split_questions(q, a).collect()}
    assert (got["1"].question, got["1"].answers) == ("Here. What?", ["y"]) and got["2"].answers == []


def test_task_mix(spark):
    assert annotations.task_mix("a,b, a,,c") == [("a", 2), ("b", 1), ("c", 1)]
    tasks = spark.createDataFrame(annotations.task_mix("a,b"), "task string, weight long")
    with pytest.raises(Exception, match="no counterpart"):
        annotations.substituted(tasks, spark.createDataFrame([("a", "ra")], "task string, real string")).collect()


def test_nearest_ties(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 100.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 9.0, "a"), (1, 11.0, "b"), (1, None, "c")], "k int, t double, v string")
    got = lambda **x: sorted((r.k, r.t, r["__value"]) for r in joins.nearest(left, right, ["k"], "t", "v", **x).collect())
    assert got() == [(1, 10.0, "a"), (1, 100.0, "b"), (2, 1.0, None)]
    assert got(later=True)[0] == (1, 10.0, "b") and got(tolerance=5.0)[1] == (1, 100.0, None)
