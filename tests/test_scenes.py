"""Scenes written to disk and read back; component colours against numpy."""

import math
import os
import struct

import numpy as np
import pytest

from orrery.operators import components
from orrery.sources import scenes

POSE = "\n".join(" ".join(str(float(4 * i + j)) for j in range(4)) for i in range(4))
PARAMS = "colorWidth = 1296\ncolorHeight = 968\nfx_color = 1000.0\nfy_color = 900.0\nmx_color = 640.0\nmy_color = 480.0\nfx_color = 1100.0\naxisAlignment = " + " ".join(["0.5"] * 16) + "\nnote\n"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def test_frames_with_reasons(spark, tmp_path):
    def write(path, content):
        full = tmp_path / path
        os.makedirs(full.parent, exist_ok=True)
        full.write_bytes(content if isinstance(content, bytes) else content.encode())

    for scene, params in (("s1", PARAMS), ("s2", None), ("s3", "fx_color = 5\nfy_color = x\n")):
        for stem in ("000", "001", "002", "003"):
            write(f"{scene}/color/{stem}.png", png(648, 484))
            write(f"{scene}/pose/{stem}.txt", POSE)
            write(f"{scene}/depth/{stem}.png", png(320, 240))
        if params:
            write(f"{scene}/{scene}.txt", params)
    os.remove(tmp_path / "s1/pose/001.txt")
    write("s1/pose/002.txt", POSE.replace("3.0", "nan", 1))
    os.remove(tmp_path / "s1/depth/003.png")
    sizes = scenes.png_sizes(spark, str(tmp_path))
    frames = scenes.scene_frames(spark, str(tmp_path), sizes=sizes)
    got = {(r.scene_id, r.stem): r for r in frames.collect()}
    assert len(got) == 12
    whole = got["s1", "000"]
    assert whole.reason is None and whole.pose == [float(k) for k in range(16)] and whole.alignment == [0.5] * 16
    assert (whole.fx, whole.fy, whole.cx, whole.cy) == pytest.approx((550.0, 450.0, 320.0, 240.0)) and whole.depth.endswith("s1/depth/000.png")
    assert [got["s1", s].reason for s in ("001", "002", "003")] == ["no_pose", "bad_pose", "no_depth"]
    assert {got[s, "000"].reason for s in ("s2",)} == {"no_intrinsics"} and got["s3", "000"].reason == "bad_intrinsics"
    audit = {r.scene_id: r.asDict() for r in scenes.scene_audit(frames).collect()}
    assert (audit["s1"]["frames"], audit["s1"]["whole"], audit["s1"]["no_pose"], audit["s2"]["no_intrinsics"], audit["s3"]["bad_intrinsics"]) == (4, 1, 1, 4, 4)
    plain = {r.stem: r.fx for r in scenes.scene_frames(spark, str(tmp_path)).where("scene_id = 's1'").collect()}
    assert plain["000"] == 1100.0


def test_colours_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 12)) + 0.05 * rng.normal(size=(200, 12)) + 40
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [math.nan] * 12)]
    out, shares = components.component_colours(spark.createDataFrame(rows, "id long, f array<double>").repartition(3), "f")
    got = {r.id: (r.r, r.g, r.b) for r in out.collect()}
    centred = x - x.mean(axis=0)
    _, s, vh = np.linalg.svd(centred, full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:3])
    for k in range(3):
        axis = vh[k] * np.sign(vh[k][np.abs(vh[k]).argmax()])
        want = centred @ axis
        want = (want - want.min()) / (want.max() - want.min())
        assert np.abs(np.array([got[i][k] for i in range(200)]) - want).max() < 1e-6
    assert got[900] == got[901] == got[902] == (None, None, None)


def test_colours_without_spread(spark):
    out, shares = components.component_colours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "id long, f array<double>"), "f")
    assert shares == [1.0] and sorted((r.r, r.g, r.b) for r in out.collect()) == [(0.0, None, None), (1.0, None, None)]
    out, shares = components.component_colours(spark.createDataFrame([], "id long, f array<double>"), "f")
    assert shares == [] and out.columns == ["id", "f", "r", "g", "b"] and out.collect() == []
