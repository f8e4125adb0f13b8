import hashlib
import json
import os

import numpy as np
import pandas as pd
import pytest

from stratacloud.sources import files, store


def ply(path, n, views=True, rgb=True):
    dtype = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("red", "u1"), ("green", "u1"), ("blue", "u1")] if rgb else []) + ([("views", "<u2")] if views else [])
    v = np.zeros(n, dtype)
    v["x"], v["y"], v["z"] = np.arange(n), np.arange(n) * 2, 0.5
    if rgb:
        v["red"] = v["green"] = v["blue"] = 90
    if views:
        v["views"] = 7
    kinds = {"<f4": "float", "|u1": "uchar", "u1": "uchar", "<u2": "ushort"}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"] + [f"property {kinds[t]} {c}" for c, t in dtype] + ["end_header"]
    with open(path, "wb") as fh:
        fh.write(("\n".join(head) + "\n").encode() + v.tobytes())


def test_clouds(spark, tmp_path):
    ply(tmp_path / "a.ply", 10)
    ply(tmp_path / "b.ply", 4, views=False, rgb=False)
    np.savez(tmp_path / "c.npz", xyz=np.ones((3, 3), np.float32), grey=np.full(3, 200, np.uint8))
    got = files.read_clouds(spark, str(tmp_path)).toPandas()
    got["name"] = got["path"].str.rsplit("/", n=1).str[1]
    assert got.groupby("name").size().to_dict() == {"a.ply": 10, "b.ply": 4, "c.npz": 3}
    assert set(got[got.name == "a.ply"]["views"]) == {7} and set(got[got.name == "b.ply"]["views"]) == {1}
    assert set(got[got.name == "c.npz"]["grey"]) == {200.0} and set(got[got.name == "a.ply"]["grey"]) == {90.0}


def test_trajectories(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("""%YAML:1.0
---
# a comment
metadata:
   script: "track"
   seconds: 12.5
frames:
   -
      name: "0001.png"
      fitness: 0.75
      lost: 0.
      T_cam_world: !!opencv-matrix
         rows: 4
         cols: 4
         dt: d
         data: [ 1., 0., 0., 5., 0., 1., 0., 6., 0., 0., 1., 7., 0., 0., 0., 1. ]
   -
      name: "0002.png"
      lost: 1.
""")
    rows = {r["frame"]: r for r in files.read_trajectories(spark, str(tmp_path)).collect()}
    assert rows["0001.png"]["T"][3] == 5.0 and rows["0001.png"]["diag"] == {"fitness": 0.75, "lost": 0.0}
    assert rows["0002.png"]["T"] is None and rows["0002.png"]["metadata"]["seconds"] == "12.5"


def test_frame_pairs_and_digest(spark, tmp_path):
    for name in ("left/b.png", "left/a.png", "left/x.txt", "right/a.png", "right/b.png", "right/c.png", "top.txt"):
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(name.encode())
    assert [r["name"] for r in files.find_frame_pairs(spark, str(tmp_path)).collect()] == ["a.png", "b.png"]
    # a folder's files by name come before its folders by name
    names = [b"top.txt", b"left/a.png", b"left/b.png", b"left/x.txt", b"right/a.png", b"right/b.png", b"right/c.png"]
    state = hashlib.sha256(b"".join(n + hashlib.sha256(n).digest() for n in names))
    assert files.folder_digest(spark, str(tmp_path)).first()["digest"] == state.hexdigest()


def test_detections(spark):
    document = {"cameras": {"left": {"f/a.png": {"ids": [3, 3, 5, 71], "corners": [[[k, 0.0]] * 4 for k in range(4)], "merge_conflicts": 0}}}}
    df = spark.createDataFrame([(json.dumps(document),)], "value string")
    flat = files.flatten_detections(df)
    assert flat.count() == 4
    assert [r["tag"] for r in files.board_tags(flat).collect()] == [5]
    assert files.board_tags(flat, spark.createDataFrame([("left", "f/a.png", 5)], "camera string, image string, tag long")).count() == 0


def test_upsert_versions(spark, tmp_path):
    path = str(tmp_path / "summary")
    rows = lambda *r: spark.createDataFrame(list(r), "session string, scan string, fit string, rms double")
    store.write_upsert(spark, path, rows(("s", "a", "x", 1.0), ("s", "a", "y", 2.0), ("s", "b", "x", 3.0)), ["session", "scan"], ["session", "scan", "fit"])
    store.write_upsert(spark, path, rows(("s", "a", "x", 9.0)), ["session", "scan"], ["session", "scan", "fit"])
    got = spark.read.parquet(store.current_version(spark, path)).collect()
    assert {(r["scan"], r["fit"], r["rms"]) for r in got} == {("a", "x", 9.0), ("b", "x", 3.0)}


def test_cache(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def evaluate(fresh):
        calls.append(fresh.count())
        return fresh.selectExpr("settings_hash", "x * 10 AS score")

    one = spark.createDataFrame([(1,), (2,)], "x long")
    two = spark.createDataFrame([(2,), (3,)], "x long")
    header = {"min_tags": 10}
    store.evaluate_cached(spark, one, ["x"], path, header, evaluate)
    got = store.evaluate_cached(spark, two, ["x"], path, header, evaluate)
    assert {r["score"] for r in got.collect()} == {20, 30} and calls == [2, 1]
    store.evaluate_cached(spark, two, ["x"], path, {"min_tags": 11}, evaluate)
    assert calls == [2, 1, 2]


def test_manifest_and_diff(spark, tmp_path):
    digests = spark.createDataFrame([("in", "abc")], "folder string, digest string")
    store.write_manifest(store.manifest(spark, "fusion", {"voxel": 1}, digests, [{"n": 1}]), str(tmp_path / "m"))
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row["experiment"] == "fusion" and row["input_digests"]["in"] == "abc"
    side = lambda d: spark.createDataFrame(pd.DataFrame({"key": list(d), "value": list(d.values())}))
    got = store.settings_diff(side({"a": 1, "b": 2, "c": 3}), side({"a": 1, "b": 5, "d": 4})).collect()
    assert {(r["key"], r["left_value"], r["right_value"]) for r in got} == {("b", 2, 5), ("c", 3, None), ("d", None, 4)}


def test_locate(spark):
    df = spark.createDataFrame([("/a/results/S/s20/dense/cloud.ply",), ("/a/results/analysis/x/y/z",), ("/a/results/S/summary.csv",), ("/a/other/S/s/m/f",)], "p string")
    got = [r["l"] for r in df.select(files.locate(df.p).alias("l")).collect()]
    assert (got[0]["session"], got[0]["scan"], got[0]["method"]) == ("S", "s20", "dense") and got[1:] == [None, None, None]


def test_small_clouds_leave_together():
    """Thousands of files of one vertex make few tables, not one each."""
    import numpy as np
    import pandas as pd

    from stratacloud.sources import files

    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    content = [head + np.array([k, 1, 2], "<f4").tobytes() for k in range(3000)]
    given = pd.DataFrame({"path": [f"{k}.ply" for k in range(3000)], "content": content})
    got = list(files._decoded(iter([given])))
    assert len(got) == 1
    assert (got[0]["x"] == np.arange(3000)).all() and list(got[0]["path"]) == list(given["path"])
    assert (got[0]["views"] == 1).all() and (got[0]["grey"] == 0).all()
