import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratacloud.operators import cloud, sync
from stratacloud.streaming import streams

SF = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def write_parts(df, folder, order, n):
    pdf = df.toPandas().sort_values(order, ignore_index=True)
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), n)):
        df.sparkSession.createDataFrame(pdf.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_voxel_stream_equals_batch(spark, tmp_path):
    points = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey AS frame", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z", "l_tax * 1000 AS grey")
    stream = write_parts(points, str(tmp_path / "in"), ["x"], 4)     # frames are split over batches on purpose
    query = streams.start_voxel_stream(stream, 2.0, str(tmp_path / "sums"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    columns = ["vx", "vy", "vz", "x", "y", "z", "grey", "views"]
    want = cloud.voxel_vote(points, 2.0, 2).select(*columns).toPandas().sort_values(["vx", "vy", "vz"], ignore_index=True)
    for path in (str(tmp_path / "sums"), str(tmp_path / "merged")):
        if path.endswith("merged"):
            streams.compact_voxels(spark, str(tmp_path / "sums"), path)
        got = streams.voted_so_far(spark, path, 2).toPandas().sort_values(["vx", "vy", "vz"], ignore_index=True)
        pd.testing.assert_frame_equal(got, want)


def test_cost_windows_equal_batch(spark, tmp_path):
    samples = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_type AS stage", "CAST(ts AS TIMESTAMP) AS ts", "value AS rss_mb")
    late = spark.createDataFrame([("click", datetime.datetime(2030, 1, 1), 1.0)], samples.schema)
    stream = write_parts(samples.unionByName(late), str(tmp_path / "in"), ["ts"], 3)
    got = drain(streams.cost_windows(stream, "6 hours", "1 hour"), "costs").toPandas().sort_values(["window_start", "stage"], ignore_index=True)
    want = streams.cost_windows(samples, "6 hours", "1 hour").toPandas().sort_values(["window_start", "stage"], ignore_index=True)
    assert len(got) == len(want) > 10
    pd.testing.assert_frame_equal(got, want)


def test_paired_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    left, right = np.sort(rng.integers(0, 10**11, 150)) // 1000 * 1000, np.sort(rng.integers(0, 10**11, 120)) // 1000 * 1000
    schema = "camera string, frame long, pts_ns long"
    stamps = spark.createDataFrame([("left", k, int(v)) for k, v in enumerate(left)] + [("right", k, int(v)) for k, v in enumerate(right)], schema)
    end = spark.createDataFrame([(c, 10**6, 10**13) for c in ("left", "right")], schema)
    stream = streams.event_time(write_parts(stamps.unionByName(end), str(tmp_path / "in"), ["pts_ns"], 4))
    got = drain(streams.paired_stream(stream.where("camera = 'right'"), stream.where("camera = 'left'"), 400.0), "pairs").toPandas()
    got = got[got.right_frame < 10**6].sort_values("right_frame", ignore_index=True)
    want = sync.gap_gate(sync.match_left(stamps), 400.0).select(*got.columns).toPandas().sort_values("right_frame", ignore_index=True)
    assert len(want) > 20
    pd.testing.assert_frame_equal(got, want)


def test_tsdf_plane(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in range(4):
        xy = rng.uniform(-20, 20, (3000, 2))
        rows += [(f, *p, 100.0 + 0.01 * f, 50.0) for p in xy]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["frame", "x", "y", "z", "grey"]))
    eye = [float(k % 5 == 0) for k in range(16)]
    poses = spark.createDataFrame([(f, eye) for f in range(4)], "frame long, T array<double>")
    voxels = cloud.tsdf_voxels(points, poses, 1.0, 4.0, 1.0, 3)
    surface = cloud.tsdf_surface(voxels, 1.0).toPandas()
    assert len(surface) > 500 and abs(surface["z"] - 100.015).max() < 0.1
    assert voxels.agg(F.max("weight").alias("w")).first()["w"] == 4
