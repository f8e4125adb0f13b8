"""Steps whose work must not grow faster than their rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratacloud.functions import geometry as g
from stratacloud.functions import near
from stratacloud.operators import cloud, neighbours, registration


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_oblique_raster_paints_one_point_of_a_pixel(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 9, (400, 4)), columns=["x", "y", "z", "grey"]).assign(method="O"))
    found = cloud.oblique_raster(points, 30.0, 40.0, 1.0, 1, ["method"])
    assert "min(" in optimized(found).rsplit("Generate explode", 1)[1].split("Join")[0]
    twice = cloud.oblique_raster(points.unionByName(points), 30.0, 40.0, 1.0, 1, ["method"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, twice.collect()))


def test_equal_quads_make_their_pixels_once(spark):
    quad = [(1.0, 1.0), (6.0, 1.0), (6.0, 5.0), (1.0, 5.0)]
    quads = spark.createDataFrame([(f, "O", quad) for f in (0, 1)] * 40, "frame long, camera string, quad array<struct<u:double,v:double>>")
    found = g.masked_pixels(quads, (20, 20))
    assert "Aggregate" in optimized(found).rsplit("Generate explode", 1)[1]
    assert found.count() == 2 * g.masked_pixels(quads.limit(1), (20, 20)).count()


def test_undistorted_rays_come_by_the_batch(spark):
    k, d = (800.0, 810.0, 400.0, 300.0), (0.1, -0.02, 0.001, 0.002, 0.003)
    pixels = spark.createDataFrame([(10.0, 20.0), (700.0, 90.0), (None, 5.0), (float("nan"), 5.0)], "u double, v double")
    rays = pixels.select(g.undistort(F.col("u"), F.col("v"), k, d).alias("r")).select("r.*")
    assert "ArrowEvalPython" in optimized(rays)
    rows = rays.collect()
    assert rows[2]["x"] is None and rows[2]["y"] is None and np.isnan(rows[3]["x"])
    for (u, v), r in zip(((10.0, 20.0), (700.0, 90.0)), rows):
        back = spark.range(1).select(F.lit(r["x"]).alias("x"), F.lit(r["y"]).alias("y"), F.lit(1.0).alias("z")).select(
            *g.project([F.col(a) for a in "xyz"], k, d)).first()
        assert np.allclose(back, (u, v), atol=1e-3)


def test_small_shared_target_travels_to_the_points(spark, monkeypatch):
    """The same matches as cell by cell, and no shuffle."""
    rng = np.random.default_rng(7)
    places = np.r_[rng.uniform(0, 12, (300, 3)), np.round(rng.uniform(0, 12, (300, 3)))]
    target = spark.createDataFrame(pd.DataFrame(places, columns=["x", "y", "z"]).assign(nx=0.0, ny=places[:, 0], nz=1.0))
    left = spark.createDataFrame(pd.DataFrame(np.r_[rng.uniform(-1, 13, (400, 3)), np.round(rng.uniform(0, 12, (200, 3))) + 0.5],
                                              columns=["x", "y", "z"]).assign(frame=np.arange(600) % 5, _w=1))
    few = near.few_places(target, ["x", "y", "z"], ["nx", "ny", "nz"])
    found = near.nearest_of_few(left, few, ["x", "y", "z"], ["nx", "ny", "nz"], 1.5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    columns = ["frame", "x", "y", "z", "n_x", "n_y", "n_z", "d"]
    cells = near.nearest_in_cells(left, target, [], ["x", "y", "z"], 1.5)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, cells.select(columns).collect()))
    assert all(r["ny"] == r["n_x"] for r in found.collect())
    monkeypatch.setattr(near, "FEW_PLACES", 10)
    assert near.few_places(target, ["x", "y", "z"], []) is None


def test_points_ask_few_triangles_of_a_model(spark):
    """Every row of the points, copies too, stays where it is and gets the closest point of the mesh."""
    rng = np.random.default_rng(9)
    height = rng.uniform(0, 3, (9, 9))
    rows = [(i * 100 + j * 2 + half, *[float(v) for x, y in corners for v in (x, y, height[x, y])]) for i in range(8) for j in range(8)
            for half, corners in enumerate((((i, j), (i + 1, j), (i + 1, j + 1)), ((i, j), (i + 1, j + 1), (i, j + 1))))]
    mesh = neighbours.with_normals(spark.createDataFrame(rows, ["tri", *neighbours.CORNERS]))
    places = rng.uniform(-3, 11, (700, 3))
    points = spark.createDataFrame(pd.DataFrame(np.r_[places, places[:20]], columns=["x", "y", "z"]).assign(start=0, limit=2.0))
    few = mesh.collect()
    found = registration._closest_to_model(points, mesh, few)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = points.join(neighbours.closest_on_mesh(points, mesh.drop("nx", "ny", "nz", "area"), ["start"]), ["start", "x", "y", "z"])
    columns = ["x", "y", "z", "tri", "qx", "qy", "qz", "distance", "limit"]
    got, want = (np.array(sorted(map(tuple, df.select(columns).collect()))) for df in (found, want))
    assert len(got) == 720 and np.allclose(got, want)
