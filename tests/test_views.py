import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.operators import neighbours as n
from stratacloud.operators import trajectory as t
from stratacloud.operators import views

XYZ = ["x", "y", "z"]


def test_best_view(spark):
    rng = np.random.default_rng(0)
    points = rng.uniform(-20, 20, (60, 3))
    shifts = {f: np.array([6.0 * f - 30, 3.0 * f, 120.0 + 4 * f]) for f in range(8)}
    shifts[8] = np.array([0.0, 0.0, 5.0])       # some points behind
    poses = spark.createDataFrame([(f, [float(v) for v in (1, 0, 0, s[0], 0, 1, 0, s[1], 0, 0, 1, s[2], 0, 0, 0, 1)]) for f, s in shifts.items()], "frame long, T array<double>")
    best = None
    for f, s in shifts.items():
        p = points + s
        if (p[:, 2] <= 0).any():
            continue
        uv = 500 * p[:, :2] / p[:, 2:] + [320, 240]
        inside = ((uv >= 0) & (uv < [640, 480])).all(1).mean()
        score = (inside, -np.linalg.norm(np.median(uv, 0) - [320, 240]))
        if best is None or score > best[0]:
            best = (score, f)
    row = views.best_view(spark.createDataFrame(pd.DataFrame(points, columns=XYZ)), poses, (500.0, 500.0, 320.0, 240.0), (0.0,) * 5, (640, 480), 1000).first()
    assert row["frame"] == best[1] and row["inside"] == pytest.approx(best[0][0]) and row["off_centre"] == pytest.approx(-best[0][1])


def test_translation_constraint(spark):
    rng = np.random.default_rng(1)
    target = rng.uniform(0, 10, (80, 3))
    normals = rng.normal(size=(80, 3)) * [1, 0.5, 0.2]
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    source = np.vstack([rng.uniform(0, 10, (50, 3)), [[500.0, 0, 0]]])
    source = np.vstack([source, source[:5]])
    d = np.sqrt(((source[:, None] - target[None]) ** 2).sum(2))
    matched = normals[d.argmin(1)[d.min(1) <= 1.5]]
    eig = np.linalg.eigvalsh(matched.T @ matched)
    a = spark.createDataFrame(pd.DataFrame(source, columns=XYZ).assign(k=1)).unionByName(spark.createDataFrame([(900.0, 0.0, 0.0, 2)], "x double, y double, z double, k long"))
    b = spark.createDataFrame(pd.DataFrame(np.c_[target, normals], columns=[*XYZ, "nx", "ny", "nz"]).assign(k=1))
    rows = {r["k"]: r for r in n.translation_constraint(a, b, ["k"], 1.5).collect()}
    assert rows[1]["matches"] == len(matched) and rows[1]["constraint"] == pytest.approx(eig[0] / eig[2])
    assert rows[2]["matches"] == 0 and rows[2]["constraint"] == 0.0


def test_travel_of_a_straight_pass(spark):
    rows = [(1, f, 5.0 * f, 0.1 * (-1) ** f, 2.0) for f in range(41)]
    row = t.travel(spark.createDataFrame(rows, "rec int, frame long, x double, y double, z double"), ["rec"]).first()
    assert row["travel_mm"] == pytest.approx(200, abs=1e-6) and row["range_mm"] == pytest.approx(200, abs=1e-3)
    assert row["off_line_mm"] == pytest.approx(0.1, abs=1e-3)


def test_grip(spark):
    normals = spark.createDataFrame([("m", 1, 1.0, 0.0, 0.0), ("m", 1, 0.0, 0.0, 1.0), ("m", 2, -0.8, 0.6, 0.0)], "method string, frame int, nx double, ny double, nz double")
    directions = spark.createDataFrame([("m", 1, 1.0, 0.0, 0.0), ("m", 2, 1.0, 0.0, 0.0)], "method string, frame int, tx double, ty double, tz double")
    row = n.grip_medians(n.grip_counts(normals, directions, ["method", "frame"]), ["method"]).withColumn("one", F.lit(1)).first()
    assert (row["frames"], row["grip"], row["points"]) == (2, 1.0, 1.5)


def test_source_views_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(views, "LEAST_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for rec, n in (("a", 150), ("b", 40)):
        c, a = rng.normal(0, 150, (n, 3)), rng.normal(0, 0.3, (n, 3)) + [0, 0, 1]
        a /= np.linalg.norm(a, axis=1)[:, None]
        c[n // 2:] = c[:n - n // 2]         # copies of a view: the name decides
        a[n // 2:] = a[:n - n // 2]
        c[1] = c[0] + 450 * a[0]            # stands on the target, so no angle is known
        rows += [(rec, f"v{k:03d}", f"v{k ^ 1:03d}", *map(float, c[k]), *map(float, a[k])) for k in range(n)]
    df = pd.DataFrame(rows, columns=["rec", "name", "partner", "cx", "cy", "cz", "ax", "ay", "az"])
    want = []
    for rec, part in df.groupby("rec"):
        c, a, names = part[["cx", "cy", "cz"]].to_numpy(), part[["ax", "ay", "az"]].to_numpy(), part["name"].to_numpy()
        for k in range(len(part)):
            t = c[k] + 450 * a[k]
            back, o = c[k] - t, c - t
            with np.errstate(all="ignore"):
                far = np.sqrt((o ** 2).sum(1))
                angle = np.degrees(np.arccos(np.clip(o @ back / np.linalg.norm(back) / far, -1, 1)))
                off = np.degrees(np.arccos(np.clip(-(o * a).sum(1) / far, -1, 1)))
            good = np.flatnonzero((angle >= 4) & (angle <= 40) & (off <= 35) & (names != names[k]))
            best = sorted(good, key=lambda j: (names[j] != part["partner"].iloc[k], round(abs(angle[j] - 15), 9), names[j]))[:4]
            want += [(rec, names[k], r + 1, names[j], round(angle[j], 6)) for r, j in enumerate(best)]
    got = views.ranked_sources(spark.createDataFrame(df), 4, 450.0, ["rec"])
    assert sorted((r["rec"], r["name"], r["rank"], r["other"], round(r["angle"], 6)) for r in got.collect()) == sorted(want)


def test_best_view_makes_no_row_per_frame_and_point(spark):
    points = spark.range(200).select(*[(F.rand(k) * 10 + 50).alias(a) for k, a in enumerate(XYZ)])
    poses = spark.createDataFrame([(f, [float(v) for v in (1, 0, 0, 0.1 * f, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]) for f in range(5)] + [(9, None)], "frame long, T array<double>")
    best = views.best_view(points, poses, (500.0, 500.0, 320.0, 240.0), (0.0,) * 5, (640, 480), 100)
    plan = best._jdf.queryExecution().toString()
    assert best.count() == 1 and best.first()["frame"] != 9
    assert "Join" not in plan and "Aggregate" not in plan
