"""Registration on packed points: no point moves in an iteration, and the results are those of rows that meet cell by cell."""

import numpy as np
import pandas as pd
import pytest
from test_blocks import shuffled

from stratacloud.functions import near
from stratacloud.operators import matching, registration
from stratacloud.plans import motion

XYZ = ["x", "y", "z"]


def clouds(spark, shift, size=900):
    rng = np.random.default_rng(5)
    target = np.c_[rng.uniform(0, 30, (size, 2)), rng.uniform(0, 6, size)]
    target[:200] = np.round(target[:200])           # on the faces of blocks
    source = target[::2] + shift
    source = np.vstack([source, source[:40], source[:1] + 70])
    up = np.tile([0.0, 0.6, 0.8], (size, 1))
    a = pd.concat([pd.DataFrame(source * [1, 1, s], columns=XYZ).assign(k=f"s{s}") for s in (1, 2)])
    b = pd.concat([pd.DataFrame(np.c_[target * [1, 1, s], up], columns=[*XYZ, "nx", "ny", "nz"]).assign(k=f"s{s}") for s in (1, 2)])
    return spark.createDataFrame(a), spark.createDataFrame(b)


@pytest.mark.parametrize("plane", [False, True])
def test_packed_points_register_as_rows_do(spark, plane, monkeypatch):
    a, b = clouds(spark, [0.9, -0.8, 0.3])
    packs, deal = [], matching.by_block
    monkeypatch.setattr(matching, "by_block", lambda *args: packs.append(1) or deal(*args))

    def found():
        rows = registration.icp(a, b, ["k"], 1.2, plane=plane, iterations=6, robust=1.0 if plane else None).orderBy("k").collect()
        return np.array([[*r["T"], r["fitness"], r["inlier_rmse"]] for r in rows])

    packed = found()
    assert len(packs) >= (1 if plane else 2)        # moved further than the margin: packed again
    monkeypatch.setattr(matching, "EDGES", ())
    assert np.allclose(packed, found(), atol=1e-9) and packed.shape == (2, 18)


def test_iterations_move_no_points(spark):
    a, b = clouds(spark, [0.1, 0.05, 0.0], 20_000)
    spent = []
    for iterations in (1, 5):
        start = shuffled(spark)
        assert registration.icp(a, b, ["k"], 1.0, plane=False, iterations=iterations, tolerance=0.0).count() == 2
        spent.append(shuffled(spark) - start)
    assert spent[1] - spent[0] < 100_000


def test_point_icp_runs_all_its_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(motion.registration, "icp", lambda *a, **k: asked.append(k["iterations"]) or a[0].selectExpr("scan", "array_repeat(0D, 16) AS T", "1D AS fitness", "0D AS inlier_rmse"))
    motion.f9_point(spark, "/root/testdata/sf0.001")
    assert asked == [50]


def test_grid_finds_the_nearest_with_smaller_coordinates():
    rng = np.random.default_rng(0)
    for case in range(30):
        axes, r = rng.integers(1, 4), rng.choice([0.3, 1.5, 5.0])
        q, p = rng.uniform(-5, 20, (rng.integers(1, 300), axes)), rng.uniform(-8, 24, (200, axes))
        if case % 3 == 0:
            q, p = np.round(q), np.round(p) + 0.5
        if case % 5 == 0:
            q = np.vstack([q, q.max(0) + 1e7])
        q = np.unique(q, axis=0)
        at, d = near._nearest_within(p, q, r)
        every = near._distances(p, q)
        every[every > r] = np.inf
        met = np.isfinite(every.min(1))
        assert (np.isfinite(d) == met).all() and (d[met] == every.min(1)[met]).all() and (at[met] == every.argmin(1)[met]).all()


def test_frame_refinement_runs_all_its_rounds(spark, monkeypatch):
    asked = []

    def icp(source, target, keys, distance, start, plane, iterations, *rest):
        asked.append((distance, iterations))
        return start.selectExpr("frame", "T", "1D AS fitness", "0D AS inlier_rmse")

    monkeypatch.setattr(registration, "icp", icp)
    assert motion.f10(spark, "/root/testdata/sf0.001").count() == 4
    assert asked == [(5.0, 30), (3.0, 30), (2.0, 30), (1.5, 30)]


def test_model_fit_runs_all_its_starts_and_rounds_on_all_points(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registration, "_fit_packed", lambda points, few, box, state, dof, height, margin, iterations: asked.append(
        (points.count(), state.count(), iterations)) or (state, state.selectExpr("start", "CAST(1 AS BIGINT) AS inliers", "0D AS rms")))
    assert motion.f8(spark, "/root/testdata/sf0.001").count() == 1
    assert asked == [(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count(), 24, 60)]


def test_median_of_residuals_is_exact(spark):
    """Bins only say where to look."""
    rng = np.random.default_rng(3)
    parts = [(s, rng.uniform(0, 4, n) ** 2, rng.integers(1, 3, n)) for s, n in ((0, 501), (0, 300), (1, 40))]
    rows = spark.createDataFrame([(s, bytearray(r.tobytes()), bytearray(w.tobytes())) for s, r, w in parts], "_g bigint, _r binary, _w binary")
    limit, bins, total = np.array([20.0, 17.0]), np.zeros((2, registration.BINS), np.int64), np.zeros((2, 1))
    for s, r, w in parts:
        bins[s] += np.bincount(registration._bin(r, limit[s]), w, registration.BINS).astype(np.int64)
        total[s] += w.sum()
    found = registration._medians(rows, np.array([0, 1]), total, bins, limit)
    for s in (0, 1):
        every = np.concatenate([np.repeat(r, w) for k, r, w in parts if k == s])
        assert found[s] == pytest.approx(np.median(every), abs=1e-15)
