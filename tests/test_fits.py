import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions import geometry as g
from stratacloud.functions.matrices import rotation_vector_matrix
from stratacloud.operators import fit, homography, registration
from stratacloud.operators import trajectory as t

XYZ = ["x", "y", "z"]


def pose(r, shift):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation_vector_matrix(np.array(r, float)), shift
    return out


def kabsch(a, b):
    ca, cb = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((b - cb).T @ (a - ca))
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ d @ vt
    return r, cb - r @ ca, np.trace(np.diag(s) @ d) / ((a - ca) ** 2).sum()


@pytest.mark.parametrize("with_scale", [False, True])
def test_align_groups(spark, with_scale):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for key in range(4):
        a = rng.normal(size=(40, 3)) * 50 + 1000
        if key == 3:
            a[:, 2] = 7.0       # a plane: the reflection has to be kept out
        p = pose(rng.normal(size=3), rng.normal(size=3) * 30)
        b = (1.3 if with_scale else 1.0) * a @ p[:3, :3].T + p[:3, 3] + rng.normal(size=a.shape) * 0.1
        rows += [(key, *s, *q) for s, q in zip(a, b)]
        want[key] = (a, b)
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "sx", "sy", "sz", "tx", "ty", "tz"]))
    for row in fit.align(df, ["k"], with_scale).collect():
        a, b = want[row["k"]]
        r, shift, scale = kabsch(a, b)
        scale = scale if with_scale else 1.0
        shift = b.mean(0) - scale * r @ a.mean(0)
        m = np.array(row["T"]).reshape(4, 4)
        np.testing.assert_allclose(m[:3, :3], scale * r, atol=1e-8)
        np.testing.assert_allclose(m[:3, 3], shift, atol=1e-5)
        rms = np.sqrt((((scale * a @ r.T + shift) - b) ** 2).sum(1).mean())
        assert row["rms"] == pytest.approx(rms, abs=1e-6)


def test_mean_rotation_and_removal(spark):
    rng = np.random.default_rng(1)
    poses = [pose(rng.normal(size=3) * 0.1 + [0.2, 0, 0], rng.normal(size=3)) for _ in range(9)]
    df = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(poses)], "frame int, T array<double>")
    u, _, vt = np.linalg.svd(np.mean([p[:3, :3] for p in poses], 0))
    np.testing.assert_allclose(np.array(fit.mean_rotation(df, []).first()["R"]).reshape(3, 3), u @ vt, atol=1e-10)
    common = np.eye(4)
    common[:3, :3], common[:3, 3] = u @ vt, np.mean([p[:3, 3] for p in poses], 0)
    for row in fit.remove_common(df, []).collect():
        np.testing.assert_allclose(np.array(row["T"]).reshape(4, 4), np.linalg.inv(common) @ poses[row["frame"]], atol=1e-9)


def test_planes(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(-50, 50, (200, 2)) + 500
    z = 0.1 * xy[:, 0] - 0.05 * xy[:, 1] + 3 + rng.normal(scale=0.2, size=200)
    df = spark.createDataFrame(pd.DataFrame(np.c_[xy, z], columns=XYZ).assign(k=1))
    row = fit.plane_fit(df, ["k"]).first()
    want = np.linalg.lstsq(np.c_[xy, np.ones(200)], z, rcond=None)[0]
    np.testing.assert_allclose([row["a"], row["b"], row["c"]], want, atol=1e-7)
    p = np.c_[xy, z]
    normal = np.linalg.svd(p - p.mean(0))[2][2]
    normal = -normal if normal[2] > 0 else normal
    o = fit.orthogonal_plane(df, ["k"]).first()
    np.testing.assert_allclose([o["nx"], o["ny"], o["nz"]], normal, atol=1e-8)
    assert o["rms"] == pytest.approx(np.sqrt((((p - p.mean(0)) @ normal) ** 2).mean()), abs=1e-8)


def test_local_levelling(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 120, (4000, 2))
    z = 0.02 * xy[:, 0] - 0.01 * xy[:, 1] + 0.5 + rng.normal(scale=0.05, size=4000)
    z[:200] += 5
    df = spark.createDataFrame(pd.DataFrame(np.c_[xy, z], columns=XYZ))
    box = (50.0, 70.0, 50.0, 70.0)
    row = fit.local_levelling(df, box, [], (10.0, 40.0)).first()
    assert (row["a"], row["b"]) == (pytest.approx(0.02, abs=1e-3), pytest.approx(-0.01, abs=1e-3))
    m = np.array(row["level"]).reshape(4, 4)
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-9)
    plane = np.c_[xy, row["a"] * xy[:, 0] + row["b"] * xy[:, 1] + row["c"]]
    assert np.abs((plane @ m[:3, :3].T + m[:3, 3])[:, 2]).max() < 1e-8


def test_gated_align_drops_outliers(spark):
    rng = np.random.default_rng(4)
    p = pose([0.3, -0.2, 0.1], [5, 6, 7])
    rows = []
    for f in range(30):
        a = rng.normal(size=(4, 3)) * 100
        b = a @ p[:3, :3].T + p[:3, 3] + rng.normal(size=(4, 3)) * 0.05 + (40 if f in (3, 11) else 0)
        rows += [(f, k, *s, *q) for k, (s, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["frame", "point", "sx", "sy", "sz", "tx", "ty", "tz"]))
    fitted, judged = fit.gated_align(df, [], "frame", 3, 1.0)
    assert {r["frame"] for r in judged.where("NOT keep").collect()} == {3, 11}
    np.testing.assert_allclose(np.array(fitted.first()["T"]).reshape(4, 4), p, atol=0.1)


def board_observations(rng, tags=6, frames=12):
    model = np.array(fit.tag_model(35.0))
    layout = {k: model + [46.0 * (k % 3), 46.0 * (k // 3), 0] for k in range(tags)}
    rows, poses = [], {}
    for f in range(frames):
        p = poses[f] = pose(rng.normal(size=3) * 0.2, [0, 0, 400] + rng.normal(size=3) * 20)
        for k in range(tags):
            if (f + k) % 3 == 0 and k > 0:
                continue
            for c, corner in enumerate(layout[k] @ p[:3, :3].T + p[:3, 3]):
                rows.append((f, k, c, *corner))
    return layout, poses, pd.DataFrame(rows, columns=["frame", "tag", "corner", *XYZ])


def test_layout_chain(spark):
    rng = np.random.default_rng(5)
    layout, poses, rows = board_observations(rng)
    lonely = pd.DataFrame([(99, 50, c, float(c), float(c * c), 300.0) for c in range(4)], columns=rows.columns)
    seen = spark.createDataFrame(pd.concat([rows, lonely]))
    first = fit.initial_layout(seen, 35.0)
    refined = fit.refine_layout(seen, first, 2)
    got = refined.toPandas().sort_values(["tag", "corner"])
    assert set(got["tag"]) == set(layout)
    want = np.vstack([layout[k] for k in sorted(layout)])
    r, shift, _ = kabsch(want, got[XYZ].to_numpy())
    np.testing.assert_allclose(want @ r.T + shift, got[XYZ].to_numpy(), atol=1e-5)
    assert first.where("tag = 50 AND x IS NOT NULL").count() == 0
    placed = fit.frame_poses(refined, seen)
    by_frame = {row["frame"]: row for row in placed.collect()}
    assert by_frame[99]["T"] is None and by_frame[0]["rms"] < 1e-5
    board = np.array(fit.board_frame(refined, 0, placed).first()["T"]).reshape(4, 4)
    flat = got[XYZ].to_numpy() @ board[:3, :3].T + board[:3, 3]
    assert np.abs(flat[:, 2]).max() < 1e-5 and np.abs(flat.mean(0)).max() < 1e-6
    eyes = [np.linalg.inv(np.array(by_frame[f]["T"]).reshape(4, 4))[:3, 3] for f in poses]
    assert (board[:3, :3] @ np.mean(eyes, 0) + board[:3, 3])[2] > 0


def test_layout_transform_needs_two_tags(spark):
    _, _, rows = board_observations(np.random.default_rng(6), 2, 1)
    one = spark.createDataFrame(rows[rows.tag == 0].assign(k=1))
    with pytest.raises(Exception, match="share fewer than"):
        fit.layout_transform(one, one, ["k"]).collect()


def test_covariance(spark):
    rng = np.random.default_rng(7)
    m, rows, a = 3, [], np.zeros((3, 3))
    ssr = n = 0
    for f in range(5):
        jp, jq, r = rng.normal(size=(30, m)), rng.normal(size=(30, 6)), rng.normal(size=30)
        a += jp.T @ jp - jp.T @ jq @ np.linalg.solve(jq.T @ jq, jq.T @ jp)
        ssr, n = ssr + r @ r, n + 30
        rows += [(f, p.tolist(), q.tolist(), float(v)) for p, q, v in zip(jp, jq, r)]
    row = fit.intrinsic_covariance(spark.createDataFrame(rows, "frame int, jp array<double>, jq array<double>, r double"), m).first()
    dof = n - m - 30
    cov = ssr / dof * np.linalg.inv(a)
    np.testing.assert_allclose(row["sigma"], np.sqrt(np.diag(cov)), rtol=1e-9)
    assert row["dof"] == dof


def test_icp_recovers_motion(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 40, (1500, 2))
    target = np.c_[xy, 3 * np.sin(xy[:, 0] / 5) + 2 * np.cos(xy[:, 1] / 6)]
    p = pose([0.01, -0.015, 0.02], [0.4, -0.3, 0.2])
    source = target @ p[:3, :3].T + p[:3, 3]
    a = spark.createDataFrame(pd.DataFrame(source, columns=XYZ).assign(k=1))
    b = spark.createDataFrame(pd.DataFrame(target, columns=XYZ).assign(k=1))
    row = registration.refine_icp(a, b, ["k"], 1.5, 3.0, iterations=8).first()
    back = source @ np.array(row["T"]).reshape(4, 4)[:3, :3].T + np.array(row["T"]).reshape(4, 4)[:3, 3]
    assert np.sqrt(((back - target) ** 2).sum(1)).mean() < 0.25
    assert row["fitness"] > 0.9


def test_fit_model_finds_the_yaw(spark):
    rng = np.random.default_rng(9)
    corner = np.array([(0, 0, 0), (30, 0, 0), (30, 12, 0), (0, 12, 0), (8, 6, 14)], float)
    faces = [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)]
    mesh = spark.createDataFrame(pd.DataFrame([[k, *corner[list(f)].ravel()] for k, f in enumerate(faces)],
                                              columns=["tri", *[f"{p}{a}" for p in "abc" for a in "xyz"]]).astype({"tri": "int64"}))
    w = rng.dirichlet([1, 1, 1], 500)
    local = np.einsum("nk,nkd->nd", w, corner[np.array(faces)[rng.integers(0, 4, 500)]])
    p = pose([0, 0, np.radians(93)], [100, 50, 0])
    points = spark.createDataFrame(pd.DataFrame(local @ p[:3, :3].T + p[:3, 3], columns=XYZ))
    best = registration.fit_model(points, mesh, yaws=[0, 90, 180, 270], min_height=0.0, iterations=12).first()
    assert best["inliers"] == 500 and best["rms"] < 1e-6
    np.testing.assert_allclose(np.array(best["T"]).reshape(4, 4), p, atol=1e-6)


def test_homography(spark):
    h = np.array([[1.1, 0.02, 5], [-0.03, 0.9, 7], [1e-4, 2e-4, 1]])
    plan = np.array([(0, 0), (10, 0), (10, 8), (0, 8), (4, 3)], float)
    image = np.c_[plan, np.ones(5)] @ h.T
    image = image[:, :2] / image[:, 2:]
    df = spark.createDataFrame([(1, *map(float, p), *map(float, q)) for p, q in zip(plan, image)], "k int, px double, py double, u double, v double")
    np.testing.assert_allclose(homography.plane_homography(df, ["k"]).first()["h"], h.ravel()[:8], atol=1e-6)


def trajectory(spark, n, centres, lost=()):
    rows = []
    for k in range(n):
        p = np.eye(4)
        p[:3, 3] = centres[k]
        rows.append((k, p.ravel().tolist(), int(k in lost)))
    return spark.createDataFrame(rows, "frame long, T array<double>, lost int")


def line(n=100):
    return np.c_[5.0 * np.arange(n), np.zeros(n), np.zeros(n)]


@pytest.mark.parametrize("case,failed", [("clean", False), ("lost20", False), ("lost21", True), ("jumps", True), ("one_jump", False)])
def test_assess(spark, case, failed):
    centres, lost = line(), ()
    if case.startswith("lost"):
        lost = range(100 - int(case[4:]), 100)
    if case == "jumps":
        centres[10:20:2] += 300
    if case == "one_jump":
        centres[50:] += 100
    poses = trajectory(spark, 100, centres, set(lost))
    row = t.assess(poses.select("frame"), poses, []).first()
    assert row["failed"] is failed
    assert bool(row["reasons"]) is failed


@pytest.mark.parametrize("n,want", [(151, [0, 10, 20, 30, 40, 50, 60, 70]), (20, [0, 10]), (15, [0])])
def test_candidate_starts(spark, n, want):
    sizes = spark.createDataFrame([(n,)], "frames long")
    assert sorted(r["start"] for r in t.candidate_starts(sizes, 10, 0.5).collect()) == want


def test_relative_error_on_itself_is_zero_and_uses_first_later_frame(spark):
    rng = np.random.default_rng(10)
    centres = np.cumsum(rng.normal(size=(150, 3)) + [4, 0, 0], 0)
    poses = trajectory(spark, 150, centres)
    errors = t.aligned_errors(poses.withColumn("rec", F.lit(1)), poses.withColumn("rec", F.lit(1)), ["rec"])
    got = t.relative_errors(errors, ["rec"], 50.0).toPandas()
    assert got["rpe_percent"].abs().max() < 1e-6
    axis = np.linalg.svd(centres - centres.mean(0))[2][0]
    track = (centres - centres.mean(0)) @ axis
    want = {i: next((j for j in range(i + 1, 150) if abs(track[j] - track[i]) >= 50), None) for i in range(150)}
    assert dict(zip(got["frame"], got["later_frame"])) == {i: j for i, j in want.items() if j is not None}
    assert t.absolute_error(errors, ["rec"]).first()["ate_mm_rmse"] < 1e-6


def test_first_later_looks_far(spark):
    values = [0.0] * 900 + [100.0] + [0.0] * 50
    df = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate(values)], "r int, pos long, v double")
    got = {r["pos"]: r["later_pos"] for r in t.first_later(df, ["r"], "v", 60.0, 8).collect()}
    assert got == {**{k: 901 for k in range(1, 901)}, 901: 902}


def test_track_axes_and_components(spark):
    poses = trajectory(spark, 60, line(60)).withColumn("r", F.lit(1))
    axes = t.principal_axes(t.with_position(poses).select("r", "frame", *XYZ), ["r"]).first()
    np.testing.assert_allclose(axes["along"], [1, 0, 0], atol=1e-9)


def test_pose_round_trip(spark):
    rng = np.random.default_rng(11)
    poses = [pose(rng.normal(size=3) * 2, rng.normal(size=3)) for _ in range(20)] + [pose([np.pi, 0, 0], [1, 2, 3]), np.eye(4)]
    df = spark.createDataFrame([(k, p.ravel().tolist()) for k, p in enumerate(poses)], "k int, T array<double>")
    q = df.select("k", "T", g.pose_quaternion("T").alias("q")).select("k", "T", g.quaternion_pose([F.col("q")[i] for i in range(4)], [F.col("T")[3], F.col("T")[7], F.col("T")[11]]).alias("B"),
                                                                      g.compose("T", g.inverse("T")).alias("E"))
    for row in q.collect():
        np.testing.assert_allclose(row["B"], row["T"], atol=1e-9)
        np.testing.assert_allclose(np.array(row["E"]).reshape(4, 4), np.eye(4), atol=1e-9)


def test_starts_are_assessed_as_runs_of_their_own(spark):
    """Every start's verdict equals that of a plain assessment of the frames from it on; the frames' numbers have gaps."""
    rng = np.random.default_rng(12)
    numbers = sorted(rng.choice(400, 90, replace=False).tolist())
    rows = []
    for k, n in enumerate(numbers):
        pose = np.eye(4)
        pose[:3, 3] = [k * 3.0 + (60.0 if rng.random() < 0.2 else 0.0), 0, 0]
        rows.append((1, n, pose.ravel().tolist(), int(rng.random() < 0.15)))
    poses = spark.createDataFrame(rows, "rec long, frame long, T array<double>, lost int")
    got = {x["start"]: x for x in t.assess_starts(poses, poses, ["rec"], 10, 0.5).collect()}
    assert sorted(got) == [0, 10, 20, 30, 40]      # by the number of frames, not the largest
    for start, verdict in got.items():
        from_here = poses.where(poses.frame >= start)
        want = t.assess(from_here, from_here, ["rec"]).first()
        assert {c: verdict[c] for c in want.asDict()} == want.asDict()


def test_point_icp_copies_weigh_and_make_no_row_per_pair(spark):
    rng = np.random.default_rng(8)
    target = rng.uniform(0, 12, (400, 3))
    source = target[:150] + [0.2, -0.1, 0.05]
    source = np.vstack([source, np.repeat(source[:30] + [0.1, 0.1, 0], 3, 0), [[90.0, 90.0, 90.0]]])
    a, b = (spark.createDataFrame(pd.DataFrame(p, columns=["x", "y", "z"]).assign(k="s")) for p in (source, target))
    row = registration.icp(a, b, ["k"], 1.0, plane=False, iterations=1).first()

    def met(p):
        d = np.sqrt(((p[:, None] - target[None]) ** 2).sum(2))
        return d.min(1) <= 1.0, target[d.argmin(1)], d.min(1)

    near, to, _ = met(source)
    p, q = source[near], to[near]
    u, _, vt = np.linalg.svd((q - q.mean(0)).T @ (p - p.mean(0)))
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    moved = source @ turn.T + (q.mean(0) - turn @ p.mean(0))
    near, _, d = met(moved)
    assert row["fitness"] == pytest.approx(near.mean()) and row["inlier_rmse"] == pytest.approx(np.sqrt((d[near] ** 2).mean()), abs=1e-9)
    pairs = registration._matches(a.withColumn("T", registration.identity()), b, ["k"], False, 1.0)
    assert "Join" not in pairs._jdf.queryExecution().toString()
