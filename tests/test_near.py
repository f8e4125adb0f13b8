import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions import near
from stratacloud.operators import neighbours as n

XYZ = ["x", "y", "z"]


def cloud(rng, size, hot):
    """A third of the points in one tiny ball, exact copies among them."""
    third = size // 3
    ball = rng.normal(scale=1e-3, size=(third, 3)) + 5
    ball[: third // 2] = ball[0]
    return np.vstack([ball if hot else rng.uniform(0, 20, (third, 3)), rng.uniform(0, 20, (size - third, 3))])


def frame(spark, points, key="k"):
    return spark.createDataFrame(pd.DataFrame(points, columns=XYZ).assign(k=key))


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))


@pytest.mark.parametrize("hot,leaf", [(False, 32), (True, 4)])
def test_nearest_without_limit(spark, hot, leaf):
    rng = np.random.default_rng(1)
    a, b = cloud(rng, 300, hot), cloud(rng, 400, hot)
    got = near.nearest(frame(spark, a), frame(spark, b), ["k"], XYZ, leaf=leaf).toPandas()
    found = {tuple(r[:3]): r[3] for r in got[[*XYZ, "d"]].itertuples(index=False)}
    want = distances(a, b).min(1)
    assert len(found) == len({tuple(p) for p in a})
    for p, d in zip(a, want):
        assert found[tuple(p)] == pytest.approx(d, abs=1e-12)


@pytest.mark.parametrize("leaf", [32, 4])
def test_k_nearest_counts_copies(spark, leaf):
    rng = np.random.default_rng(2)
    a = cloud(rng, 240, True)
    got = n.neighbour_distance(frame(spark, a), 20, ["k"], leaf).toPandas()
    found = {tuple(r[:3]): r[3] for r in got[[*XYZ, "mean_d"]].itertuples(index=False)}
    want = np.sort(distances(a, a), 1)[:, :20].mean(1)
    for p, d in zip(a, want):
        assert found[tuple(p)] == pytest.approx(d, abs=1e-9)


@pytest.mark.parametrize("leaf,k", [(32, 1), (4, 1), (4, 12)])
def test_exists(spark, leaf, k):
    rng = np.random.default_rng(3)
    a, b = cloud(rng, 300, True), cloud(rng, 300, True)
    got = near.exists(frame(spark, a), frame(spark, b), ["k"], XYZ, 1.1, k, leaf).toPandas()
    want = {tuple(p) for p, row in zip(a, distances(a, b)) if (row <= 1.1).sum() >= k}
    assert {tuple(r) for r in got[XYZ].itertuples(index=False)} == want


def brute_clusters(points, eps, min_points):
    d = distances(points, points)
    core = (d <= eps).sum(1) >= min_points
    label = np.full(len(points), -1)
    current = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = current
        while stack:
            for j in np.flatnonzero(core & (d[stack.pop()] <= eps) & (label < 0)):
                label[j] = current
                stack.append(j)
        current += 1
    return core, label, d


@pytest.mark.parametrize("leaf", [32, 4])
def test_density_clusters(spark, leaf):
    rng = np.random.default_rng(4)
    a = np.vstack([rng.normal(scale=0.4, size=(120, 3)), rng.normal(scale=0.4, size=(90, 3)) + 4, rng.uniform(-3, 8, (60, 3)),
                   np.repeat([[1.0, 1.0, 9.0]], 30, 0)])
    core, label, d = brute_clusters(a, 0.5, 6)
    got = n.density_clusters(frame(spark, a), 0.5, 6, ["k"], leaf).toPandas()
    mine = {tuple(r[:3]): r[3] for r in got[[*XYZ, "cluster"]].itertuples(index=False)}
    pairing = {}
    for p, c, lab in zip(a, core, label):
        if c:
            assert pairing.setdefault(lab, mine[tuple(p)]) == mine[tuple(p)]
    assert len(set(pairing.values())) == len(pairing)
    for i, p in enumerate(a):
        if not core[i]:
            reach = np.flatnonzero(core & (d[i] <= 0.5))
            value = mine[tuple(p)]
            if len(reach):
                assert value in {pairing[label[j]] for j in reach}
            else:
                assert value is None or np.isnan(value)


def test_normals_against_numpy(spark):
    rng = np.random.default_rng(5)
    a = np.c_[rng.uniform(0, 10, (250, 2)), np.zeros(250)]
    a[:, 2] = 0.3 * a[:, 0] - 0.2 * a[:, 1] + rng.normal(scale=0.02, size=250)
    got = n.estimate_normals(frame(spark, a), 1.5, 30, ["k"]).toPandas()
    d = distances(a, a)
    index = {tuple(p): i for i, p in enumerate(a)}
    for r in got.itertuples(index=False):
        i = index[(r.x, r.y, r.z)]
        order = np.argsort(d[i], kind="stable")[:30]
        p = a[order[d[i][order] <= 1.5]]
        if len(p) < 3:
            continue
        v = np.linalg.svd(p - p.mean(0))[2][2]
        assert abs(v @ [r.nx, r.ny, r.nz]) == pytest.approx(1, abs=1e-6)
        assert r.nz >= 0


def triangles(spark):
    rows = []
    for i in range(20):
        for j in range(20):
            z = lambda x, y: float(np.sin(x / 3) + np.cos(y / 4))
            p = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            for k, (a, b, c) in enumerate(((0, 1, 2), (0, 2, 3))):
                rows.append([i * 100 + j * 2 + k] + [v for q in (a, b, c) for v in (float(p[q][0]), float(p[q][1]), z(*p[q]))])
    return spark.createDataFrame(pd.DataFrame(rows, columns=["tri", *n.CORNERS]).astype({"tri": "int64"}))


def closest_by_hand(p, corners):
    """Distance of a point to a triangle by the barycentric coordinates of its foot, else to the edges."""
    a, b, c = corners
    best = np.inf
    u = np.linalg.lstsq(np.c_[b - a, c - a], p - a, rcond=None)[0]
    if (u >= 0).all() and u.sum() <= 1:
        best = np.linalg.norm(a + u[0] * (b - a) + u[1] * (c - a) - p)
    for s, e in ((a, b), (b, c), (c, a)):
        t = np.clip((p - s) @ (e - s) / ((e - s) @ (e - s)), 0, 1)
        best = min(best, np.linalg.norm(s + t * (e - s) - p))
    return best


@pytest.mark.parametrize("huge", [False, True])
def test_closest_on_mesh(spark, huge):
    rng = np.random.default_rng(6)
    places = np.r_[np.c_[rng.uniform(-5, 25, (90, 2)), rng.uniform(-6, 9, 90)], rng.uniform(-900, 900, (30, 3))]
    points = frame(spark, np.r_[places, places[:5]])
    mesh = triangles(spark)
    if huge:    # one triangle a thousand times as wide as the others, across all of them
        mesh = mesh.unionByName(spark.createDataFrame([(9_000_000, -800.0, -700.0, -3.0, 900.0, -600.0, 4.0, 0.0, 990.0, 2.0)], mesh.schema))
    got = n.closest_on_mesh(points, mesh, ["k"]).toPandas()
    tri = mesh.toPandas()[n.CORNERS].to_numpy().reshape(-1, 3, 3)
    assert len(got) == 120
    for r in got.itertuples(index=False):
        p = np.array([r.x, r.y, r.z])
        assert r.distance == pytest.approx(min(closest_by_hand(p, t) for t in tri), abs=1e-9)
        assert r.distance == pytest.approx(np.linalg.norm(p - [r.qx, r.qy, r.qz]), abs=1e-9)


def test_closest_on_mesh_sends_no_row_per_point_and_box(spark):
    """Points meet the mesh inside their leaves: no join of points is left. A missing key is a key of its own."""
    rng = np.random.default_rng(11)
    places = frame(spark, rng.uniform(-2, 22, (1500, 3)))
    points = places.unionByName(places.limit(40).withColumn("k", F.lit(None).cast(dict(places.dtypes)["k"])))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = n.closest_on_mesh(places.where("k IS NOT NULL"), triangles(spark), ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = n.closest_on_mesh(points, triangles(spark), ["k"]).toPandas()
    assert len(got) == 1540 and got["k"].isna().sum() == 40
    by_place = got.groupby(XYZ)["distance"].agg(["min", "max"])
    assert (by_place["min"] == by_place["max"]).all()


def test_crowded_left_cell_makes_no_large_group(spark):
    """Half of the left points in a ball far smaller than the rest, all with the same few right points."""
    from stratacloud.functions import boxes

    rng = np.random.default_rng(8)
    left = np.r_[rng.normal(scale=1e-4, size=(3000, 3)), rng.uniform(-50, 50, (3000, 3))]
    right = np.r_[rng.uniform(-60, 60, (40, 3)), [[1.0, 0, 0]]]
    mine, theirs = near._trees(frame(spark, left), frame(spark, right), ["k"], XYZ, boxes.LEAF, 1)
    assert mine.leaves.agg({"_weight": "max"}).first()[0] <= boxes.LEAF
    got = near.nearest(frame(spark, left), frame(spark, right), ["k"], XYZ).toPandas()
    np.testing.assert_allclose(np.sort(got["d"]), np.sort(distances(left, right).min(1)), atol=1e-12)


def test_empty_sides_and_missing_coordinates(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (1, 5.0, 5.0, 5.0)], "k long, x double, y double, z double")
    none = rows.where("false")
    assert near.nearest(rows, none, ["k"], XYZ).count() == near.nearest(none, rows, ["k"], XYZ).count() == 0
    assert near.exists(rows, none, ["k"], XYZ, 1.0).count() == 0
    assert sorted(r["d"] for r in near.nearest(rows, rows, ["k"], XYZ, 3).collect()) == [0.0, 0.0]
    assert near.nearest(rows, rows.where("k = 1"), [], XYZ, limit=1.0).count() == 1


def test_surface_samples(spark):
    mesh = triangles(spark)
    got = n.sample_surface(mesh, 20.0, 1000).toPandas()
    area = n.with_normals(mesh).toPandas().set_index("tri")["area"]
    assert len(got) == pytest.approx(20 * area.sum(), rel=0.02)
    back = n.closest_on_mesh(spark.createDataFrame(got.head(200)[XYZ]), mesh).toPandas()
    assert back["distance"].max() < 1e-9
    again = n.sample_surface(mesh, 20.0, 1000).toPandas()
    assert set(map(tuple, got[XYZ].to_numpy())) == set(map(tuple, again[XYZ].to_numpy()))


def test_facets(spark):
    def tri(k, *p):
        return [k, *[float(v) for q in p for v in q]]

    rows = [tri(0, (0, 0, 0), (1, 0, 0), (0, 1, 0)), tri(1, (1, 0, 0), (1, 1, 0), (0, 1, 0)), tri(2, (0, 0, 0), (0, 0, 1), (1, 0, 0)),
            tri(3, (5, 0, 0), (6, 0, 0.02), (5, 1, 0))]
    mesh = spark.createDataFrame(pd.DataFrame(rows, columns=["tri", *n.CORNERS]).astype({"tri": "int64"}))
    facet = {r["tri"]: r["facet"] for r in n.facet_labels(mesh, 5.0).collect()}
    assert facet == {0: 0, 1: 0, 2: 1, 3: 0}


def test_map_matched(spark):
    rng = np.random.default_rng(7)
    base = rng.uniform(0, 30, (80, 3))
    rows = [(f, *p, 0.0) for f in range(5) for p in (base + [0, 0, 0.1 * f] if f != 3 else base + 500)]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["frame", *XYZ, "grey"]))
    eye = [float(k % 5 == 0) for k in range(16)]
    frames = spark.createDataFrame([(f, eye, int(f == 3)) for f in range(5)], "frame long, T array<double>, lost int")
    got = n.map_matched(points, frames, 1.0, 0.5, 2).toPandas()
    share = got.dropna(subset=["matched"]).groupby("frame")["matched"].mean()
    assert share[0] == 1 and share[1] == 1 and share[4] == 1
    assert got[got.frame == 3]["matched"].isna().all()


def shuffled(spark):
    """Bytes this session has shuffled so far."""
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def test_nearest_moves_no_row_per_pair(spark):
    """30 neighbours each: candidates meet as arrays, so bytes moved stay near those of the points and not of the pairs."""
    rng = np.random.default_rng(11)
    points = frame(spark, rng.uniform(0, 20, (8000, 3))).repartition(4).cache()
    assert points.count() == 8000
    start = shuffled(spark)
    assert n.estimate_normals(points, 5.0, 30, ["k"]).count() == 8000
    assert shuffled(spark) - start < 8000 * 400


def test_ties_take_the_smaller_coordinates(spark):
    right = [(1.0, 0, 0), (-1.0, 0, 0), (0, 1.0, 0), (0, -1.0, 0), (0, 0, 1.0), (0, 0, -1.0)]
    for leaf in (512, 2):
        got = near.nearest(frame(spark, [(0.0, 0.0, 0.0)]), frame(spark, right), ["k"], XYZ, 2, leaf=leaf).collect()
        assert sorted((r["n_x"], r["n_y"], r["n_z"]) for r in got) == [(-1.0, 0.0, 0.0), (0.0, -1.0, 0.0)]


def test_touching_groups_of_any_size(spark, monkeypatch):
    """Groups of few pairs and larger ones tell the same."""
    rng = np.random.default_rng(12)
    rows = [pd.DataFrame(rng.uniform(0, 3, (40, 3)), columns=XYZ).assign(a=rng.integers(0, 4, 40), b=rng.integers(4, 7, 40)) for _ in "po"]
    probes, others = (spark.createDataFrame(r) for r in rows)
    met = rows[0].merge(rows[1], on=["a", "b"])
    near_by = ((met[["x_x", "y_x", "z_x"]].to_numpy() - met[["x_y", "y_y", "z_y"]].to_numpy()) ** 2).sum(1) <= 0.64
    want = {tuple(r) for r in met.loc[near_by, ["a", "b"]].itertuples(index=False)}
    for few in (0, 12, 4096):
        monkeypatch.setattr(n, "FEW_PAIRS", few)
        got = n._touching(probes, others, ["a", "b"], 0.8, 32).collect()
        assert {tuple(r) for r in got} == want and 0 < len(want) < 12


def test_cross_check_equals_brute_force_without_a_row_per_pair(spark):
    from stratacloud.operators import neighbours

    rng = np.random.default_rng(11)
    sparse = np.c_[rng.uniform(0, 6, (300, 2)), rng.integers(0, 9, 300)].astype(float)
    sparse = np.vstack([sparse, sparse[:80], sparse[:80]])
    dense = np.vstack([rng.uniform(-3, 8, (200, 2)), sparse[:40, :2] + [1.2, 0]])
    dense = np.c_[dense, rng.uniform(0, 9, len(dense))]
    frames = [spark.createDataFrame(pd.DataFrame(p, columns=["x", "y", "z"]).assign(k="a")) for p in (sparse, dense)]
    checked = neighbours.cross_check(*frames, ["k"], 1.2, 5, 2.0)
    got = {(r["x"], r["y"], r["z"]): (r["support"], r["verdict"]) for r in checked.collect()}
    for x, y, z in dense:
        met = sparse[np.sqrt((sparse[:, 0] - x) ** 2 + (sparse[:, 1] - y) ** 2) <= 1.2, 2]
        want = "unchecked" if len(met) < 5 else "agree" if abs(z - np.median(met)) <= 2 else "disagree"
        assert got[(x, y, z)] == (len(met), want)
    assert "CoGroup" in checked._jdf.queryExecution().toString()
