"""Steps that bring points together in blocks of space: few bytes, and the same results as without."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions import blocks
from stratacloud.operators import neighbours as n

XYZ = ["x", "y", "z"]


def shuffled(spark):
    """Bytes this session has shuffled so far."""
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def lines(rng, size):
    """Points on whole x and z with copies, thin ones aside and a string of beads through several blocks."""
    p = np.c_[rng.integers(-9, 14, size), rng.uniform(-8, 30, size), rng.integers(0, 3, size) * 4.0]
    beads = np.c_[np.full(200, 40.0), np.linspace(-20, 30, 200), np.full(200, 1.5)]
    return np.vstack([p, p[:50], beads, rng.uniform(-20, 60, (200, 3)), np.repeat([[7.0, 7.0, 50.0]], 6, 0)])


@pytest.mark.parametrize("keys", [["k"], []])
def test_clusters_of_blocks_equal_those_of_trees(spark, keys, monkeypatch):
    rows = pd.DataFrame(lines(np.random.default_rng(3), 900), columns=XYZ).assign(k="a")
    rows = pd.concat([rows, rows[::2].assign(k="b", y=rows.y[::2] * 1.5)])
    points = spark.createDataFrame(rows).unionByName(spark.createDataFrame([(None, 1.0, 1.0, "a"), (2.0, float("nan"), 1.0, "b"), (1.0, 1.0, 1.0, None)], "x double, y double, z double, k string"))

    def found():
        return {tuple(map(str, r[:-1])): r[-1] for r in n.density_clusters(points, 1.3, 5, keys).select(*keys, *XYZ, "_w", "cluster").collect()}

    monkeypatch.setattr(n, "BLOCK_CELLS", (8,))
    many = found()
    assert len({v for v in many.values() if v is not None}) > 3 and None in many.values()
    monkeypatch.setattr(n, "CROWD", 0)
    assert found() == many


def test_clusters_move_few_bytes(spark):
    """A point has dozens of neighbours: it is moved a few times, not once for each pair of cells that touch."""
    rng = np.random.default_rng(4)
    p = np.c_[rng.integers(0, 20, 12_000), rng.uniform(0, 20, 12_000), rng.integers(0, 8, 12_000)].astype(float)
    points = spark.createDataFrame(pd.DataFrame(p, columns=XYZ).assign(k="a")).repartition(4).cache()
    assert points.count() == 12_000
    start = shuffled(spark)
    assert n.density_clusters(points, 1.6, 5, ["k"]).agg(F.sum("_w")).first()[0] == 12_000
    assert shuffled(spark) - start < 12_000 * 250


def test_object_places_count_the_points_of_the_object(spark):
    points = spark.createDataFrame(pd.DataFrame(lines(np.random.default_rng(5), 600), columns=XYZ).assign(k="a"))
    args = 2.0, 9.0, 4.2, 5, ["k"]
    assert n.object_places(points, *args).agg(F.sum("copies")).first()[0] == n.object_points(points, *args).count() > 100


def test_blocks_hold_what_lies_within_reach(spark):
    p = np.random.default_rng(6).uniform(-10, 10, (500, 3))
    points = spark.createDataFrame(pd.DataFrame(np.vstack([p, p[:100]]), columns=XYZ))
    rows = blocks.solved([blocks.deal(points, [], XYZ, 4.0, 1.5)], [], XYZ, lambda every, block: [len(every[0]), int(every[1].sum())], {"n": "bigint", "w": "bigint"}).collect()
    for row in rows:
        low = np.array(row[:3]) * 4.0
        inside = ((p >= low - 1.5) & (p <= low + 5.5)).all(1)
        assert (row["n"], row["w"]) == (inside.sum(), inside.sum() + inside[:100].sum())
    assert blocks.crowd(points, [], XYZ, 100.0) >= 600 / 8


def test_map_matched_equals_brute_force_and_moves_few_bytes(spark):
    """30 frames through several blocks, the map of a frame being its last 10 that are not lost."""
    rng = np.random.default_rng(8)
    rows = pd.DataFrame(np.c_[np.repeat(np.arange(30), 400), rng.uniform(0, 40, (12_000, 2)), rng.uniform(0, 9, 12_000)], columns=["frame", *XYZ]).astype({"frame": int})
    shift, lost = rng.uniform(-30, 30, (40, 3)), np.isin(np.arange(40), [3, 4, 17])
    poses = [[1.0, 0, 0, s[0], 0, 1.0, 0, s[1], 0, 0, 1.0, s[2], 0, 0, 0, 1.0] for s in shift.tolist()]
    frames = spark.createDataFrame([(f, [float(v) for v in poses[f]], int(lost[f])) for f in range(40)], "frame long, T array<double>, lost int")
    points = spark.createDataFrame(rows.assign(grey=0.0)).repartition(4).cache()
    assert points.count() == 12_000
    start = shuffled(spark)
    got = n.map_matched(points, frames, 1.0, 2.0, 10).toPandas()
    assert shuffled(spark) - start < 12_000 * 400

    def thin(p):
        return pd.DataFrame(p).groupby([np.floor(p[:, k] / 2.0) for k in range(3)]).mean().to_numpy()

    camera = {f: thin(g[XYZ].to_numpy()) for f, g in rows.groupby("frame")}
    good = [f for f in range(30) if not lost[f]]
    for f in range(30):
        mine = got[got.frame == f]
        assert len(mine) == len(camera[f])
        if lost[f]:
            assert mine.matched.isna().all()
            continue
        before = [r for r in good if r < f][-10:]
        if not before:
            assert mine.matched.all()
            continue
        target = thin(np.concatenate([camera[r] + shift[r] for r in before]))
        d = np.sqrt((((mine[XYZ].to_numpy() + shift[f])[:, None] - target[None]) ** 2).sum(2)).min(1)
        assert (mine.matched.to_numpy(bool) == (d <= 1.0)).all()


def test_discs_by_lines_equal_all_pairs():
    from stratacloud.functions.discs import Lines, few_lines

    rng = np.random.default_rng(9)
    for case in range(20):
        q = np.c_[rng.integers(0, 6, 400) * rng.choice([0.6, 1.0]), np.round(rng.uniform(0, 9, 400), 1 + case % 3)]
        z, w = rng.integers(0, 1 + 3 * case, 400).astype(float), rng.integers(1, 4, 400)
        z[rng.uniform(size=400) < 0.1 * (case % 3)] = np.nan
        p = np.vstack([q[:60] + [[1.2, 0]], q[:60], rng.uniform(-2, 11, (80, 2))])
        support, median = Lines(q, z, w, 1.2).around(p)
        assert few_lines(q) and not few_lines(p)
        inside = np.sqrt((p[:, 0, None] - q[None, :, 0]) ** 2 + (p[:, 1, None] - q[None, :, 1]) ** 2) <= 1.2
        assert (support == inside @ w).all()
        for row, m in zip(inside, median):
            met = np.repeat(z[row], w[row])
            met = met[~np.isnan(met)]
            assert np.isnan(m) if not len(met) else m == np.median(met)


def test_discs_by_lines_look_at_no_pairs():
    """100,000 points around each of 100,000 spots: the time must not hold their product."""
    import time

    from stratacloud.functions.discs import Lines

    rng = np.random.default_rng(10)
    q, p = (np.c_[rng.integers(0, 3, m), rng.uniform(0, 4, m)] for m in (300_000, 100_000))
    start = time.time()
    support, median = Lines(q, rng.integers(0, 11, len(q)).astype(float), np.ones(len(q), np.int64), 1.2).around(p)
    assert time.time() - start < 30 and support.max() > 100_000 and set(np.unique(median)) <= set(np.arange(0, 10.5, 0.5))
