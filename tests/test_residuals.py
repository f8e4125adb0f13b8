import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions.columns import count_if
from stratacloud.functions.geometry import normalised_radius
from stratacloud.operators import residuals as r

PP, SIZE, RADII = (800.0, 600.0), (1600.0, 1200.0), (0.33, 0.66)


def circles(spark):
    rows = []
    for k in range(1, 10):
        for a in np.linspace(0, 2 * np.pi, 36, endpoint=False):
            size = 0.2 if k / 10 < 0.33 else 0.5 if k / 10 < 0.66 else 1.2
            rows.append((800 + 100 * k * math.cos(a), 600 + 100 * k * math.sin(a), size * 0.6, size * 0.8))
    df = spark.createDataFrame(rows, "u double, v double, du double, dv double")
    return df.withColumn("r", normalised_radius("u", "v", PP, SIZE)).withColumn("k", F.lit(1))


def test_radius_and_zones(spark):
    row = r.zone_rms(circles(spark), ["k"], RADII).first()
    assert row["rms_centre"] == pytest.approx(0.2) and row["rms_mid"] == pytest.approx(0.5) and row["rms_outer"] == pytest.approx(1.2)
    assert row["outer_to_centre"] == pytest.approx(6.0) and row["mid_to_centre"] == pytest.approx(2.5)
    assert (row["n_centre"], row["n_mid"], row["n_outer"]) == (108, 108, 108)


def test_zone_edges_and_bad_radii(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.329, 0.33, 0.659, 0.66, 1.0)], "r double")
    assert [x["z"] for x in df.select(r.zone("r", RADII).alias("z")).collect()] == [0, 0, 1, 1, 2, 2]
    for bad in ((0.5, 0.3), (0, 0.5), (0.4, 0.4)):
        with pytest.raises(ValueError):
            r.zone("r", bad)


def test_empty_zone_is_null(spark):
    row = r.zone_rms(circles(spark).where("r > 0.5"), ["k"], RADII).first()
    assert row["rms_centre"] is None and row["outer_to_centre"] is None and row["n_centre"] == 0


def test_binned_profile(spark):
    rows = [(x, float(d), 0.0) for x, d in ((0.05, 1), (0.15, 2), (0.25, 3)) for _ in range(10)] + [(5.0, 9.0, 0.0), (0.35, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, du double, dv double").withColumn("k", F.lit(1))
    got = r.binned_rms(df, ["k"], "x", [0.0, 0.1, 0.2, 0.3, 0.4], 2).orderBy("bin").collect()
    assert [g["rms"] for g in got] == [1.0, 2.0, 3.0, None]
    assert [g["n"] for g in got] == [10, 10, 10, 1]
    assert [g["centre"] for g in got] == pytest.approx([0.05, 0.15, 0.25, 0.35])


def test_image_grid(spark):
    rows = []
    for i in range(4):
        for j in range(3):
            rows += [(400 * i + 20.0 + k, 400 * j + 30.0, 0.3, -0.4) for k in range(3 if (i, j) == (3, 2) else 10)]
    rows += [(1599.9, 1199.9, 0.3, -0.4), (1600.0, 5.0, 9.0, 9.0), (-1.0, 5.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "u double, v double, du double, dv double").withColumn("k", F.lit(1))
    got = {(g["row_"], g["col_"]): g for g in r.grid_stats(df, ["k"], SIZE, (4, 3)).collect()}
    assert len(got) == 12 and sum(g["n"] for g in got.values()) == 114
    assert got[0, 0]["mean_error"] == pytest.approx(0.5) and got[0, 0]["mean_dv"] == pytest.approx(-0.4)
    assert not got[2, 3]["valid"] and got[2, 3]["mean_error"] is None and got[2, 3]["n"] == 4


def test_interval_and_pairs(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, float("nan")), (1, 3.0)], "k int, value double")
    row = r.split_interval(df, ["k"]).first()
    assert row["mean"] == 2.0 and row["n"] == 3
    base = np.linspace(0.2, 0.4, 28)
    shifts = {"a": base, "b": base - 0.02, "c": base + 0.01 * np.where(np.arange(28) % 2, 1, -1)}
    rows = [(s, t, "left", float(v)) for t, values in shifts.items() for s, v in enumerate(values)]
    table = spark.createDataFrame(rows, "split int, technique string, camera string, rms double")
    got = {(g["a"], g["b"]): g for g in r.paired_comparison(table, ("rms",)).collect()}
    assert got["a", "b"]["within_noise"] is False and got["a", "b"]["mean"] == pytest.approx(0.02)
    assert got["a", "c"]["within_noise"] is True


def test_leave_groups_out(spark):
    groups = spark.createDataFrame([(g,) for g in "cabdda"], "group string")
    got = r.leave_groups_out(groups, 2).orderBy("split").collect()
    assert [tuple(g["test"]) for g in got] == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    for bad in (0, 4):
        with pytest.raises(ValueError):
            r.leave_groups_out(groups, bad)


def test_scale_bars_brute_force(spark):
    rng = np.random.default_rng(0)
    true = rng.uniform(0, 300, (60, 3))
    seen = true * 1.01
    df = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(60), true, seen], columns=["corner", "ox", "oy", "oz", "x", "y", "z"]).assign(k=1))
    d = np.sqrt(((true[:, None] - true[None]) ** 2).sum(2))[np.triu_indices(60, 1)]
    sel = d[(d >= 40) & (d <= 90)]
    row = r.scale_bars(df, ["k"], (40.0, 90.0)).first()
    assert row["bars"] == len(sel) and row["length_bias_mm"] == pytest.approx((0.01 * sel).mean()) and row["length_bias_pct"] == pytest.approx(1.0)


def test_counts_helper(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert df.agg(count_if(F.col("v") > 1).alias("n")).first()["n"] == 1


def test_training_means_equal_means_of_training_rows(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(d), None if rng.random() < 0.1 else float(v)) for g, d, v in zip(rng.integers(0, 7, 400), rng.uniform(0, 1000, 400), rng.normal(size=400))]
    frame = spark.createDataFrame(rows, "group long, distance_mm double, v double")
    splits = r.leave_groups_out(frame, 3)
    got = {x["split"]: x for x in r.training_means(frame, splits, ["v"], band=(200.0, 800.0)).collect()}
    assert len(got) == 35
    for split in splits.collect():
        mine = [(g, d, v) for g, d, v in rows if g not in split["test"] and 200 <= d < 800]
        assert got[split["split"]]["n"] == len(mine)
        assert got[split["split"]]["v"] == pytest.approx(np.mean([v for *_, v in mine if v is not None]))
