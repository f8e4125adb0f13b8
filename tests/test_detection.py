import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratacloud.operators import detection as d
from stratacloud.operators import sync


def test_merge_precedence_and_conflict(spark):
    def quad(u):
        return [{"u": u + du, "v": dv} for du, dv in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]

    rows = [("r", 1, 3, quad(10.0)), ("gray", 1, 3, quad(10.4)), ("gray", 1, 4, quad(5.0)), ("b", 1, 4, quad(9.0)),
            ("gray", 1, 5, quad(1.0)), ("gray", 1, 5, quad(2.0)), ("b", 1, 5, quad(3.0)), ("gray", 1, 75, quad(1.0)), ("g", 1, 75, quad(60.0))]
    df = spark.createDataFrame(rows, "channel string, image int, tag int, quad array<struct<u:double,v:double>>")
    got = {g["tag"]: g for g in d.merge_channels(df, ["image"]).collect()}
    assert got[3]["channel"] == "gray" and not got[3]["conflict"]
    assert got[4]["conflict"] and not got[75]["conflict"]
    assert got[5]["channel"] == "b"
    assert d.merge_counts(d.merge_channels(df, ["image"]), ["image"]).first()["conflicts"] == 1


def brute_reject(keep, rows, residuals, min_tags):
    images = {}
    for i, t in keep:
        images.setdefault(i, set()).add(t)
    keep = {(i, t) for i, s in images.items() if len(s) >= min_tags for t in s}
    for _ in range(10):
        e = residuals(keep)
        limit = max(2.0, 5 * np.median([e[k][0] for k in keep]))
        close = {}
        for (i, t), (worst, _) in e.items():
            if worst <= limit:
                close.setdefault(i, []).append(t)
        rms = {i: np.sqrt(np.mean([e[i, t][1] for t in s])) for i, s in close.items() if len(s) >= min_tags}
        bound = max(1.0, 3 * np.median(list(rms.values())))
        new = {(i, t) for i, v in rms.items() if v <= bound for t in close[i]}
        if new == keep:
            break
        keep = new
    return keep


def test_reject_outliers_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    table = pd.DataFrame([(i, t, abs(rng.normal(scale=0.3)) + (9 if t == i % 12 and i < 6 else 0) + (3 if i == 13 else 0)) for i in range(20) for t in range(12)],
                         columns=["image", "tag", "e"])
    rows = spark.createDataFrame(table)

    def residuals(kept):
        shift = rows.join(kept, ["image", "tag"], "left_semi").agg(F.avg("e").alias("_m"))
        gap = F.abs(F.col("e") - F.col("_m"))
        return rows.crossJoin(shift).select("image", "tag", gap.alias("worst"), (gap * gap).alias("mean_square"))

    def plain(keep):
        m = np.mean([e for i, t, e in table.itertuples(index=False) if (i, t) in keep])
        return {(i, t): (abs(e - m), (e - m) ** 2) for i, t, e in table.itertuples(index=False)}

    kept, log = d.reject_outliers(rows.select("image", "tag"), residuals, 8)
    want = brute_reject({(i, t) for i, t, _ in table.itertuples(index=False)}, table, plain, 8)
    assert {(k["image"], k["tag"]) for k in kept.collect()} == want
    assert log.count() >= 2 and 13 not in {i for i, _ in want}


def test_best_setting_and_search(spark):
    scores = spark.createDataFrame([("a", 50, 3, 0, 9, 0.001, False), ("b", 60, 0, 9, 9, 0.2, True), ("c", 50, 1, 0, 8, 0.001, False)],
                                   "setting string, board_tags long, duplicates long, false_ids long, usable_images long, bad_rate double, refused boolean")
    assert d.best_setting(scores).first()["setting"] == "c"
    runs = []

    def score(candidates):
        runs.append(len(candidates))
        return {d.settings_key(c): (-4 * (c["x"] - 3) ** 2 - (c["y"] - c["x"]) ** 2, c["x"] == 9) for c in candidates}

    best, log = d.coordinate_descent({"x": 0, "y": 0}, {"x": [0, 1, 2, 3, 9], "y": [0, 1, 2, 3]}, score, 10)
    assert best == {"x": 3, "y": 3} and len(log) > 9
    assert sum(runs) <= 20      # known settings are not scored again
    won = [t for t in log if t["accepted"]]
    assert won[-1]["settings"] == best and len({(t["round"], t["axis"]) for t in won}) == len(won)

    def gains(candidates):
        return {d.settings_key(c): ((c["x"], 0), False) for c in candidates}

    assert d.coordinate_descent({"x": 0}, {"x": [1, 2]}, gains, 3, 2)[0] == {"x": 2}
    assert d.coordinate_descent({"x": 0}, {"x": [1, 2]}, gains, 3, 3)[0] == {"x": 0}


def pixels(spark, images):
    rows = [(name, i, j, float(v)) for name, image in images.items() for i, line in enumerate(image) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame string, row_ long, col_ long, v double")


def test_sharpness_and_noise(spark):
    board = np.where((np.add.outer(np.arange(60) // 10, np.arange(60) // 10) % 2) == 0, 60.0, 200.0)

    def blurred(image, sigma):
        k = np.exp(-0.5 * (np.arange(-3 * sigma, 3 * sigma + 1) / sigma) ** 2)
        k /= k.sum()
        pad = np.pad(image, 3 * sigma, mode="reflect")
        return np.apply_along_axis(lambda r: np.convolve(r, k, "valid"), 1, np.apply_along_axis(lambda r: np.convolve(r, k, "valid"), 0, pad))

    rng = np.random.default_rng(0)
    images = {"0": board, "1": blurred(board, 1), "2": blurred(board, 2), "n5": np.full((80, 80), 100.0) + rng.normal(scale=5, size=(80, 80)), "flat": np.full((20, 20), 9.0)}
    df = pixels(spark, images)
    score = {r["frame"]: r["score"] for r in sync.sharpness(df).collect()}
    assert score["0"] > score["1"] > score["2"]
    padded = np.pad(board, 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * board
    np.testing.assert_allclose(score["0"], lap.var())
    noise = {r["frame"]: r["noise"] for r in sync.noise_sigma(df).collect()}
    assert abs(noise["n5"] - 5) < 0.75 and noise["flat"] < 1e-9


def test_nearest_in_time_with_small_buckets(spark):
    rng = np.random.default_rng(1)
    left, right = np.sort(rng.integers(0, 100_000, 300)), np.sort(rng.integers(0, 100_000, 200))
    right[:40] = right[0]
    a = spark.createDataFrame([(int(v), k) for k, v in enumerate(left)], "pts_ns long, frame long")
    b = spark.createDataFrame([(int(v), k) for k, v in enumerate(right)], "pts_ns long, frame long")
    for width in (50, 10**9):
        got = {r["frame"]: r["left_pts_ns"] for r in sync.nearest_in_time(b, a, [], "pts_ns", "frame", width).collect()}
        for k, v in enumerate(right):
            gaps = np.abs(left - v)
            assert got[k] == left[gaps == gaps.min()].min()
