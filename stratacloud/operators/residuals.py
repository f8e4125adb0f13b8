"""Residual statistics and resampling over held-out groups.

Residual rows: split, technique, camera, frame, u, v, du, dv, r (normalised radius), frame_distance_mm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.columns import col, not_nan, norm, rms_if
from stratacloud.functions.quantiles import with_quantiles
from stratacloud.session import cut_lineage

SQUARED = "du * du + dv * dv"

# Zone names, distance bands in mm and the interval of a resampled metric.
ZONES = ("centre", "mid", "outer")
BANDS = {"near": (200.0, 800.0), "far": (1000.0, 1500.0)}
INTERVAL = (0.025, 0.975)


def leave_groups_out(groups: DataFrame, k: int, column: str = "group") -> DataFrame:
    """Every choice of k of the distinct groups, indexed in sorted order: split, and the held-out groups as an array.

    The list of groups (recordings) is counted first; the result has n-choose-k rows by definition."""
    names = groups.select(F.col(column).alias("_g")).distinct()
    n = names.count()
    if not 0 < k < n:
        raise ValueError(f"k must lie strictly between 0 and the {n} groups, got {k}")
    chosen = names.select(F.array("_g").alias("test"))
    for _ in range(k - 1):
        chosen = chosen.join(names, F.element_at("test", -1) < F.col("_g")).select(
            F.concat("test", F.array("_g")).alias("test"))
    # n-choose-k rows, one number each: the plan of the experiment, not data
    return chosen.select((F.row_number().over(Window.orderBy("test")) - 1).cast("long").alias("split"), "test")


def training_rows(rows: DataFrame, splits: DataFrame, column: str = "group", band: tuple | None = None,
                  distance: str = "distance_mm") -> DataFrame:
    """Rows of every split whose group is not held out and whose distance lies in the half-open band."""
    kept = rows if band is None else rows.where((F.col(distance) >= band[0]) & (F.col(distance) < band[1]))
    return kept.join(splits.select("split", "test"), ~F.array_contains("test", F.col(column))).drop("test")


def training_means(rows: DataFrame, splits: DataFrame, values: list[str], column: str = "group", band: tuple | None = None,
                   distance: str = "distance_mm") -> DataFrame:
    """Per split the count and the means of values over its training rows (as training_rows), without a row per row and
    split: every group is summed once, and a split's sums are all rows' sums minus those of its held-out groups."""
    kept = rows if band is None else rows.where((F.col(distance) >= band[0]) & (F.col(distance) < band[1]))
    counts = {v: f"_n_{v}" for v in values}
    sums = [F.count("*").alias("n"), *[F.sum(v).alias(f"_s_{v}") for v in values], *[F.count(v).alias(c) for v, c in counts.items()]]
    names = ["n", *[f"_s_{v}" for v in values], *counts.values()]
    groups = cut_lineage(kept.groupBy(column).agg(*sums))
    # rows of no group are in no split: a null group is neither held out nor known not to be
    whole = groups.where(F.col(column).isNotNull()).agg(*[F.sum(n).alias(f"_all{n}") for n in names])
    held = (splits.select("split", F.explode("test").alias(column)).join(groups, column, "left").groupBy("split")
            .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))
    left = {n: F.coalesce(F.col(f"_all{n}"), F.lit(0)) - F.col(n) for n in names}
    return held.crossJoin(F.broadcast(whole)).select("split", left["n"].alias("n"), *[      # one row
        F.try_divide(left[f"_s_{v}"], left[counts[v]]).alias(v) for v in values]).where("n > 0")


def residual_rms(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.expr(SQUARED))).alias("rms"), F.count("*").alias("n"))


def zone(r: Column | str, radii: tuple) -> Column:
    """Zone index: a boundary belongs to the outer zone."""
    if not 0 < radii[0] < radii[1]:
        raise ValueError(f"zone radii must satisfy 0 < r1 < r2, got {radii}")
    return F.when(col(r) < radii[0], 0).when(col(r) < radii[1], 1).otherwise(2)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def zone_rms(rows: DataFrame, keys: list[str], radii: tuple) -> DataFrame:
    """Per key: RMS and count of every radial zone (null RMS where empty) and the ratios to the centre."""
    zoned = rows.withColumns({"_z": zone("r", radii), "_e2": F.expr(SQUARED)})
    out = zoned.groupBy(*keys).agg(
        *[rms_if(F.col("_z") == k, F.col("_e2")).alias(f"rms_{n}") for k, n in enumerate(ZONES)],
        *[F.count(F.when(F.col("_z") == k, 1)).alias(f"n_{n}") for k, n in enumerate(ZONES)])
    return out.withColumns({f"{n}_to_centre": _ratio(f"rms_{n}", "rms_centre") for n in ("mid", "outer")})


def bin_index(x: Column | str, edges: list[float]) -> Column:
    """Index of the half-open bin of x; null outside the edges."""
    x = col(x)
    inside = (x >= edges[0]) & (x < edges[-1])
    return F.when(inside, F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1).cast("long")


def bin_table(keys_of: DataFrame, edges: list[float]) -> DataFrame:
    bins = F.array(*[F.struct(F.lit(k).cast("long").alias("bin"), F.lit(0.5 * (a + b)).alias("centre"))
                     for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    return keys_of.withColumn("_b", F.explode(bins)).select(*keys_of.columns, "_b.*")


def binned_rms(rows: DataFrame, keys: list[str], x: str, edges: list[float], min_count: int = 1) -> DataFrame:
    """RMS profile over bins of x: every key and bin has a row; rms is null below min_count, n is always given."""
    found = (rows.withColumn("bin", bin_index(x, edges)).where(F.col("bin").isNotNull())
             .groupBy(*keys, "bin").agg(F.sqrt(F.avg(F.expr(SQUARED))).alias("_rms"), F.count("*").alias("_n")))
    grid = bin_table(rows.select(*keys).distinct(), edges) if keys else bin_table(rows.limit(1).select(), edges)
    n = F.coalesce("_n", F.lit(0).cast("long"))
    return grid.join(found, [*keys, "bin"], "left").select(
        *keys, "bin", "centre", F.when(n >= max(min_count, 1), F.col("_rms")).alias("rms"), n.alias("n"))


def grid_stats(rows: DataFrame, keys: list[str], size: tuple, cells: tuple, min_count: int = 5) -> DataFrame:
    """Residuals gathered in a grid over the image: mean length, mean du and dv per cell, count, validity. Points
    outside the image are left out; the far edge falls in the last cell. Every cell has a row."""
    (w, h), (nx, ny) = size, cells
    inside = (F.col("u") >= 0) & (F.col("u") < w) & (F.col("v") >= 0) & (F.col("v") < h)
    placed = rows.where(inside).select(
        *keys, F.least(F.floor(F.col("u") * nx / w), F.lit(nx - 1)).cast("long").alias("col_"),
        F.least(F.floor(F.col("v") * ny / h), F.lit(ny - 1)).cast("long").alias("row_"), "du", "dv")
    found = placed.groupBy(*keys, "row_", "col_").agg(
        F.avg(norm(F.col("du"), F.col("dv"))).alias("_e"), F.avg("du").alias("_du"), F.avg("dv").alias("_dv"), F.count("*").alias("_n"))
    grid = (rows.select(*keys).distinct()
            .withColumn("row_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long"))))
            .withColumn("col_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long")))))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    valid = n >= min_count
    return grid.join(found, [*keys, "row_", "col_"], "left").select(
        *keys, "row_", "col_", F.when(valid, F.col("_e")).alias("mean_error"), F.when(valid, F.col("_du")).alias("mean_du"),
        F.when(valid, F.col("_dv")).alias("mean_dv"), n.alias("n"), valid.alias("valid"))


def corner_bars(corners: DataFrame, keys: list[str], band: tuple) -> DataFrame:
    """All corner pairs (a < b by id) of a group whose true distance lies in the closed band: true and measured length.

    Corners: keys, corner, true position ox, oy, oz, measured x, y, z. True positions are gathered in cells as wide as
    the band's upper end, so a corner only meets corners of the neighbouring cells, spread over as many tasks as there
    are cells, however large a group is."""
    low, high = band
    size = float(high)
    grid = [F.floor(F.col(f"o{a}") / size).cast("long").alias(f"g{a}") for a in "xyz"]
    placed = corners.select(*keys, "corner", "ox", "oy", "oz", "x", "y", "z", *grid)
    steps = F.array(*[F.struct(*[F.lit(s).alias(n) for n, s in zip("xyz", (i, j, k))])
                      for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    asked = placed.withColumn("_s", F.explode(steps)).select(
        *keys, *[F.col(c).alias(f"a_{c}") for c in ("corner", "ox", "oy", "oz", "x", "y", "z")],
        *[(F.col(f"g{a}") + F.col(f"_s.{a}")).alias(f"g{a}") for a in "xyz"])
    pairs = asked.join(placed, [*keys, "gx", "gy", "gz"]).where(F.col("a_corner") < F.col("corner"))
    true = norm(*[F.col(f"a_o{a}") - F.col(f"o{a}") for a in "xyz"])
    seen = norm(*[F.col(f"a_{a}") - F.col(a) for a in "xyz"])
    return pairs.select(*keys, true.alias("true_mm"), seen.alias("seen_mm")).where(F.col("true_mm").between(low, high))


def scale_bars(corners: DataFrame, keys: list[str], band: tuple) -> DataFrame:
    """Length error of the bars per group: bias, RMS, percent bias and number of bars."""
    error = F.col("seen_mm") - F.col("true_mm")
    return corner_bars(corners, keys, band).groupBy(*keys).agg(
        F.avg(error).alias("length_bias_mm"), F.sqrt(F.avg(error * error)).alias("length_rms_mm"),
        F.avg(F.try_divide(error, F.col("true_mm")) * 100).alias("length_bias_pct"), F.count("*").alias("bars"))


CAMERA_METRICS = ("rms", "rms_centre", "rms_mid", "rms_outer", "mid_to_centre", "outer_to_centre", "rms_near", "rms_far",
                  "far_to_near", "rms_near_centre", "rms_far_centre", "far_to_near_centre")


def camera_metrics(rows: DataFrame, radii: tuple, keys: tuple = ("split", "technique", "camera"), bands: dict = BANDS) -> DataFrame:
    """One conditional aggregate per split, technique and camera: RMS overall, by zone, by distance band, by band in the
    centre zone, and the ratios between them."""
    d = F.col("frame_distance_mm")
    inside = {n: (d >= lo) & (d < hi) for n, (lo, hi) in bands.items()}
    z, e2 = F.col("_z"), F.col("_e2")
    out = rows.withColumns({"_z": zone("r", radii), "_e2": F.expr(SQUARED)}).groupBy(*keys).agg(
        F.sqrt(F.avg(e2)).alias("rms"), *[rms_if(z == k, e2).alias(f"rms_{n}") for k, n in enumerate(ZONES)],
        *[rms_if(c, e2).alias(f"rms_{n}") for n, c in inside.items()],
        *[rms_if(c & (z == 0), e2).alias(f"rms_{n}_centre") for n, c in inside.items()],
        F.count("*").alias("n_points"), *[F.count(F.when(z == k, 1)).alias(f"n_{n}") for k, n in enumerate(ZONES)])
    return out.withColumns({
        "mid_to_centre": _ratio("rms_mid", "rms_centre"), "outer_to_centre": _ratio("rms_outer", "rms_centre"),
        "far_to_near": _ratio("rms_far", "rms_near"), "far_to_near_centre": _ratio("rms_far_centre", "rms_near_centre")})


STEREO_METRICS = ("length_bias_mm", "length_rms_mm", "length_bias_far_mm", "length_rms_far_mm", "baseline_mm")


def stereo_metrics(bars: DataFrame, keys: tuple = ("split", "technique"), far: tuple = BANDS["far"]) -> DataFrame:
    """Per split and technique: mean bias, RMS of the per-pair RMS, both again for the far band, and the baseline."""
    d = F.col("frame_distance_mm")
    is_far = (d >= far[0]) & (d < far[1])
    square = F.col("length_rms_mm") * F.col("length_rms_mm")
    return bars.groupBy(*keys).agg(
        F.avg("length_bias_mm").alias("length_bias_mm"), F.sqrt(F.avg(square)).alias("length_rms_mm"),
        F.avg(F.when(is_far, F.col("length_bias_mm"))).alias("length_bias_far_mm"), rms_if(is_far, square).alias("length_rms_far_mm"),
        F.first("baseline_mm").alias("baseline_mm"), F.count("*").alias("n_pairs"))


def split_interval(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, 2.5 and 97.5 percentile and count of the finite values per key (one value per split)."""
    clean = cut_lineage(values.select(*keys, not_nan(value).alias(value)))     # read by every pass of the quantiles
    plain = clean.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return with_quantiles(clean, plain, keys, value, {"lo": ("linear", INTERVAL[0]), "hi": ("linear", INTERVAL[1])})


def long_metrics(table: DataFrame, ids: list[str], metrics: tuple) -> DataFrame:
    """Metrics as rows: ids, metric, value."""
    return table.unpivot(ids, list(metrics), "metric", "value")


def summary_table(table: DataFrame, metrics: tuple, by: list[str]) -> DataFrame:
    """Long summary: technique x camera x metric to mean, lo, hi, n over the splits."""
    return split_interval(long_metrics(table, ["split", *by], metrics), [*by, "metric"])


def paired_comparison(table: DataFrame, metrics: tuple, name: str = "technique", by: tuple = ("camera",)) -> DataFrame:
    """Every two techniques (a before b in name order) per camera and metric: the per-split difference a - b summarised;
    within_noise where its interval holds 0 or no split has both. One row per split and technique enters, so a pairing
    group is the handful of techniques of one split."""
    long = long_metrics(table, ["split", name, *by], metrics).withColumn("value", not_nan("value"))
    a = long.withColumnRenamed(name, "a").withColumnRenamed("value", "_va")
    b = long.withColumnRenamed(name, "b").withColumnRenamed("value", "_vb")
    difference = a.join(b, ["split", *by, "metric"]).where(F.col("a") < F.col("b")).withColumn("value", F.col("_va") - F.col("_vb"))
    out = split_interval(difference, ["a", "b", *by, "metric"])
    return out.withColumn("within_noise", (F.col("n") == 0) | (F.coalesce(F.col("lo") <= 0, F.lit(False))
                                                               & F.coalesce(F.col("hi") >= 0, F.lit(False))))


def profile_with_band(rows: DataFrame, keys: list[str], x: str, edges: list[float], min_count: int) -> DataFrame:
    """Pooled RMS profile with the interval of the per-split profiles (a quarter of min_count per split, at least 1);
    the interval is blank where the pooled value is."""
    pooled = binned_rms(rows, keys, x, edges, min_count)
    single = binned_rms(rows, [*keys, "split"], x, edges, max(1, min_count // 4))
    band = split_interval(single, [*keys, "bin"], "rms").select(*keys, "bin", "lo", "hi")
    shown = F.col("rms").isNotNull()
    return pooled.join(band, [*keys, "bin"], "left").withColumns(
        {"lo": F.when(shown, F.col("lo")), "hi": F.when(shown, F.col("hi"))})


def length_by_distance(bars: DataFrame, width: float, keys: list[str] | None = None, min_rows: int = 3) -> DataFrame:
    """Length error by distance bin (starting at a multiple of width): bias, RMS and the interval of the per-split mean
    biases, bins of at least min_rows bars."""
    keys = ["technique"] if keys is None else keys
    binned = bars.withColumn("bin", F.floor(F.col("frame_distance_mm") / width).cast("long"))
    per_split = binned.groupBy(*keys, "bin", "split").agg(
        F.avg("length_bias_mm").alias("value"), F.sum("length_bias_mm").alias("_s"),
        F.sum(F.col("length_rms_mm") * F.col("length_rms_mm")).alias("_q"), F.count("*").alias("_n"))
    pooled = per_split.groupBy(*keys, "bin").agg(
        (F.sum("_s") / F.sum("_n")).alias("bias"), F.sqrt(F.sum("_q") / F.sum("_n")).alias("rms"), F.sum("_n").alias("rows"))
    band = split_interval(per_split, [*keys, "bin"]).select(*keys, "bin", "lo", "hi")
    return (pooled.where(F.col("rows") >= min_rows).join(band, [*keys, "bin"])
            .withColumn("centre", (F.col("bin") + 0.5) * width))


def signed_lookup(comparisons: DataFrame, wanted: DataFrame, by: tuple = ("camera", "metric")) -> DataFrame:
    """Comparison rows for the wanted ordered pairs (a, b); where only (b, a) is stored its sign is flipped and the
    interval's ends change places."""
    numbers = ("mean", "lo", "hi")
    straight = comparisons.select("a", "b", *by, *numbers, "n", "within_noise", F.lit(0).alias("_flip"))
    flipped = comparisons.select(F.col("b").alias("a"), F.col("a").alias("b"), *by, (-F.col("mean")).alias("mean"),
                                 (-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi"), "n", "within_noise", F.lit(1).alias("_flip"))
    return straight.unionByName(flipped).join(wanted.select("a", "b").distinct(), ["a", "b"]).drop("_flip")


def strongest_correlations(fits: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The n strongest pairs of each fit's correlation matrix (names array, corr row-major array), upper triangle. A fit
    is one row with one small matrix."""
    rows = fits.select(*keys, "names", F.posexplode("corr").alias("_p", "value")).withColumns(
        {"_i": F.floor(F.col("_p") / F.size("names")).cast("int"), "_j": F.col("_p") % F.size("names")}).where(F.col("_i") < F.col("_j"))
    pairs = rows.select(*keys, F.col("names")[F.col("_i")].alias("first"), F.col("names")[F.col("_j")].alias("second"), "value")
    order = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), F.desc("first"), F.desc("second"))
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def correlation_matrix(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Correlation of columns per key, as the matrix row the lookup above reads."""
    pairs = [F.corr(a, b) if a != b else F.lit(1.0) for a in columns for b in columns]
    one = rows.groupBy(*keys).agg(*[p.alias(f"_c{k}") for k, p in enumerate(pairs)])
    return one.select(*keys, F.array(*[F.lit(c) for c in columns]).alias("names"),
                      F.array(*[F.col(f"_c{k}") for k in range(len(pairs))]).alias("corr"))
