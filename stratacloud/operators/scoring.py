"""Depth scoring and pipeline cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.columns import count_if
from stratacloud.functions.quantiles import exact_quantiles, with_quantiles
from stratacloud.operators.fit import join_keys, trend

PIXEL = ["frame", "row_", "col_"]


def pixel_errors(truth: DataFrame, disparity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Truth pixels with the absolute disparity error; null where the raster has no depth (absent or not positive)."""
    on = [*(keys or []), *PIXEL]
    return truth.where(F.col("truth") > 0).select(*on, "truth").join(disparity.where(F.col("d") > 0).select(*on, "d"), on, "left").withColumn(
        "error", F.abs(F.col("d") - F.col("truth")))


def truth_counts(errors: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """Per key (with frame): region pixels, pixels with depth, pixels within tolerance."""
    return errors.groupBy(*keys).agg(F.count("*").alias("region"), F.count("error").alias("with_depth"),
                                     count_if(F.col("error") <= tolerance).alias("good"))


def micro_scores(errors: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """Pixel-weighted precision, recall and F1 (0 where undefined) with median and p90 error."""
    counts = truth_counts(errors, keys, tolerance)
    zero = F.lit(0.0)
    scored = counts.withColumns({"precision": F.coalesce(F.try_divide(F.col("good"), F.col("with_depth")), zero),
                                 "recall": F.coalesce(F.try_divide(F.col("good"), F.col("region")), zero)})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero))
    return with_quantiles(errors, scored, keys, "error", {"median_error_px": ("linear", 0.5), "p90_error_px": ("linear", 0.9)})


def macro_objective(scores: DataFrame, scenes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean F1 over the sets of a scene, then over scenes. scores: set, f1; scenes: set, scene (a config list)."""
    keys = keys or []
    per_scene = scores.join(scenes, "set").groupBy(*keys, "scene").agg(F.avg("f1").alias("f1"))
    return per_scene.groupBy(*keys).agg(F.avg("f1").alias("objective"), F.count("*").alias("scenes"))


def matcher_summary(frames: DataFrame, scores: DataFrame, image_pixels: float, keys: list[str]) -> DataFrame:
    """Per recording and matcher: frames, median seconds, median pixels with depth and their share of the image in
    percent, joined with its scores; combinations without frames are absent."""
    plain = frames.groupBy(*keys).agg(F.count("*").alias("frames"))
    for c in ("match_s", "pixels"):
        plain = with_quantiles(frames, plain, keys, c, {f"{c}_median": ("linear", 0.5)})
    return plain.withColumn("coverage_pct", 100 * F.col("pixels_median") / image_pixels).join(scores, keys, "left")


def robust_range(rows: DataFrame, value: str, keys: list[str], low: float = 0.05, high: float = 0.95, pad: float = 0.1,
                 shared: bool = False) -> DataFrame:
    """Percentile band pooled over methods per key, padded on both sides; shared uses the smallest and largest of all."""
    band = exact_quantiles(rows, keys, value, {"_lo": ("linear", low), "_hi": ("linear", high)})
    gap = F.col("_hi") - F.col("_lo")
    padded = band.select(*keys, (F.col("_lo") - pad * gap).alias("low"), (F.col("_hi") + pad * gap).alias("high"))
    if not shared:
        return padded
    whole = padded.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return padded.select(*keys).crossJoin(F.broadcast(whole))


def grid_samples(raster: DataFrame, size: tuple, grid: tuple, keys: list[str] | None = None) -> DataFrame:
    """Per frame, how many of a cols x rows grid of pixel centres (inset by half a cell) have depth. The grid is matched
    by equality on row and column."""
    (h, w), (cols, rows) = size, grid
    keys = keys or ["frame"]
    xs = [int((k + 0.5) * w / cols) for k in range(cols)]
    ys = [int((k + 0.5) * h / rows) for k in range(rows)]
    # a pixel counts as often as the grid names it (a fine grid on a small image repeats pixels)
    times_x = F.size(F.filter(F.array(*[F.lit(x) for x in xs]), lambda v: v == F.col("col_")))
    times_y = F.size(F.filter(F.array(*[F.lit(y) for y in ys]), lambda v: v == F.col("row_")))
    found = F.sum(F.when(F.col("d") > 0, times_x * times_y).otherwise(0))
    return raster.groupBy(*keys).agg(found.cast("long").alias("found"), F.lit(cols * rows).cast("long").alias("samples"))


def cost_rollup(samples: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Peak and mean of every measure per stage, with the number of samples."""
    return samples.groupBy(*keys).agg(*[F.max(m).alias(f"peak_{m}") for m in measures], *[F.avg(m).alias(f"mean_{m}") for m in measures],
                                      F.count("*").alias("samples"))


def subset_cost(runs: DataFrame, frames: DataFrame, subset: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of a subset of a run's frames: the start-up (wall time minus all frames') plus the subset's own."""
    every = frames.groupBy(*keys).agg(F.sum("seconds").alias("_all"))
    mine = frames.join(subset.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi").groupBy(*keys).agg(F.sum("seconds").alias("_mine"))
    joined = join_keys(runs, every, keys).join(mine, keys, "left")
    return joined.select(*keys, (F.col("wall_s") - F.col("_all")).alias("startup_s"),
                         (F.col("wall_s") - F.col("_all") + F.coalesce("_mine", F.lit(0.0))).alias("depth_s"))


def step_table(steps: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Steps with their parts' costs left-joined and the total, null unless every part is present."""
    out, total = steps, None
    for name, part in parts.items():
        out = out.join(part, keys, "left")
        total = F.col(name) if total is None else total + F.col(name)
    return out.withColumn("total_s", total)


def across_recordings(rows: DataFrame, measures: list[str], by: list[str], recording: str = "recording", order: str = "ord") -> DataFrame:
    """Per step (and source) and measure: mean, minimum, maximum and number of recordings, taking each recording's first
    non-null value; recordings without one are left out."""
    long = rows.unpivot([recording, *by, order], measures, "measure", "value").where(F.col("value").isNotNull())
    firsts = long.groupBy(recording, *by, "measure").agg(F.min_by("value", order).alias("value"))
    return firsts.groupBy(*by, "measure").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("recordings"))


def pivot_measures(table: DataFrame, by: list[str], measures: list[str], value: str = "mean") -> DataFrame:
    return table.groupBy(*by).pivot("measure", measures).agg(F.first(value))


def stage_costs(records: DataFrame) -> DataFrame:
    """Per stage: runs, seconds per frame (slope of wall time over frames), RAM range, peak GPU memory, mean cores and
    GPU use; measures a record lacks are skipped."""
    plain = records.groupBy("stage").agg(
        F.count("*").alias("runs"), (F.min("peak_tree_rss_mb") / 1024).alias("ram_min_gb"), (F.max("peak_tree_rss_mb") / 1024).alias("ram_max_gb"),
        (F.max("peak_gpu_mib") / 1024).alias("gpu_gb"), (F.avg("mean_cpu_percent") / 100).alias("cores"), F.avg("mean_gpu_util_percent").alias("gpu_util"))
    return plain.join(trend(records, ["stage"], "frames", "wall_s").select("stage", F.col("slope").alias("s_per_frame")), "stage")


def accuracy_grid(rows: DataFrame, grid: DataFrame, fit: str) -> DataFrame:
    """Report rows of one fit for every configured (object, method); methods without a result keep a blank row."""
    return grid.join(rows.where(F.col("fit") == fit), ["object", "method"], "left").withColumn("blank", F.col("fit").isNull())


def explode_fits(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy rows of metrics documents: map fits (name to struct) becomes one row per fit."""
    return metrics.select(*keys, F.explode("fits").alias("fit", "_m")).select(*keys, "fit", "_m.*")


RELIABLE_COVERAGE = 0.15


def with_reliability(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reliable", F.col("coverage") >= RELIABLE_COVERAGE)


def voting_families(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Reliable rows grouped as families: the method's name without its voting suffix `_v<k>`, in the order of k with
    the unsuffixed method first. A family has one row per voting threshold."""
    pattern = r"^(.+)_v(\d+)$"
    base = F.regexp_extract("method", pattern, 1)
    named = rows.where(F.col("reliable")).withColumns({
        "family": F.when(base == "", F.col("method")).otherwise(base),
        "k": F.when(base != "", F.regexp_extract("method", pattern, 2).cast("long"))})
    order = Window.partitionBy(*keys, "family").orderBy(F.col("k").asc_nulls_first())
    return named.withColumn("position", F.row_number().over(order).cast("long"))
