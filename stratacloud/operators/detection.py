"""Detection and calibration analytics.

A detection is a row (keys such as channel, camera, image; tag; where needed its corners as quad array<struct<u, v>>).
Ids 0..69 are on the board. A tag counts as found where it was seen exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.columns import avg_if, count_if, not_nan, norm, rms_if
from stratacloud.functions.geometry import in_convex
from stratacloud.functions.quantiles import exact_quantiles, with_quantiles
from stratacloud.operators.fit import join_keys
from stratacloud.operators.trajectory import edge_lengths
from stratacloud.session import cut_lineage

# The board's tag count, the channel order of a merge, tolerances and limits in pixels.
N_TAGS = 70
MERGE_ORDER = ("gray", "g", "r", "b")
MERGE_TOLERANCE_PX = 1.0
REJECT_TAG_PX, REJECT_TAG_MEDIANS = 2.0, 5.0
REJECT_IMAGE_PX, REJECT_IMAGE_MEDIANS = 1.0, 3.0
REJECT_MAX_ROUNDS = 10
MAX_BAD_RATE = 0.005


def on_board(tag: Column | str = "tag") -> Column:
    tag = F.col(tag) if isinstance(tag, str) else tag
    return (tag >= 0) & (tag < N_TAGS)


def found_once(detections: DataFrame, keys: list[str], extras: list[Column] | None = None) -> DataFrame:
    """(keys, tag) seen exactly once, with extra aggregates of that single row."""
    return detections.groupBy(*keys, "tag").agg(F.count("*").alias("_n"), *(extras or [])).where(F.col("_n") == 1).drop("_n")


def merge_channels(detections: DataFrame, keys: list[str], order: tuple = MERGE_ORDER, tolerance: float = MERGE_TOLERANCE_PX) -> DataFrame:
    """Per image and tag the corners of the first channel (in order) that found the tag once; conflict marks a board tag
    whose corners lie farther than tolerance apart in another channel. A tag has at most one row per channel here."""
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("channel"))
    once = found_once(detections, [*keys, "channel"], [F.first("quad").alias("quad")]).withColumn("_rank", rank)
    both = once.groupBy(*keys, "tag").agg(F.array_sort(F.collect_list(F.struct("_rank", "channel", "quad"))).alias("_s"))
    first = F.col("_s")[0]
    far = F.transform("_s", lambda s: F.array_max(F.zip_with(s["quad"], first["quad"], lambda a, b: norm(a["u"] - b["u"], a["v"] - b["v"]))))
    return both.select(*keys, "tag", first["channel"].alias("channel"), first["quad"].alias("quad"),
                       (on_board() & (F.array_max(far) > tolerance)).alias("conflict"))


def merge_counts(merged: DataFrame, keys: list[str]) -> DataFrame:
    return merged.groupBy(*keys).agg(count_if(~F.col("conflict")).alias("tags"), count_if(F.col("conflict")).alias("conflicts"))


def image_accounting(detections: DataFrame, keys: list[str], min_tags: int = 10, images: DataFrame | None = None) -> DataFrame:
    """Per image: distinct board ids, off-board detections, repeats of board ids, usable. images lists those to keep even
    without any detection."""
    per_tag = detections.groupBy(*keys, "tag").agg(F.count("*").alias("_c"))
    out = per_tag.groupBy(*keys).agg(
        count_if(on_board()).alias("tags"), F.coalesce(F.sum(F.when(~on_board(), F.col("_c"))), F.lit(0)).cast("long").alias("false_ids"),
        F.coalesce(F.sum(F.when(on_board(), F.col("_c") - 1)), F.lit(0)).cast("long").alias("duplicates"))
    if images is not None:
        out = images.select(*keys).distinct().join(out, keys, "left").na.fill(0, ["tags", "false_ids", "duplicates"])
    return out.withColumn("usable", F.col("tags") >= min_tags)


def images_per_tag(detections: DataFrame, keys: list[str], images: str = "image") -> DataFrame:
    """Images each board tag was seen in, ids never seen included."""
    seen = detections.where(on_board()).select(*keys, "tag", images).distinct().groupBy(*keys, "tag").agg(F.count("*").alias("images"))
    every = detections.select(*keys).distinct().withColumn("tag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_TAGS - 1).cast("long"))))
    return every.join(seen, [*keys, "tag"], "left").withColumn("images", F.coalesce("images", F.lit(0).cast("long")))


def camera_summary(accounting: DataFrame, keys: list[str]) -> DataFrame:
    plain = accounting.groupBy(*keys).agg(
        F.count("*").alias("images"), F.sum("tags").alias("tags"), F.sum("false_ids").alias("false_ids"), F.sum("duplicates").alias("duplicates"),
        count_if(F.col("usable")).alias("usable_images"), count_if(F.col("tags") == 0).alias("images_without"))
    return with_quantiles(accounting, plain, keys, "tags", {"median_tags": ("linear", 0.5)})


def stereo_pairs(left: DataFrame, right: DataFrame, min_shared: int = 10) -> DataFrame:
    """Pairs of images by name (_Left_ read as _Right_) with the tags both saw; kept with at least min_shared of them.
    Rows: name, tag."""
    renamed = left.select(F.col("name").alias("left_name"), F.regexp_replace("name", "_Left_", "_Right_").alias("right_name"), "tag").distinct()
    shared = renamed.join(right.select(F.col("name").alias("right_name"), "tag").distinct(), ["right_name", "tag"])
    enough = shared.groupBy("left_name").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    return shared.join(enough, "left_name")


def reject_outliers(tags: DataFrame, residuals: Callable[[DataFrame], DataFrame], min_tags: int, max_rounds: int = REJECT_MAX_ROUNDS,
                    tag_floor: float = REJECT_TAG_PX, image_floor: float = REJECT_IMAGE_PX) -> tuple[DataFrame, DataFrame]:
    """Drop misplaced tags and badly fitting images to a fixpoint.

    tags: (image, tag) board tags; residuals(kept) returns (image, tag, worst, mean_square) of all tags, judged by a fit
    on the kept ones. A round keeps tags with worst <= max(tag_floor, 5 x median worst of the kept), then images with at
    least min_tags such tags and RMS <= max(image_floor, 3 x median RMS). Returns kept (image, tag) and one row of limits
    per round. Kept sets go through the checkpoint folder; limits are one-row aggregates."""
    kept = tags.where(on_board()).select("image", "tag").distinct()
    big = kept.groupBy("image").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_tags).select("image")
    kept, log = cut_lineage(kept.join(big, "image", "left_semi")), None
    for number in range(1, max_rounds + 1):
        errors = cut_lineage(residuals(kept))
        judged = errors.join(kept, ["image", "tag"], "left_semi")
        tag_limit = exact_quantiles(judged, [], "worst", {"_m": ("linear", 0.5)}).select(
            F.greatest(F.lit(tag_floor), REJECT_TAG_MEDIANS * F.col("_m")).alias("tag_limit"))
        close = errors.crossJoin(F.broadcast(tag_limit)).where(F.col("worst") <= F.col("tag_limit")).select("image", "tag", "mean_square")
        rms = close.groupBy("image").agg(F.count("*").alias("_n"), F.sqrt(F.avg("mean_square")).alias("rms")).where(F.col("_n") >= min_tags)
        image_limit = exact_quantiles(rms, [], "rms", {"_m": ("linear", 0.5)}).select(
            F.greatest(F.lit(image_floor), REJECT_IMAGE_MEDIANS * F.col("_m")).alias("image_limit"))
        good = rms.crossJoin(F.broadcast(image_limit)).where(F.col("rms") <= F.col("image_limit")).select("image")
        new = cut_lineage(close.join(good, "image", "left_semi").select("image", "tag"))
        row = tag_limit.crossJoin(F.broadcast(image_limit)).crossJoin(F.broadcast(new.agg(F.count("*").alias("kept_tags"), F.countDistinct("image").alias("kept_images"))))
        log = cut_lineage(row.select(F.lit(number).cast("long").alias("round"), "*") if log is None
                          else log.unionByName(row.select(F.lit(number).cast("long").alias("round"), "*")))
        same = new.join(kept, ["image", "tag"], "left_anti").limit(1).isEmpty() and kept.join(new, ["image", "tag"], "left_anti").limit(1).isEmpty()
        kept = new
        if same:
            break
    return kept, log


def rejected(tags: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags dropped from kept images, and images dropped."""
    images = kept.select("image").distinct()
    dropped = tags.where(on_board()).select("image", "tag").distinct().join(kept, ["image", "tag"], "left_anti").join(images, "image", "left_semi")
    return dropped, tags.select("image").distinct().join(images, "image", "left_anti")


ANGLE_PATTERN = r"(?i)^[^_]+_([A-Za-z]+\d+)_frames$"


def board_angle(name: Column) -> Column:
    """Board angle code in a scan folder's name, upper case: `Water_C3_frames/...` is C3. Another form is an error."""
    folder = F.split(name, "/")[0]
    code = F.upper(F.regexp_extract(folder, ANGLE_PATTERN, 1))
    return F.when(code == "", F.raise_error(F.concat(name, F.lit(": scan folder is not named <medium>_<angle>_frames"))).cast("string")).otherwise(code)


def with_labels(accounting: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their distance label and angle; an image without a label is an error."""
    joined = accounting.join(labels, "name", "left")
    label = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.col("name"), F.lit(": no distance label"))).cast("double")).otherwise(F.col("label"))
    return joined.withColumns({"label": label, "angle": board_angle(F.col("name"))})


def recall_table(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Recall (share of the board's tags) per channel rolled up over angle and distance label, counts, usable images and
    the false-id and duplicate rates of all detections: one pass over all grains by grouping sets."""
    total = F.sum("tags") + F.sum("false_ids") + F.sum("duplicates")
    return (labelled.groupingSets([[F.col(c) for c in by], [*[F.col(c) for c in by], F.col("label")], [*[F.col(c) for c in by], F.col("angle"), F.col("label")]],
                                  *by, "angle", "label")
            .agg(F.avg(F.col("tags") / N_TAGS).alias("recall"), F.count("*").alias("images"), count_if(F.col("usable")).alias("usable_images"),
                 F.try_divide(F.sum("false_ids"), total).alias("false_id_rate"), F.try_divide(F.sum("duplicates"), total).alias("duplicate_rate"))
            )


def paired_delta(per_image: DataFrame, reference: str, value: str, keys: list[str], channel: str = "channel") -> DataFrame:
    """Per channel the mean difference to a reference channel on the same images, with its standard error."""
    ref = per_image.where(F.col(channel) == reference).select(*keys, F.col(value).alias("_ref"))
    gap = F.col(value) - F.col("_ref")
    return per_image.join(ref, keys).groupBy(channel).agg(F.avg(gap).alias("delta"), (F.stddev_samp(gap) / F.sqrt(F.count("*"))).alias("delta_se"), F.count("*").alias("n"))


def common_items(rows: DataFrame, run: str, item: list[str], keys: list[str]) -> DataFrame:
    """Items every run of a key has: relational division by distinct count."""
    need = rows.select(*keys, run).distinct().groupBy(*keys).agg(F.count("*").alias("_need"))
    have = rows.select(*keys, *item, run).distinct().groupBy(*keys, *item).agg(F.count("*").alias("_have"))
    return join_keys(have, need, keys).where(F.col("_have") == F.col("_need")).select(*keys, *item)


def common_rms(per_image: DataFrame, run: str, keys: list[str], item: str = "image", error: str = "rms") -> DataFrame:
    """Per run: RMS over the images every run kept, over all its images, and over its extra images; counts of each."""
    common = common_items(per_image, run, [item], keys).withColumn("_c", F.lit(True))
    rows = per_image.join(common, [*keys, item], "left").withColumns({"_c": F.coalesce("_c", F.lit(False)), "_e2": F.col(error) * F.col(error)})
    return rows.groupBy(*keys, run).agg(
        rms_if(F.col("_c"), F.col("_e2")).alias("rms_common"), F.sqrt(F.avg("_e2")).alias("rms_all"), rms_if(~F.col("_c"), F.col("_e2")).alias("rms_extra"),
        count_if(F.col("_c")).alias("n_common"), F.count("*").alias("n_images"), count_if(~F.col("_c")).alias("n_extra"))


def matched_tag_rms(errors: DataFrame, run: str, keys: list[str], image: str = "image") -> DataFrame:
    """Per run over the (image, tag) pairs every run found once: RMS, median, p95, share above 2 px and unposed count.
    errors: keys, run, image, tag, mean_square (null or infinite = unposed), one row per tag found once."""
    shared = common_items(errors, run, [image, "tag"], keys)
    rows = errors.join(shared, [*keys, image, "tag"], "left_semi").withColumn("_ms", not_nan("mean_square")).withColumn("_px", F.sqrt("_ms"))
    plain = rows.groupBy(*keys, run).agg(
        F.count("*").alias("n_tags"), F.sqrt(F.avg("_ms")).alias("rms"), F.avg((F.col("_px") > 2).cast("double")).alias("over_2px"),
        count_if(F.col("_ms").isNull()).alias("unposed"))
    return with_quantiles(rows, plain, [*keys, run], "_px", {"median": ("linear", 0.5), "p95": ("linear", 0.95)})


def agreement_counts(detections: DataFrame, keys: list[str], channels: int, first: str, channel: str = "channel") -> DataFrame:
    """Per image, over board tags found once: found by all channels, by only some, added by merging (the first channel
    missed it), found by none, and union minus intersection."""
    once = found_once(detections.where(on_board()), [*keys, channel])
    tags = once.groupBy(*keys, "tag").agg(F.count("*").alias("_c"), F.max((F.col(channel) == first).cast("int")).alias("_f"))
    counts = tags.groupBy(*keys).agg(F.count("*").alias("_u"), count_if(F.col("_c") == channels).alias("found_by_all"), count_if(F.col("_f") == 0).alias("added"))
    images = detections.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["_u", "found_by_all", "added"])
    return images.select(*keys, "found_by_all", (F.col("_u") - F.col("found_by_all")).alias("found_by_some"), "added",
                         (N_TAGS - F.col("_u")).alias("found_by_none"), (F.col("_u") - F.col("found_by_all")).alias("disagreement"))


def most_disagreeing(counts: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Top-n report: the largest disagreement first, the larger name first on a tie."""
    return counts.orderBy(F.desc("disagreement"), *[F.desc(k) for k in keys]).limit(n)


def focal_agreement(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the focal lengths of all runs agree within the largest of their standard errors (runs: fx, fx_std)."""
    out = runs.groupBy(*keys).agg((F.max("fx") - F.min("fx")).alias("fx_spread"), F.max("fx_std").alias("fx_sigma"), F.count("*").alias("runs"))
    return out.withColumn("verdict", F.when(F.col("runs") < 2, None).when(F.col("fx_spread") <= F.col("fx_sigma"), "within").otherwise("wider"))


def disambiguate(runs: DataFrame) -> DataFrame:
    """Run labels within the same footage: a preset that repeats gets the run's own name appended. The label counts are
    joined, so a footage with any number of runs stays spread."""
    repeats = runs.groupBy("footage", "preset").agg(F.count("*").alias("_n"))
    return runs.join(repeats, ["footage", "preset"]).withColumn(
        "label", F.when(F.col("_n") > 1, F.concat("preset", F.lit(" ["), "run", F.lit("]"))).otherwise(F.col("preset"))).drop("_n")


def preset_summary(accounting: DataFrame, per_image: DataFrame, expected: DataFrame, cameras: tuple = ("left", "right")) -> DataFrame:
    """Per medium and preset: tags, usable images, bad detections and rate, and per camera the kept images, RMS and RMS
    on the common images. An expected (medium, preset) without any detection row is an error."""
    counts = accounting.groupBy("medium", "preset").agg(
        F.sum("tags").alias("tags"), count_if(F.col("usable")).alias("usable"), F.count("*").alias("images"),
        (F.sum("false_ids") + F.sum("duplicates")).alias("bad"))
    counts = counts.withColumn("bad_rate", F.coalesce(F.try_divide(F.col("bad"), F.col("tags") + F.col("bad")), F.lit(0.0)))
    rms = common_rms(per_image, "preset", ["medium", "camera"])
    wide = rms.groupBy("medium", "preset").agg(*[F.max(F.when(F.col("camera") == c, F.col(v))).alias(f"{n}_{c}")
                                               for c in cameras for v, n in (("n_images", "kept"), ("rms_all", "rms"), ("rms_common", "rms_common"))])
    listed = expected.join(counts, ["medium", "preset"], "left")
    checked = listed.withColumn("images", F.when(F.col("images").isNull(), F.raise_error(F.concat(
        F.lit("missing run "), "medium", F.lit("/"), "preset")).cast("long")).otherwise(F.col("images")))
    return checked.join(wide, ["medium", "preset"], "left")


def tag_edges(corners: DataFrame, keys: list[str], size_mm: float) -> DataFrame:
    """Edge-length errors of triangulated tags: keys, tag, corner, error."""
    return edge_lengths(corners, [*keys, "tag"]).withColumn("error", F.col("edge_mm") - F.lit(float(size_mm)))


def edge_statistics(errors: DataFrame, by: list[str], size_mm: float, keys: list[str]) -> DataFrame:
    """Per group: tags, edges, bias in mm and percent, sample deviation, mean absolute, RMS and largest error."""
    e = F.col("error")
    return errors.groupBy(*by).agg(
        F.count_distinct(F.struct(*keys, "tag")).alias("n_tags"), F.count("*").alias("n_edges"), F.avg(e).alias("bias_mm"), (100 * F.avg(e) / size_mm).alias("bias_pct"),
        F.stddev_samp(e).alias("sd_mm"), F.avg(F.abs(e)).alias("mae_mm"), F.sqrt(F.avg(e * e)).alias("rms_mm"), F.max(F.abs(e)).alias("max_abs_mm"))


def tag_regions(tags: DataFrame, keys: list[str], middle_row: tuple) -> DataFrame:
    """Region of each tag on the target: middle row, else left or right of the median image column of its pair.
    tags: keys, tag, u (mean of the left image's corners)."""
    split = exact_quantiles(tags, keys, "u", {"_split": ("linear", 0.5)})
    region = F.when(F.col("tag").isin(*middle_row), "middle row").when(F.col("u") < F.col("_split"), "left column").otherwise("right column")
    return join_keys(tags, split, keys).withColumn("region", region).drop("_split")


def shared_by_setups(tags: DataFrame, setup: str, keys: list[str]) -> DataFrame:
    return tags.join(common_items(tags, setup, [*keys, "tag"], []), [*keys, "tag"], "left_semi")


def by_calibration_range(tags: DataFrame, errors: DataFrame, training: DataFrame, keys: list[str], size_mm: float) -> DataFrame:
    """Edge statistics inside and outside the largest training distance: the same figures with the tag-median error.
    tags: keys, tag, distance_mm; training: distance_mm."""
    reach = training.agg(F.max("distance_mm").alias("_reach"))
    side = tags.crossJoin(F.broadcast(reach)).select(*keys, "tag", F.when(F.col("distance_mm") <= F.col("_reach"), "inside").otherwise("outside").alias("range"))
    placed = errors.join(side, [*keys, "tag"])
    stats = edge_statistics(placed, ["range"], size_mm, keys)
    # four edges per tag: a bounded median
    per_tag = placed.groupBy("range", *keys, "tag").agg(F.percentile("error", 0.5).alias("_m"))
    return with_quantiles(per_tag, stats, ["range"], "_m", {"tag_median_error_mm": ("linear", 0.5)})


def score_settings(detections: DataFrame, min_tags: int = 10, max_bad_rate: float = MAX_BAD_RATE, keys: tuple = ("camera", "image")) -> DataFrame:
    """Per setting: distinct board tags summed over images, repeats, off-board detections, usable images, bad rate, and
    whether the bad rate refuses it."""
    per_image = image_accounting(detections, ["setting", *keys], min_tags)
    out = per_image.groupBy("setting").agg(F.sum("tags").alias("board_tags"), F.sum("duplicates").alias("duplicates"), F.sum("false_ids").alias("false_ids"),
                                           count_if(F.col("usable")).alias("usable_images"))
    bad = F.col("duplicates") + F.col("false_ids")
    rate = F.coalesce(F.try_divide(bad, F.col("board_tags") + bad), F.lit(0.0))
    return out.withColumns({"bad_rate": rate, "refused": rate > max_bad_rate})


def best_setting(scores: DataFrame) -> DataFrame:
    """The accepted setting with most board tags, then fewest bad detections, then most usable images (lowest name last)."""
    key = F.struct("board_tags", (-(F.col("duplicates") + F.col("false_ids"))).alias("_b"), "usable_images")
    return scores.where(~F.col("refused")).orderBy(F.desc(key), "setting").limit(1)


def coordinate_descent(start: dict, axes: dict[str, list], score: Callable[[list[dict]], dict], rounds: int = 4,
                       min_gain: float | None = None) -> tuple[dict, list[dict]]:
    """Search settings one axis at a time. score(candidates) runs one Spark job for all new candidates of an axis and
    returns {key: (objective tuple or number, refused)}; known candidates are not scored again. Each axis gives a table
    of trials; the first of the best trials beyond the standing one (by at least min_gain in the objective or its first
    component, if given) is marked accepted and stands. Ends with a round in which none was. Returns the standing
    settings and the tables of all trials. The driver holds only settings and scores, one small record per trial."""
    scores: dict[str, tuple] = {}

    def trials(number: int, axis: str, candidates: list[dict]) -> list[dict]:
        if new := [c for c in candidates if settings_key(c) not in scores]:
            scores.update(score(new))
        found = [scores[settings_key(c)] for c in candidates]
        return [{"round": number, "axis": axis, "settings": c, "objective": o, "refused": r, "accepted": False}
                for c, (o, r) in zip(candidates, found, strict=True)]

    def beats(trial: dict, standing: dict) -> bool:
        mine, other = trial["objective"], standing["objective"]
        lead = mine[0] - other[0] if isinstance(mine, tuple) else mine - other
        return not trial["refused"] and mine > other and (min_gain is None or lead >= min_gain)

    log = trials(0, "start", [dict(start)])
    standing = log[0]
    standing["accepted"] = True
    for number in range(1, rounds + 1):
        for axis, values in axes.items():
            table = trials(number, axis, [standing["settings"] | {axis: v} for v in values])
            log += table
            if winners := [t for t in table if beats(t, standing)]:
                standing = max(winners, key=lambda t: t["objective"])
                standing["accepted"] = True
        if standing["round"] < number:
            break
    return standing["settings"], log


def settings_key(settings: dict) -> str:
    return ",".join(f"{k}={settings[k]}" for k in sorted(settings))


def region_shares(pixels: DataFrame, outlines: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame the percentage of used keypoints, cloud points and slide-resisting points inside the board's outline in
    the image; null where the base is empty. pixels: kind, u, v, used, grip; outlines: quad."""
    inside = in_convex(F.col("u"), F.col("v"), F.col("quad"))
    rows = pixels.join(outlines, keys).withColumn("_in", inside.cast("double"))
    keypoint, cloud = F.col("kind") == "keypoint", F.col("kind") == "cloud"
    return rows.groupBy(*keys).agg(
        count_if(keypoint).alias("keypoints"), count_if(keypoint & F.col("used")).alias("triangulated"),
        (100 * avg_if(keypoint & F.col("used"), "_in")).alias("triangulated_on_board"), count_if(cloud).alias("points"),
        (100 * avg_if(cloud, "_in")).alias("points_on_board"), (100 * avg_if(cloud, F.col("grip").cast("double"))).alias("resisting"),
        (100 * avg_if(cloud & F.col("grip"), "_in")).alias("resisting_on_board"))
