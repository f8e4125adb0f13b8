"""Sensor synchronisation and frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.columns import norm
from stratacloud.functions.ordered import number_rows
from stratacloud.functions.quantiles import exact_quantiles

SECOND = 1_000_000_000


def bucket_width(stamps: DataFrame, keys: list[str], time: str, width: int, limit: int = 1_000_000) -> int:
    """A bucket width at which no bucket holds more than limit distinct stamps, found by counting."""
    while width > 1:
        crowded = (stamps.groupBy(*keys, F.floor(F.col(time) / width)).agg(F.count("*").alias("n"))
                   .where(F.col("n") > limit).limit(1))
        if crowded.isEmpty():
            return width
        width = max(1, width // 16)
    return width


def nearest_in_time(right: DataFrame, left: DataFrame, keys: list[str], time: str, payload: str,
                    width: int = 600 * SECOND) -> DataFrame:
    """Each right row with the nearest left row in time (the earlier one on a tie), within keys: adds left_<payload>
    and left_<time>. Right rows of a key without any left row are dropped.

    Both sides shrink to distinct stamps, which are cut into time buckets. Windows run inside a bucket; one summary row
    per bucket carries the last and first left stamp across its edges."""
    stamp = F.col(time)
    candidates = left.groupBy(*keys, stamp.alias("_t")).agg(F.min(payload).alias("_p"))
    asked = right.select(*keys, stamp.alias("_t")).distinct()
    both = candidates.select(*keys, "_t", F.struct("_t", "_p").alias("_l"), F.lit(0).alias("_q")).unionByName(
        asked.select(*keys, "_t", F.lit(None).cast(f"struct<_t:bigint,_p:{dict(left.dtypes)[payload]}>").alias("_l"),
                     F.lit(1).alias("_q")))
    width = bucket_width(both, keys, "_t", width)
    both = both.withColumn("_b", F.floor(F.col("_t") / width).cast("long"))
    inside = Window.partitionBy(*keys, "_b")
    back = inside.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.orderBy(F.col("_t").desc(), "_q").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_before", F.last("_l", ignorenulls=True).over(back)).withColumn(
        "_after", F.last("_l", ignorenulls=True).over(ahead))
    edges = both.groupBy(*keys, "_b").agg(F.min("_l").alias("_first"), F.max("_l").alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"))
    asked_rows = seen.where(F.col("_q") == 1).join(edges, [*keys, "_b"], "left")
    before, after = F.coalesce("_before", "_cb"), F.coalesce("_after", "_ca")
    nearer = F.when(before.isNull(), after).when(after.isNull(), before).when(
        after["_t"] - F.col("_t") < F.col("_t") - before["_t"], after).otherwise(before)
    matched = asked_rows.select(*keys, F.col("_t").alias(time), nearer.alias("_n")).where(F.col("_n").isNotNull())
    return right.join(matched, [*keys, time]).select(
        *right.columns, F.col("_n._p").alias(f"left_{payload}"), F.col("_n._t").alias(f"left_{time}"))


def match_left(stamps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Frame pairs from (camera, frame, pts_ns): every right frame with its nearest left one and dt in ms."""
    keys = keys or []
    right = stamps.where(F.col("camera") == "right").drop("camera")
    left = stamps.where(F.col("camera") == "left").drop("camera")
    pairs = nearest_in_time(right, left, keys, "pts_ns", "frame")
    return pairs.select(*keys, F.col("frame").alias("right_frame"), F.col("left_frame"),
                        F.col("pts_ns").alias("right_pts_ns"), F.col("left_pts_ns"),
                        ((F.col("pts_ns") - F.col("left_pts_ns")) / F.lit(1e6)).alias("dt_ms"))


def gap_gate(pairs: DataFrame, max_dt_ms: float = 10.0) -> DataFrame:
    return pairs.where(F.abs("dt_ms") <= max_dt_ms)


def gap_counts(pairs: DataFrame, max_dt_ms: float = 10.0, keys: list[str] | None = None) -> DataFrame:
    near = F.abs("dt_ms") <= max_dt_ms
    return pairs.groupBy(*(keys or [])).agg(F.count(F.when(near, 1)).alias("kept"), F.count(F.when(~near, 1)).alias("dropped"))


def strided(frames: DataFrame, order: list[str], step: int = 1, offset: int = 0, cap: int | None = None,
            keys: list[str] | None = None) -> DataFrame:
    """Every step-th frame in name order from offset on, at most cap of them (per key)."""
    at = F.col("rn") - offset
    picked = number_rows(frames, order, keys).where((at >= 0) & (at % step == 0))
    if cap is not None:
        picked = picked.where(F.floor(at / step) < cap)
    return picked.drop("rn")


def frame_range(frames: DataFrame, frame: str, start: int, end: int, step: int = 1) -> DataFrame:
    """Frames start..end inclusive, every step-th from start."""
    return frames.where(F.col(frame).between(start, end) & ((F.col(frame) - start) % step == 0))


def _stencil(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Each pixel's 3x3 neighbourhood as columns p_<dr>_<dc>: every pixel is sent to the pixels it borders, and one
    grouping by target pixel collects them. Targets outside the image are not made."""
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                        for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)])
    sent = pixels.select("frame", F.col("row_"), F.col("col_"), "v", F.explode(offsets).alias("o"))
    names = {(dr, dc): f"p_{dr + 1}_{dc + 1}" for dr in (-1, 0, 1) for dc in (-1, 0, 1)}
    return (sent.select("frame", (F.col("row_") - F.col("o.dr")).alias("row_"), (F.col("col_") - F.col("o.dc")).alias("col_"),
                        "o", "v")
            .groupBy("frame", "row_", "col_")
            .agg(*[F.max(F.when((F.col("o.dr") == dr) & (F.col("o.dc") == dc), F.col("v"))).alias(n)
                   for (dr, dc), n in names.items()])
            .where(F.col("p_1_1").isNotNull()))


def _p(dr: int, dc: int) -> Column:
    """A neighbour by offset; past the image edge the picture is mirrored about its border pixel."""
    here = F.col(f"p_{dr + 1}_{dc + 1}")
    options = [here, F.col(f"p_{1 - dr}_{dc + 1}"), F.col(f"p_{dr + 1}_{1 - dc}"), F.col(f"p_{1 - dr}_{1 - dc}"), F.col("p_1_1")]
    return F.coalesce(*options)


def sharpness(pixels: DataFrame) -> DataFrame:
    """Per frame the population variance of the Laplacian (4-neighbour kernel, mirrored borders) of (frame, row_,
    col_, v)."""
    laplacian = _p(-1, 0) + _p(1, 0) + _p(0, -1) + _p(0, 1) - 4 * _p(0, 0)
    return _stencil(pixels).select("frame", laplacian.alias("l")).groupBy("frame").agg(F.var_pop("l").alias("score"))


def noise_sigma(pixels: DataFrame, edge_share: float = 0.90) -> DataFrame:
    """Per frame the noise level: mean absolute response of the difference-of-Laplacians mask over the pixels whose
    gradient is not above the 90th percentile, times sqrt(pi / 2) / 6."""
    gx = (_p(-1, 1) + 2 * _p(0, 1) + _p(1, 1)) - (_p(-1, -1) + 2 * _p(0, -1) + _p(1, -1))
    gy = (_p(1, -1) + 2 * _p(1, 0) + _p(1, 1)) - (_p(-1, -1) + 2 * _p(-1, 0) + _p(-1, 1))
    mask = (_p(-1, -1) - 2 * _p(-1, 0) + _p(-1, 1) - 2 * _p(0, -1) + 4 * _p(0, 0) - 2 * _p(0, 1)
            + _p(1, -1) - 2 * _p(1, 0) + _p(1, 1))
    responses = _stencil(pixels).select("frame", norm(gx, gy).alias("g"), F.abs(mask).alias("m"))
    edges = exact_quantiles(responses, ["frame"], "g", {"edge": ("linear", edge_share)})
    return (responses.join(edges, "frame").where(F.col("g") <= F.col("edge"))
            .groupBy("frame").agg((F.avg("m") * F.sqrt(F.lit(3.141592653589793 / 2)) / 6).alias("noise")))


# The percentiles a blur report lists, and the shares it tries as thresholds.
REPORT_PERCENTILES = (0, 10, 25, 50, 75, 90, 100)
TRIED_PERCENTILES = (10, 25, 50, 75)


def blur_percentiles(scores: DataFrame, key: str = "camera") -> DataFrame:
    """Percentiles of the blur score per camera, with the count."""
    ranks = {f"p{p}": ("linear", p / 100) for p in REPORT_PERCENTILES}
    counts = scores.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(exact_quantiles(scores, [key], "blur", ranks), key)


def blur_thresholds(scores: DataFrame, key: str = "camera") -> DataFrame:
    """For thresholds at global percentiles: how many frames of each camera a threshold would keep."""
    ranks = {f"p{p}": ("linear", p / 100) for p in TRIED_PERCENTILES}
    cut = exact_quantiles(scores, [], "blur", ranks)
    rows = cut.select(F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("percentile"), F.col(f"p{p}").alias("threshold"))
                                          for p in TRIED_PERCENTILES])).alias("t")).select("t.*")
    return (scores.crossJoin(F.broadcast(rows)).groupBy(key, "percentile")
            .agg(F.first("threshold").alias("threshold"), F.count(F.when(F.col("blur") >= F.col("threshold"), 1)).alias("kept")))


def blurriest(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy("blur", "camera", "name").limit(n)


def blur_verdict(scores: DataFrame, threshold: float = 100.0) -> DataFrame:
    return scores.withColumn("verdict", F.when(F.col("blur") < threshold, "BLURRY").otherwise("sharp"))


def blur_select(scores: DataFrame, threshold: float | None = None, percentile: float | None = None,
                require_pairs: bool = False) -> DataFrame:
    """Frames at or above a fixed blur threshold or a global percentile; with require_pairs only labels both cameras
    still have. Neither threshold keeps everything."""
    if percentile is not None:
        cut = exact_quantiles(scores, [], "blur", {"_cut": ("linear", percentile / 100)})
        kept = scores.crossJoin(F.broadcast(cut)).where(F.col("blur") >= F.col("_cut")).drop("_cut")
    elif threshold is not None:
        kept = scores.where(F.col("blur") >= threshold)
    else:
        return scores
    if require_pairs:
        both = (kept.where(F.col("camera").isin("left", "right")).select("label", "camera").distinct()
                .groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") == 2))
        kept = kept.join(both, "label", "left_semi")
    return kept


def camera_centre(t: str = "T") -> list[Column]:
    """Centre -R^T t of a row-major 4x4 camera pose column."""
    m = F.col(t)
    return [-(m[k] * m[3] + m[4 + k] * m[7] + m[8 + k] * m[11]) for k in range(3)]


def select_posed(poses: DataFrame, focus: tuple, max_range: float, min_tags: int) -> DataFrame:
    """Frames with at least min_tags tags whose camera centre lies within max_range of the focus."""
    gap = norm(*[c - float(f) for c, f in zip(camera_centre(), focus)])
    return poses.where((F.col("n_tags") >= min_tags) & (gap <= max_range))


def tags_in_both(detections: DataFrame, required: DataFrame, cameras: int = 2) -> DataFrame:
    """Relational division: per pair, whether every required tag is seen by all cameras; reason `tags` where not."""
    wanted = required.select("tag").distinct()
    need = wanted.agg((F.count("*") * cameras).alias("_need"))
    hits = (detections.join(wanted, "tag", "left_semi").select("pair", "camera", "tag").distinct()
            .groupBy("pair").agg(F.count("*").alias("_hits")))
    pairs = detections.select("pair").distinct().join(hits, "pair", "left").crossJoin(F.broadcast(need))
    missing = F.coalesce("_hits", F.lit(0)) < F.col("_need")
    return pairs.select("pair", F.coalesce("_hits", F.lit(0)).cast("long").alias("hits"), F.when(missing, "tags").alias("reason"))


# Source-view limits in degrees, and the distance in mm the angles are measured at.
SOURCE_ANGLE_RANGE = (4.0, 40.0)
SOURCE_TARGET_ANGLE = 15.0
SOURCE_MAX_OFF_AXIS = 35.0
TARGET_DEPTH_MM = 450.0


def source_views(views: DataFrame, n: int = 20, depth: float = TARGET_DEPTH_MM, keys: list[str] | None = None) -> DataFrame:
    """Top-n source views per reference view of (name, partner, cx, cy, cz, ax, ay, az), axes being unit vectors.

    A source must triangulate a point `depth` in front of the reference at 4 to 40 degrees and see it within 35
    degrees of its own axis. The partner camera comes first, then the angle nearest 15 degrees, then the name."""
    from stratacloud.operators.views import ranked_sources

    return ranked_sources(views, n, depth, keys or [])


def match_pairs(frames: DataFrame, window: int, cameras: tuple = ("left", "right"), keys: list[str] | None = None) -> DataFrame:
    """All camera combinations of frames at most window positions apart: unordered, distinct, no self pair."""
    keys = keys or []
    numbered = number_rows(frames.select(*keys, "name").distinct(), ["name"], keys)
    later = numbered.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(int(window))))).select(
        *keys, F.col("name").alias("other"), (F.col("rn") - F.col("_d")).alias("rn"))
    joined = numbered.join(later, [*keys, "rn"])
    cams = F.array(*[F.lit(c) for c in cameras])
    combos = joined.withColumn("_a", F.explode(cams)).withColumn("_b", F.explode(cams)).select(
        *keys, F.concat_ws("/", "_a", "name").alias("_f"), F.concat_ws("/", "_b", "other").alias("_s"))
    return (combos.where(F.col("_f") != F.col("_s"))
            .select(*keys, F.least("_f", "_s").alias("first"), F.greatest("_f", "_s").alias("second")).distinct())


def common_names(rows: DataFrame, member: str = "method", name: str = "name", keys: list[str] | None = None) -> DataFrame:
    """Names every member has (relational division by distinct count)."""
    keys = keys or []
    members = rows.select(*keys, member).distinct().groupBy(*keys).agg(F.count("*").alias("_need"))
    have = rows.select(*keys, name, member).distinct().groupBy(*keys, name).agg(F.count("*").alias("_have"))
    joined = have.join(members, keys) if keys else have.crossJoin(F.broadcast(members))
    return joined.where(F.col("_have") == F.col("_need")).select(*keys, name)


def figure_frame(rows: DataFrame, index: int | str = "middle", keys: list[str] | None = None, member: str = "method",
                 name: str = "name") -> DataFrame:
    """The middle (or index-th, capped at the last) of the names every member has."""
    keys = keys or []
    numbered = number_rows(common_names(rows, member, name, keys), [name], keys)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = numbered.join(sizes, keys) if keys else numbered.crossJoin(F.broadcast(sizes))
    wanted = F.floor(F.col("_n") / 2) if index == "middle" else F.least(F.lit(int(index)), F.col("_n") - 1)
    return joined.where(F.col("rn") == wanted).select(*keys, name)


def spread_sample(frames: DataFrame, k: int, order: str, keys: list[str] | None = None) -> DataFrame:
    """k names spread evenly over the list without its ends: positions of a (k + 2)-point ramp, truncated."""
    keys = keys or []
    numbered = number_rows(frames, [order], keys)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = (F.col("_n") - 1) / F.lit(float(k + 1))
    wanted = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(
        *keys, F.floor(F.col("_k") * step).alias("rn"), F.col("_k").cast("long").alias("pick"))
    return numbered.join(wanted, [*keys, "rn"]).drop("rn")
