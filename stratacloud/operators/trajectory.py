"""Trajectory analytics.

Poses are rows (keys such as recording and method, frame as a long, T = frame to world as row-major array<double>, lost
0/1). A frame that is not posed has no row or a null T. Order-dependent columns go through functions.ordered, so one
long recording spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.columns import norm
from stratacloud.functions.geometry import compose, cross, dot, inverse, motion, turn_deg
from stratacloud.functions.matrices import symmetric_eigen
from stratacloud.functions.ordered import following_extremes, ordered_lag, running_total, running_totals
from stratacloud.functions.quantiles import exact_quantiles, with_quantiles
from stratacloud.operators.fit import S, T, align, join_keys, pose_pairs
from stratacloud.operators.sync import nearest_in_time
from stratacloud.session import cut_lineage

XYZ = ("x", "y", "z")
STATS = {"median": ("linear", 0.5), "p95": ("linear", 0.95)}


def posed(poses: DataFrame) -> DataFrame:
    return poses.where(F.col("T").isNotNull() & (F.coalesce("lost", F.lit(0)) == 0))


def with_position(poses: DataFrame) -> DataFrame:
    """The camera's position x, y, z in the world."""
    return poses.withColumns({a: F.col("T")[4 * k + 3] for k, a in enumerate(XYZ)})


def registration(frames: DataFrame, estimate: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: frames, posed ones, those the reference also has, and the registration share; comparable tells whether
    at least three frames are common."""
    got = posed(estimate).select(*keys, "frame").withColumn("_p", F.lit(1))
    ref = reference.where(F.col("T").isNotNull()).select(*keys, "frame").withColumn("_r", F.lit(1))
    rows = frames.select(*keys, "frame").join(got, [*keys, "frame"], "left").join(ref, [*keys, "frame"], "left")
    out = rows.groupBy(*keys).agg(F.count("*").alias("frames"), F.count("_p").alias("posed"), F.count(F.col("_p") * F.col("_r")).alias("with_reference"))
    return out.withColumns({"registration": F.col("posed") / F.col("frames"), "comparable": F.col("with_reference") >= 3})


def _stats(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    plain = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(f"{prefix}_rmse"), F.max(value).alias(f"{prefix}_max"))
    return with_quantiles(rows, plain, keys, value, {f"{prefix}_{n}": r for n, r in STATS.items()})


def aligned_errors(estimate: DataFrame, reference: DataFrame, keys: list[str], lever: float = 100.0) -> DataFrame:
    """Common frames of keys with at least three, the estimate moved by one rigid fit on lever points: reference pose T_ref,
    aligned pose T_fit, estimate pose T_est, position error and rotation error."""
    both = posed(estimate).select(*keys, "frame", F.col("T").alias("T_est")).join(
        reference.where(F.col("T").isNotNull()).select(*keys, "frame", F.col("T").alias("T_ref")), [*keys, "frame"])
    enough = both.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 3).drop("_n")
    both = cut_lineage(join_keys(both, enough, keys) if keys else both)
    fit = align(pose_pairs(both.withColumn("T", F.col("T_est")), both.withColumn("T", F.col("T_ref")), keys, lever), keys).select(*keys, F.col("T").alias("_f"))
    moved = join_keys(both, fit, keys).withColumn("T_fit", compose("_f", "T_est")).drop("_f")
    gap = [F.col("T_fit")[4 * k + 3] - F.col("T_ref")[4 * k + 3] for k in range(3)]
    # one row per frame, read several times by the metrics below: written once
    return cut_lineage(moved.withColumns({"ate_mm": norm(*gap), "ate_deg": turn_deg(compose(inverse("T_ref"), F.col("T_fit")))}))


def absolute_error(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute trajectory error: RMSE, median, p95 and maximum of position and rotation, and the scale that would fit
    the camera centres best."""
    centres = errors.select(*keys, *[F.col("T_est")[4 * k + 3].alias(n) for k, n in enumerate(S)], *[F.col("T_ref")[4 * k + 3].alias(n) for k, n in enumerate(T)])
    scale = align(centres, keys, with_scale=True).select(*keys, F.col("scale").alias("best_fit_scale"))
    return join_keys(join_keys(_stats(errors, keys, "ate_mm", "ate_mm"), _stats(errors, keys, "ate_deg", "ate_deg"), keys), scale, keys)


def principal_axes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the centre and the three principal directions of x, y, z: along (largest), pointing from the first to the
    last frame; across; and their cross product."""
    middle = points.groupBy(*keys).agg(*[F.avg(a).alias(f"_o{a}") for a in XYZ],
                                       F.min_by(F.array(*XYZ), "frame").alias("_first"), F.max_by(F.array(*XYZ), "frame").alias("_last"))
    rel = {a: F.col(a) - F.col(f"_o{a}") for a in XYZ}
    sums = join_keys(points, middle, keys).groupBy(*keys).agg(*[F.sum(rel[a] * rel[b]).alias(f"_{a}{b}") for k, a in enumerate(XYZ) for b in XYZ[k:]])
    eigen = join_keys(middle, sums.withColumn("_e", symmetric_eigen(F.array(*[F.col(f"_{a}{b}") for k, a in enumerate(XYZ) for b in XYZ[k:]]))), keys)
    e = F.col("_e")
    raw = [e[9 + k] for k in range(3)]
    ahead = dot([F.col("_last")[k] - F.col("_first")[k] for k in range(3)], raw)
    sign = F.when(ahead < 0, -1.0).otherwise(1.0)
    named = eigen.select(*keys, *[F.col(f"_o{a}").alias(f"o{a}") for a in XYZ], F.array(*[sign * v for v in raw]).alias("along"),
                         F.array(*[e[6 + k] for k in range(3)]).alias("across"), "_first", "_last")
    up = cross([F.col("along")[k] for k in range(3)], [F.col("across")[k] for k in range(3)])
    return named.withColumn("up", F.array(*up))


def track_coordinates(points: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """Positions in track coordinates: along, across, out of plane."""
    joined = join_keys(points, axes.select(*keys, "ox", "oy", "oz", "along", "across", "up"), keys)
    rel = [F.col(a) - F.col(f"o{a}") for a in XYZ]
    return joined.withColumns({f"track_{n}": dot(rel, [F.col(n)[k] for k in range(3)]) for n in ("along", "across", "up")}).drop(
        "ox", "oy", "oz", "along", "across", "up")


def error_components(errors: DataFrame, keys: list[str]) -> DataFrame:
    """RMS position error split along, across and out of plane of the reference track."""
    rows = errors.withColumns({a: F.col("T_ref")[4 * k + 3] for k, a in enumerate(XYZ)})
    axes = principal_axes(rows, keys)
    joined = join_keys(errors, axes.select(*keys, "along", "across", "up"), keys)
    gap = [F.col("T_fit")[4 * k + 3] - F.col("T_ref")[4 * k + 3] for k in range(3)]
    parts = {n: dot(gap, [F.col(n)[k] for k in range(3)]) for n in ("along", "across", "up")}
    return joined.groupBy(*keys).agg(*[F.sqrt(F.avg(p * p)).alias(f"rms_{n}") for n, p in parts.items()])


def positions_in_list(rows: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """One-based position of each row in its key's frame order."""
    return running_total(rows, keys, "frame", F.lit(1), name)


def first_later(rows: DataFrame, keys: list[str], value: str, distance: float, block: int = 64) -> DataFrame:
    """For every row the first later row (by pos) whose value differs by at least distance: later_pos. Rows without one
    are left out before any search. The search meets a row only with its own and the next block of positions; blocks
    double for the rows that need to look farther."""
    reach = following_extremes(rows, keys, "pos", value)
    v = F.col(value)
    pending = cut_lineage(reach.where((F.col("later_max") - v >= distance) | (v - F.col("later_min") >= distance)).select(*keys, "pos", value))
    table = cut_lineage(rows.select(*keys, F.col("pos").alias("later_pos"), v.alias("_lv")))
    found = None
    while not pending.limit(1).isEmpty():
        start = F.floor(F.col("pos") / block).cast("long")
        asked = pending.withColumn("_b", F.explode(F.array(start, start + 1)))
        hits = (asked.join(table.withColumn("_b", F.floor(F.col("later_pos") / block).cast("long")), [*keys, "_b"])
                .where((F.col("later_pos") > F.col("pos")) & (F.abs(F.col("_lv") - v) >= distance))
                .groupBy(*keys, "pos").agg(F.min("later_pos").alias("later_pos")))
        hits = cut_lineage(hits)
        found = hits if found is None else found.unionByName(hits)
        pending = cut_lineage(pending.join(hits.select(*keys, "pos"), [*keys, "pos"], "left_anti"))
        block *= 4
    if found is None:
        found = pending.select(*keys, "pos", F.col("pos").alias("later_pos"))
    return found


def relative_errors(errors: DataFrame, keys: list[str], distance: float = 50.0) -> DataFrame:
    """Relative pose error over a travelled distance: each frame with the first later one at least that far along the
    track; error of the relative motion in percent of it and in degrees."""
    rows = errors.withColumns({a: F.col("T_ref")[4 * k + 3] for k, a in enumerate(XYZ)})
    axes = principal_axes(rows, keys)
    tracked = track_coordinates(rows.select(*keys, "frame", *XYZ, "T_ref", "T_est"), axes, keys)
    numbered = cut_lineage(positions_in_list(tracked.select(*keys, "frame", "track_along", "T_ref", "T_est"), keys))
    pairs = first_later(numbered, keys, "track_along", distance)
    later = numbered.select(*keys, F.col("pos").alias("later_pos"), F.col("frame").alias("later_frame"), F.col("T_ref").alias("T_ref2"), F.col("T_est").alias("T_est2"))
    joined = numbered.join(pairs, [*keys, "pos"]).join(later, [*keys, "later_pos"])
    relative = cut_lineage(joined.select(*keys, "frame", "later_frame", compose(inverse("T_ref"), F.col("T_ref2")).alias("_rr"),
                                         compose(inverse("T_est"), F.col("T_est2")).alias("_re")))
    error = compose(inverse("_rr"), F.col("_re"))
    shift, _ = motion("_rr")
    sized = relative.withColumns({"_err": error, "_len": shift})
    wrong, turned = motion("_err")
    return cut_lineage(sized.select(*keys, "frame", "later_frame", F.try_divide(wrong * 100, F.col("_len")).alias("rpe_percent"), turned.alias("rpe_deg")))


def relative_summary(relative: DataFrame, keys: list[str]) -> DataFrame:
    return join_keys(_stats(relative, keys, "rpe_percent", "rpe_percent"), _stats(relative, keys, "rpe_deg", "rpe_deg"), keys)


def travel(points: DataFrame, keys: list[str]) -> DataFrame:
    """End-to-end span, range along the main direction, and RMS distance off that line."""
    axes = principal_axes(points, keys)
    tracked = track_coordinates(points.select(*keys, "frame", *XYZ), axes, keys)
    off = F.col("track_across") * F.col("track_across") + F.col("track_up") * F.col("track_up")
    spread = tracked.groupBy(*keys).agg((F.max("track_along") - F.min("track_along")).alias("range_mm"), F.sqrt(F.avg(off)).alias("off_line_mm"))
    span = axes.select(*keys, norm(*[F.col("_last")[k] - F.col("_first")[k] for k in range(3)]).alias("travel_mm"))
    return join_keys(span, spread, keys)


def travel_ratio(errors: DataFrame, keys: list[str]) -> DataFrame:
    """End-to-end span of the aligned estimate over the reference's, on the common frames (null for no motion)."""
    ends = errors.groupBy(*keys).agg(*[f(F.array(*[F.col(m)[4 * k + 3] for k in range(3)]), "frame").alias(f"_{m}{n}")
                                       for m in ("T_ref", "T_fit") for n, f in (("a", F.min_by), ("z", F.max_by))])

    def span(m):
        return norm(*[F.col(f"_{m}z")[k] - F.col(f"_{m}a")[k] for k in range(3)])

    return ends.select(*keys, span("T_ref").alias("travel_mm"), F.when(span("T_ref") > 0, span("T_fit") / span("T_ref")).alias("travel_ratio"))


def steps(points: DataFrame, keys: list[str]) -> DataFrame:
    """Each posed frame's step from the posed frame before it: step (null for the first)."""
    lagged = ordered_lag(points, keys, "frame", ["frame", *XYZ])
    gap = norm(*[F.col(a) - F.col(f"prev_{a}") for a in XYZ])
    return lagged.withColumn("step", gap)


# Failure criteria of a trajectory.
CRITERIA = {"min_posed_fraction": 0.8, "max_jump_mm": 40.0, "max_jump_fraction": 0.05}


def assess(frames: DataFrame, estimate: DataFrame, keys: list[str], criteria: dict = CRITERIA) -> DataFrame:
    """Per key whether a trajectory failed: too few frames posed, or too many steps above the jump length; both shares
    rounded half-to-even to 3 digits, with the reasons."""
    good = with_position(posed(estimate)).select(*keys, "frame", *XYZ)
    moves = steps(good, keys).groupBy(*keys).agg(
        F.count("*").alias("posed"), F.count("step").alias("_steps"), F.count(F.when(F.col("step") > criteria["max_jump_mm"], 1)).alias("jumps"))
    listed = frames.select(*keys, "frame").distinct().groupBy(*keys).agg(F.count("*").alias("frames"))
    rows = listed.join(moves, keys, "left") if keys else listed.join(F.broadcast(moves), F.lit(True), "left")
    return _verdict(rows.na.fill(0, ["posed", "_steps", "jumps"]), keys, criteria)


def _verdict(rows: DataFrame, keys: list[str], criteria: dict) -> DataFrame:
    """From counts (frames, posed, _steps, jumps) per key the shares, whether they fail the criteria, and why."""
    share, jumpy = F.col("posed") / F.col("frames"), F.coalesce(F.try_divide(F.col("jumps"), F.col("_steps")), F.lit(0.0))
    few = F.when(share < criteria["min_posed_fraction"], F.format_string(
        f"posed %d/%d < {100 * criteria['min_posed_fraction']:.0f}%%", "posed", "frames"))
    wild = F.when(jumpy > criteria["max_jump_fraction"], F.format_string(
        f"%d jumps > {criteria['max_jump_mm']:g} mm (%d%% of steps)", "jumps", F.bround(jumpy * 100).cast("long")))
    reasons = F.array_compact(F.array(few, wild))
    return rows.select(*keys, "frames", "posed", F.bround(share, 3).alias("posed_fraction"), "jumps", F.bround(jumpy, 3).alias("jump_fraction"),
                       (F.size(reasons) > 0).alias("failed"), reasons.alias("reasons"))


def candidate_starts(sizes: DataFrame, step: int, fraction: float, n: str = "frames") -> DataFrame:
    """Later start frames to try: step, 2 step, ... up to a fraction of the pass, as rows, after start 0."""
    last = F.floor(F.col(n) * fraction).cast("long")
    some = F.when(last >= step, F.sequence(F.lit(step).cast("long"), last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return sizes.withColumn("start", F.explode(F.concat(F.array(F.lit(0).cast("long")), some)))


def assess_starts(frames: DataFrame, estimate: DataFrame, keys: list[str], step: int, fraction: float, criteria: dict = CRITERIA) -> DataFrame:
    """assess for the run from frame 0 and from every candidate start on, as (keys, start, ...).

    Starts are whole multiples of step, so frames are counted once per block of step frames, and what follows a start is
    the sum over its own and all later blocks. A step counts in the block of the frame it leaves from: in a run that
    starts later it does not happen."""
    listed = frames.select(*keys, "frame").distinct()
    moves = steps(with_position(posed(estimate)).select(*keys, "frame", *XYZ), keys)
    starts = candidate_starts(listed.groupBy(*keys).agg(F.count("*").alias("frames")), step, fraction).select(*keys, "start")
    names = ["frames", "posed", "_steps", "jumps"]

    def counted(rows: DataFrame, at: str, **counts: Column) -> DataFrame:
        return rows.select(*keys, (-F.floor(F.col(at) / step)).cast("long").alias("_back"), counts.get("start", F.lit(None).cast("long")).alias("start"),
                           *[counts.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    left_from = moves.where(F.col("step").isNotNull())
    parts = [counted(starts, "start", start=F.col("start")), counted(listed, "frame", frames=F.lit(1)), counted(moves, "frame", posed=F.lit(1)),
             counted(left_from, "prev_frame", _steps=F.lit(1), jumps=F.when(F.col("step") > criteria["max_jump_mm"], 1).otherwise(0))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    blocks = union.groupBy(*keys, "_back").agg(F.max("start").alias("start"), *[F.sum(n).alias(f"_{n}_here") for n in names])
    totals = running_totals(blocks, keys, "_back", {n: F.col(f"_{n}_here") for n in names})
    # a start without a frame from it on lists nothing, as a plain assessment of no frames
    return _verdict(totals.where(F.col("start").isNotNull() & (F.col("frames") > 0)), [*keys, "start"], criteria)


def choose_restart(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """From assessed attempts (keys, start, failed): the first start that passed, null where none did or the run from
    frame 0 passed, and the attempts made until then."""
    passing = attempts.groupBy(*keys).agg(F.min(F.when(~F.col("failed"), F.col("start"))).alias("_first"))
    joined = join_keys(attempts, passing, keys)
    made = joined.where(F.col("_first").isNull() | (F.col("start") <= F.col("_first")))
    return made.groupBy(*keys).agg(F.count("*").alias("attempts"), F.first(F.when(F.col("_first") > 0, F.col("_first"))).alias("kept_start"))


def step_statistics(points: DataFrame, keys: list[str]) -> DataFrame:
    return exact_quantiles(steps(points, keys), keys, "step", {"p95_step": ("linear", 0.95)})


def anchor_method(statistics: DataFrame, by: list[str], method: str = "method") -> DataFrame:
    """The smoothest method per recording."""
    return statistics.groupBy(*by).agg(F.min(F.struct("p95_step", method)).alias("_b")).select(*by, F.col(f"_b.{method}").alias("anchor"), F.col("_b.p95_step").alias("p95_step"))


def clean_reference(points: DataFrame, keys: list[str], window: int = 5, limit: float = 30.0) -> DataFrame:
    """Reference positions with a flag dropped: a frame is predicted by every neighbour within window frame numbers plus
    the median velocity; with at least three predictions it must lie within limit of their component-wise median.

    A frame meets at most 2 x window others, by equality on the frame number."""
    lagged = ordered_lag(points, keys, "frame", ["frame", *XYZ]).where(F.col("prev_frame").isNotNull())
    speed = None
    for a in XYZ:
        one = exact_quantiles(lagged, keys, (F.col(a) - F.col(f"prev_{a}")) / (F.col("frame") - F.col("prev_frame")), {f"v{a}": ("linear", 0.5)})
        speed = one if speed is None else join_keys(speed, one, keys)
    offsets = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    asked = points.select(*keys, "frame").withColumn("_d", F.explode(offsets)).withColumn("_m", F.col("frame") + F.col("_d"))
    near = asked.join(points.select(*keys, F.col("frame").alias("_m"), *[F.col(a).alias(f"n{a}") for a in XYZ]), [*keys, "_m"])
    predicted = join_keys(near, speed, keys).select(*keys, "frame", *[(F.col(f"n{a}") - F.col(f"v{a}") * F.col("_d")).alias(f"p{a}") for a in XYZ])
    # at most 2 x window predictions per frame: a bounded list
    middle = predicted.groupBy(*keys, "frame").agg(F.count("*").alias("predictions"), *[F.percentile(f"p{a}", 0.5).alias(f"m{a}") for a in XYZ])
    judged = points.join(middle, [*keys, "frame"], "left")
    far = norm(*[F.col(a) - F.col(f"m{a}") for a in XYZ]) > limit
    return judged.withColumn("dropped", F.coalesce((F.col("predictions") >= 3) & far, F.lit(False))).drop("mx", "my", "mz")


def path_segments(points: DataFrame, keys: list[str], jump_mm: float = 40.0) -> DataFrame:
    """Posed frames with the number of their path segment: a step above jump_mm starts a new one."""
    moved = steps(points, keys)
    return running_total(moved, keys, "frame", F.when(F.col("step") > jump_mm, 1).otherwise(0), "segment").drop(
        "prev_frame", *[f"prev_{a}" for a in XYZ])


def nearest_posed(frames: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Every listed frame with the posed frame nearest to it by list position (the earlier on a tie)."""
    listed = positions_in_list(frames.select(*keys, "frame").distinct(), keys)
    have = listed.join(poses.where(F.col("T").isNotNull()).select(*keys, "frame"), [*keys, "frame"], "left_semi")
    return nearest_in_time(listed, have, keys, "pos", "frame", 100_000).select(*keys, "frame", F.col("left_frame").alias("source_frame"))


def travel_directions(frames: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Unit direction of travel in each frame's camera, using the nearest posed frame's rotation where it has no pose."""
    good = with_position(poses.where(F.col("T").isNotNull()))
    axes = principal_axes(good.select(*keys, "frame", *XYZ), keys).select(*keys, "along")
    used = nearest_posed(frames, poses, keys).join(good.select(*keys, F.col("frame").alias("source_frame"), "T"), [*keys, "source_frame"])
    m = F.col("T")
    turned = [F.col("along")[0] * m[k] + F.col("along")[1] * m[4 + k] + F.col("along")[2] * m[8 + k] for k in range(3)]
    return join_keys(used, axes, keys).select(*keys, "frame", "source_frame", *[c.alias(n) for c, n in zip(turned, ("dx", "dy", "dz"))])


def comparison_table(tables: list[DataFrame], reference: DataFrame, keys: list[str], metadata: DataFrame | None = None) -> DataFrame:
    """One row per recording and method: the methods' tables left-joined on their keys, the reference row first. Methods
    without rows in the first table are absent. metadata adds seconds and frames; s_per_frame is null unless both are."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, keys, "left")
    if metadata is not None:
        out = out.join(metadata, keys, "left")
    both = out.withColumn("_order", F.lit(1)).unionByName(reference.withColumn("_order", F.lit(0)), allowMissingColumns=True)
    if metadata is not None:
        both = both.withColumn("s_per_frame", F.when((F.col("seconds") != 0) & (F.col("seconds_frames") != 0), F.col("seconds") / F.col("seconds_frames")))
    return both.orderBy(keys[0], "_order", *keys[1:]).drop("_order")


def edge_lengths(corners: DataFrame, keys: list[str]) -> DataFrame:
    """Four edges per tag: corner k to corner (k + 1) mod 4, met by equality on the corner number."""
    step = corners.select(*keys, F.pmod(F.col("corner") - 1, F.lit(4)).alias("corner"), *[F.col(a).alias(f"e{a}") for a in XYZ])
    return corners.join(step, [*keys, "corner"]).select(*keys, "corner", norm(*[F.col(a) - F.col(f"e{a}") for a in XYZ]).alias("edge_mm"))


def layout_report(layout: DataFrame, observations: DataFrame, fits: DataFrame, printed_mm: float) -> DataFrame:
    """One row: layout edge mean and deviation, scale against the printed edge, flatness RMS (z), median and maximum fit
    residual, 5 to 95 % band of single-frame edges."""
    edges = edge_lengths(layout.where(F.col("x").isNotNull()), ["tag"])
    one = edges.agg(F.avg("edge_mm").alias("edge_mean_mm"), F.stddev_pop("edge_mm").alias("edge_sd_mm"), (F.avg("edge_mm") / printed_mm).alias("scale"))
    flat = layout.agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("flatness_mm"), F.countDistinct("tag").alias("tags"))
    worst = with_quantiles(fits, fits.agg(F.max("rms").alias("fit_max_mm")), [], "rms", {"fit_median_mm": ("linear", 0.5)})
    single = exact_quantiles(edge_lengths(observations, ["frame", "tag"]), [], "edge_mm", {"edge_p5_mm": ("linear", 0.05), "edge_p95_mm": ("linear", 0.95)})
    return one.crossJoin(F.broadcast(flat)).crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(single))


def tags_per_frame(observations: DataFrame) -> DataFrame:
    return observations.groupBy("frame").agg(F.countDistinct("tag").alias("tags")).groupBy("tags").agg(F.count("*").alias("frames"))


def coalesce_poses(frames: DataFrame, left: DataFrame, right: DataFrame, right_left: list[float], keys: list[str]) -> DataFrame:
    """Camera poses T (world to left camera) per listed frame: the left image's, else the right image's brought over by
    the inverse rig motion; then re-based so that the key's first posed frame is the world; unposed frames stay, null."""
    rig = F.array(*[F.lit(float(v)) for v in right_left])
    rows = (frames.select(*keys, "frame").join(left.select(*keys, "frame", F.col("T").alias("_l")), [*keys, "frame"], "left")
            .join(right.select(*keys, "frame", F.col("T").alias("_r")), [*keys, "frame"], "left"))
    brought = F.when(F.col("_r").isNotNull(), compose(inverse(rig), F.col("_r")))
    merged = rows.withColumn("_t", F.coalesce("_l", brought))
    first = merged.where(F.col("_t").isNotNull()).groupBy(*keys).agg(F.min_by("_t", "frame").alias("_w"))
    based = merged.join(first, keys, "left") if keys else merged.join(F.broadcast(first), F.lit(True), "left")
    return based.select(*keys, "frame", F.when(F.col("_t").isNotNull(), compose("_t", inverse("_w"))).alias("T"))
