"""Registered queries: fits, registration and trajectory analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions import geometry as g
from stratacloud.functions.columns import quantise
from stratacloud.operators import cloud, fit, registration
from stratacloud.operators import trajectory as t
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql
from stratacloud.plans.neighbourhoods import mesh
from stratacloud.plans.selection import _ROT, with_pose
from stratacloud.session import cut_lineage

EDGE = 35.355339
RIG = [1.0, 0, 0, -120.0, 0, 0.8, -0.6, 5.0, 0, 0.6, 0.8, 2.0, 0, 0, 0, 1.0]


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def reference(spark, sf):
    return with_pose(b.poses(spark, sf)).select(F.col("recording").cast("long").alias("recording"), "frame", "T", F.lit(0).alias("lost"))


def estimate(spark, sf):
    poses = b.poses(spark, sf)
    shifted = poses.withColumns({f"t{a}": F.col(f"t{a}") + F.col(f"e{a}") for a in "xyz"})
    return with_pose(shifted).select(F.col("recording").cast("long").alias("recording"), "frame", "T", "lost")


def positions(spark, sf):
    return t.with_position(reference(spark, sf)).select("recording", "frame", "x", "y", "z")


def pose_entries(df, name="T", rows=12, digits=4):
    return [quantise(F.col(name)[k], digits).alias(f"t{k}") for k in range(rows)]


def _pairs(spark, sf):
    """Points of each scan with the same points turned, shifted and disturbed."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return b.points(spark, sf).select(
        "scan", x.alias("sx"), y.alias("sy"), z.alias("sz"), (0.8 * x - 0.6 * y + 5 + F.col("grey") / 500).alias("tx"),
        (0.6 * x + 0.8 * y - 3 + F.col("frame") / 400).alias("ty"), (z + 2 - F.col("grey") / 300).alias("tz"))


def f1(spark, sf):
    out = fit.align(_pairs(spark, sf), ["scan"])
    return out.select("scan", *pose_entries(out, digits=3), quantise("rms").alias("rms"), "n")


def f2(spark, sf):
    out = fit.align(_pairs(spark, sf), ["scan"], with_scale=True)
    return out.select("scan", quantise("scale").alias("scale"), quantise("rms").alias("rms"), "n")


def f3(spark, sf):
    return quantised(fit.lever_points(reference(spark, sf), 100.0).select("recording", "frame", F.col("point").cast("long").alias("point"), "x", "y", "z"), "x", "y", "z")


def f4(spark, sf):
    mean = fit.mean_rotation(estimate(spark, sf), ["recording"])
    return mean.select("recording", *[quantise(F.col("R")[k]).alias(f"r{k}") for k in range(9)], "n")


def f4_common(spark, sf):
    freed = fit.remove_common(estimate(spark, sf), ["recording"])
    shift, _ = g.motion("T")
    return freed.groupBy("recording").agg(quantise(F.avg(shift), 3).alias("mean_shift"), F.count("*").alias("n"))


def f5(spark, sf):
    return quantised(fit.plane_fit(b.points(spark, sf), ["scan", "method"]), "a", "b", "c", "tilt_deg", digits=5)


def f5_orthogonal(spark, sf):
    tilted = b.points(spark, sf).withColumn("z", F.col("z") / 20 + F.col("x") / 10 - F.col("y") / 40)
    return quantised(fit.orthogonal_plane(tilted, ["scan"]), "nx", "ny", "nz", "offset", "rms")


def f6(spark, sf):
    level = fit.local_levelling(b.points(spark, sf), (20.0, 30.0, 40.0, 60.0), ["scan"], (5.0, 20.0))
    return quantised(level.drop("level"), "a", "b", "c", "offset_mm", "tilt_deg", digits=5)


def f7(spark, sf):
    pairs = fit.pose_pairs(estimate(spark, sf), reference(spark, sf), ["recording"], 100.0)
    fitted, judged = fit.gated_align(pairs, ["recording"], "frame", 3, 0.5, 1.2)
    kept = judged.groupBy("recording").agg(F.count(F.when(F.col("keep"), 1)).alias("kept"), quantise(F.avg("error")).alias("error"))
    return fitted.select("recording", quantise("rms").alias("rms")).join(kept, "recording")


def f8(spark, sf):
    best = registration.fit_model(b.points(spark, sf).select("x", "y", "z"), mesh(spark, sf), min_height=3.0)
    return best.select("start", "inliers", "rms", "off_square_deg")


def f9(spark, sf):
    points = b.points(spark, sf).select("scan", "method", "x", "y", "z")
    moved = points.where("method = 'F'").withColumn("x", F.col("x") + 0.3)
    fitted = registration.refine_icp(moved, points.where("method = 'O'"), ["scan"], 2.0, 4.0, iterations=3)
    return fitted.select("scan", "fitness", "inlier_rmse")


def f9_point(spark, sf):
    points = b.points(spark, sf).select("scan", "method", "x", "y", "z")
    fitted = registration.align_to(points.where("method = 'F'"), points.where("method = 'O'"), ["scan"], 2.0)
    return fitted.select("scan", "fitness", "inlier_rmse", "shift_mm", "turn_deg")


def f10(spark, sf):
    _, rounds = registration.refine_frames(b.points(spark, sf))
    return rounds


def d5(spark, sf):
    frames = b.points(spark, sf).select("frame", "x", "y", (F.col("z") * 0.5 + 100).alias("z"), "grey")
    poses = b.poses(spark, sf).select("frame", g.quaternion_pose(
        [F.lit(1.0), F.col("qx") * 0.02, F.col("qy") * 0.02, F.col("qz") * 0.02], [F.col("tx") / 50, F.col("ty") / 50, F.col("tz") / 50]).alias("T"))
    voxels = cloud.tsdf_voxels(frames, poses, 2.0, 4.0, 2.0, 3)
    return quantised(cloud.tsdf_surface(voxels, 2.0), "x", "y", "z", "grey")


def observations(spark, sf):
    """Tags seen per frame: a board four tags wide under each pose of the binding, for all tags detected in that image, with a
    disturbance from the detection's own position."""
    seen = b.detections(spark, sf).groupBy("image", "tag").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    poses = b.poses(spark, sf).select(F.col("frame").alias("image"), g.quaternion_pose(
        [F.lit(1.0), F.col("qx") * 0.3, F.col("qy") * 0.3, F.col("qz") * 0.3], [F.col("tx"), F.col("ty"), F.col("tz") + 400]).alias("P"))
    model = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(x).alias("mx"), F.lit(y).alias("my")) for k, (x, y, _) in enumerate(fit.tag_model(EDGE))])
    corners = seen.join(poses, "image").withColumn("_c", F.explode(model))
    board = [F.col("_c.mx") + (F.col("tag") % 4) * 46, F.col("_c.my") + F.floor(F.col("tag") / 4) * 46, F.lit(0.0)]
    noise = [F.sin(F.col("u") + F.col("_c.corner")) / 5, F.cos(F.col("v") + F.col("_c.corner")) / 5, F.sin(F.col("u") + F.col("v")) / 5]
    moved = g.apply_pose("P", board)
    return corners.select(F.col("image").alias("frame"), "tag", F.col("_c.corner").alias("corner"),
                          *[(m + n).alias(a) for m, n, a in zip(moved, noise, "xyz")])


def _layout(spark, sf, seen):
    return fit.refine_layout(seen, fit.initial_layout(seen, EDGE))


def f12(spark, sf):
    return fit.initial_layout(cut_lineage(observations(spark, sf)), EDGE)


def f13(spark, sf):
    return _layout(spark, sf, cut_lineage(observations(spark, sf)))


def f14(spark, sf):
    seen = cut_lineage(observations(spark, sf))
    layout = _layout(spark, sf, seen)
    poses = fit.frame_poses(layout, seen)
    return fit.board_frame(layout, 0, poses).select(*[F.col("T")[k].alias(f"t{k}") for k in range(12)])


def f15(spark, sf):
    seen = cut_lineage(observations(spark, sf))
    return fit.frame_poses(fit.initial_layout(seen, EDGE), seen).select("frame", "rms", "tags")


def f16(spark, sf):
    seen = cut_lineage(observations(spark, sf))
    parts = [fit.initial_layout(seen.where(F.col("frame") % 2 == k), EDGE).withColumn("scan", F.lit(k)) for k in (0, 1)]
    whole = fit.initial_layout(seen, EDGE)
    target = whole.crossJoin(F.broadcast(whole.sparkSession.range(2).select(F.col("id").cast("int").alias("scan"))))
    return fit.layout_transform(parts[0].unionByName(parts[1]), target, ["scan"]).select("scan", "rms", "n", "shared_tags")


def f17(spark, sf):
    out = fit.trajectory_alignment(t.posed(estimate(spark, sf)), reference(spark, sf), ["recording"])
    return quantised(out.drop("T"), "median", "rmse", "max")


def f18(spark, sf):
    rows = b.cost_samples(spark, sf).selectExpr("stage", "run", "CASE WHEN stage = 'view' THEN 5.0D ELSE CAST(run + 1 AS DOUBLE) END AS frames", "rss_mb")
    return quantised(fit.trend(rows, ["stage"], "frames", "rss_mb"), "slope", "intercept")


def _jacobians(spark, sf):
    u, v = F.col("u") / 800, F.col("v") / 600
    jp = F.array(u, v, u * v, F.lit(1.0))
    jq = F.array(v, u * u, v * v, u * u * v, F.sin(u * 5), F.cos(v * 7))
    return b.residuals(spark, sf).select("technique", "frame", jp.alias("jp"), jq.alias("jq"), F.col("du").alias("r"))


def f19(spark, sf):
    return fit.intrinsic_covariance(_jacobians(spark, sf), 4, ["technique"]).select(
        "technique", *[F.col("sigma")[k].alias(f"sigma{k}") for k in range(4)], F.col("correlation")[1].alias("corr01"), "sigma_px", "dof", "frames")


def g1(spark, sf):
    frames = b.poses(spark, sf).select(F.col("recording").cast("long").alias("recording"), "frame")
    ref = reference(spark, sf).where(F.col("frame") % 3 != 0)
    return quantised(t.registration(frames, estimate(spark, sf), ref, ["recording"]), "registration")


def _errors(spark, sf):
    return t.aligned_errors(estimate(spark, sf), reference(spark, sf), ["recording"])


def g2(spark, sf):
    return t.absolute_error(_errors(spark, sf), ["recording"])


def g3(spark, sf):
    return t.relative_summary(t.relative_errors(_errors(spark, sf), ["recording"], 20.0), ["recording"])


def g4(spark, sf):
    return t.error_components(_errors(spark, sf), ["recording"])


def g5(spark, sf):
    return t.travel(positions(spark, sf), ["recording"]).join(
        t.travel_ratio(_errors(spark, sf), ["recording"]).drop("travel_mm"), "recording")


def g5_span(spark, sf):
    return quantised(t.travel(positions(spark, sf), ["recording"]).select("recording", "travel_mm"), "travel_mm")


def g6(spark, sf):
    frames = reference(spark, sf).select("recording", "frame")
    verdict = t.assess(frames, estimate(spark, sf), ["recording"], {**t.CRITERIA, "max_jump_mm": 30.0, "max_jump_fraction": 0.2})
    return verdict.withColumn("reasons", F.concat_ws("; ", "reasons")).withColumns(
        {c: quantise(c) for c in ("posed_fraction", "jump_fraction")})


def g7(spark, sf):
    criteria = {**t.CRITERIA, "max_jump_mm": 22.0, "max_jump_fraction": 0.3, "min_posed_fraction": 0.75}
    verdicts = t.assess_starts(reference(spark, sf), estimate(spark, sf), ["recording"], 5, 0.7, criteria)
    return t.choose_restart(verdicts, ["recording"])


def _by_method(spark, sf):
    e = t.with_position(t.posed(estimate(spark, sf))).select("recording", "frame", "x", "y", "z", F.lit("est").alias("method"))
    return e.unionByName(positions(spark, sf).withColumn("method", F.lit("ref")))


def g8(spark, sf):
    return quantised(t.anchor_method(t.step_statistics(_by_method(spark, sf), ["recording", "method"]), ["recording"]), "p95_step")


def g9(spark, sf):
    every = positions(spark, sf).select((F.col("recording") % 3).alias("recording"), "frame", "x", "y", "z")
    return t.clean_reference(every, ["recording"], 5, 25.0).select("recording", "frame", F.coalesce("predictions", F.lit(0).cast("long")).alias("predictions"), "dropped")


def g10(spark, sf):
    return t.path_segments(positions(spark, sf), ["recording"], 22.0).select("recording", "frame", F.col("segment").cast("long").alias("segment"))


def g11(spark, sf):
    good = estimate(spark, sf).where("lost = 0")
    return t.nearest_posed(reference(spark, sf).select("recording", "frame"), good, ["recording"])


def g12(spark, sf):
    keys = ["recording", "method"]
    est = estimate(spark, sf).withColumn("method", F.lit("est"))
    ref = reference(spark, sf)
    frames = ref.select("recording", "frame").withColumn("method", F.lit("est"))
    counts = t.registration(frames, est, ref.withColumn("method", F.lit("est")), keys).select(*keys, "frames", "posed")
    smooth = t.step_statistics(_by_method(spark, sf), keys)
    seconds = b.cost_samples(spark, sf).groupBy(F.col("run").alias("recording")).agg(F.sum("rss_mb").alias("seconds"), F.count("*").alias("seconds_frames")) \
        .withColumn("method", F.lit("est"))
    first = ref.groupBy("recording").agg(F.count("*").alias("frames"), F.count("T").alias("posed")).withColumn("method", F.lit("ref"))
    table = t.comparison_table([counts, smooth], first, keys, seconds)
    return table.select("recording", "method", "frames", "posed", quantise("p95_step").alias("p95_step"), quantise("s_per_frame", 3).alias("s_per_frame"))


def g13(spark, sf):
    seen = cut_lineage(observations(spark, sf))
    layout = _layout(spark, sf, seen)
    return t.layout_report(layout, seen, fit.frame_poses(layout, seen), EDGE)


def g13_histogram(spark, sf):
    seen = b.detections(spark, sf).select(F.col("image").alias("frame"), "tag")
    return t.tags_per_frame(seen)


def g14(spark, sf):
    ref = reference(spark, sf)
    merged = t.coalesce_poses(ref.select("recording", "frame"), ref.where("frame % 3 = 0"), ref.where("frame % 3 = 1"), RIG, ["recording"])
    return merged.select("recording", "frame", *pose_entries(merged))


QUERIES = {
    "f1_rigid_fit": f1, "f2_similarity_fit": f2, "f3_lever_points": f3, "f4_mean_rotation": f4, "f4_remove_common": f4_common,
    "f5_plane_fit": f5, "f5_orthogonal_plane": f5_orthogonal, "f6_local_levelling": f6, "f7_gated_refit": f7, "f8_model_to_scan": f8,
    "f9_cloud_icp": f9, "f9_point_icp": f9_point, "f10_frame_refinement": f10, "d5_tsdf_surface": d5, "f12_initial_layout": f12, "f13_refine_layout": f13,
    "f14_board_frame": f14, "f15_frame_poses": f15, "f16_layout_transform": f16, "f17_trajectory_alignment": f17, "f18_trend": f18,
    "f19_covariance": f19, "g1_registration": g1, "g2_absolute_error": g2, "g3_relative_error": g3, "g4_error_components": g4,
    "g5_travel": g5, "g5_span": g5_span, "g6_assess": g6, "g7_restart": g7, "g8_anchor_method": g8, "g9_clean_reference": g9, "g10_path_segments": g10,
    "g11_nearest_posed": g11, "g12_comparison_table": g12, "g13_layout_report": g13, "g13_tags_per_frame": g13_histogram, "g14_coalesce_poses": g14,
}

_POS = """, pos AS (SELECT recording::BIGINT AS recording, frame, tx AS x, ty AS y, tz AS z FROM poses),
est AS (SELECT recording::BIGINT AS recording, frame, tx + ex AS x, ty + ey AS y, tz + ez AS z FROM poses WHERE lost = 0)
"""


def _steps(source, name, extra=""):
    return f""", {name} AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step
      FROM {source} WINDOW w AS (PARTITION BY recording{extra} ORDER BY frame))"""


_M = ("r00", "r01", "r02", "tx", "r10", "r11", "r12", "ty", "r20", "r21", "r22", "tz")


def _rebase():
    """Pose entries T_f T_w^-1, T_f from the left pose or the right one through the rig."""
    rig = RIG
    brought = []
    for r in range(3):
        for c in range(4):
            terms = []
            for k in range(3):
                entry = _M[4 * k + c]
                value = f"({entry})" if c < 3 else f"({entry} - ({rig[4 * k + 3]!r}))"
                terms.append(f"{float(rig[4 * k + r])!r} * {value}")
            brought.append("(" + " + ".join(terms) + ")")
    merged = ", ".join(f"CASE WHEN frame % 3 = 0 THEN {m} WHEN frame % 3 = 1 THEN {br} END AS m{k}" for k, (m, br) in enumerate(zip(_M, brought)))
    out = []
    for r in range(3):
        for c in range(3):
            out.append(" + ".join(f"a.m{4 * r + k} * w.m{4 * c + k}" for k in range(3)))
        shift = " - ".join([f"a.m{4 * r + 3}"] + [f"({' + '.join(f'a.m{4 * r + k} * w.m{4 * c + k}' for k in range(3))}) * w.m{4 * c + 3}" for c in range(3)])
        out.append(shift)
    cols = ", ".join(f"{q(o)} AS t{k}" for k, o in enumerate(out))
    return _ROT + f""", m AS (SELECT recording::BIGINT AS recording, frame, {merged} FROM rot),
      w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame) AS rn FROM m WHERE m0 IS NOT NULL) WHERE rn = 1)
      SELECT a.recording, a.frame, {cols} FROM m a LEFT JOIN w USING (recording)"""


_ASSESS = """, st AS (SELECT {k}, count(*) AS posed, count(step) AS steps, count(*) FILTER (WHERE step > {jump}) AS jumps FROM moved GROUP BY {k}),
fr AS (SELECT {k}, count(*) AS frames FROM listed GROUP BY {k}),
ass AS (SELECT fr.*, coalesce(posed, 0) AS posed, coalesce(jumps, 0) AS jumps, coalesce(posed, 0) / frames AS share,
  coalesce(jumps / nullif(steps, 0), 0) AS jumpy FROM fr LEFT JOIN st USING ({k}))
"""

ORACLES = {
    "f3_lever_points": sql("poses", body=_ROT + f"""SELECT recording::BIGINT AS recording, frame, p AS point,
        {q('tx + CASE p WHEN 0 THEN 0 WHEN 1 THEN 100 * r00 WHEN 2 THEN 100 * r01 ELSE 100 * r02 END')} AS x,
        {q('ty + CASE p WHEN 0 THEN 0 WHEN 1 THEN 100 * r10 WHEN 2 THEN 100 * r11 ELSE 100 * r12 END')} AS y,
        {q('tz + CASE p WHEN 0 THEN 0 WHEN 1 THEN 100 * r20 WHEN 2 THEN 100 * r21 ELSE 100 * r22 END')} AS z
        FROM rot, (SELECT unnest([0::BIGINT, 1, 2, 3]) AS p)"""),
    "f5_plane_fit": sql("points", body=f""", m AS (SELECT scan, method, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY ALL),
        s AS (SELECT scan, method, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy,
          sum((y-my)*(y-my)) AS yy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(z-mz)) AS yz, count(*) AS n FROM points JOIN m USING (scan, method) GROUP BY scan, method),
        f AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b FROM s)
        SELECT scan, method, {q('a', 5)} AS a, {q('b', 5)} AS b, {q('mz - a*mx - b*my', 5)} AS c, {q('degrees(atan(sqrt(a*a + b*b)))', 5)} AS tilt_deg, n FROM f"""),
    "f18_trend": sql("cost_samples", body=f""", r AS (SELECT stage, CASE WHEN stage = 'view' THEN 5e0 ELSE (run + 1)::DOUBLE END AS f, rss_mb FROM cost_samples)
        SELECT stage, {q("CASE WHEN min(f) = max(f) THEN quantile_cont(rss_mb / f, 0.5) ELSE regr_slope(rss_mb, f) END")} AS slope,
        CASE WHEN min(f) <> max(f) THEN {q('regr_intercept(rss_mb, f)')} END AS intercept, count(*) AS n FROM r GROUP BY stage"""),
    "g1_registration": sql("poses", body=f"""SELECT recording::BIGINT AS recording, count(*) AS frames, count(*) FILTER (WHERE lost = 0) AS posed,
        count(*) FILTER (WHERE lost = 0 AND frame % 3 <> 0) AS with_reference, {q('count(*) FILTER (WHERE lost = 0) / count(*)')} AS registration,
        count(*) FILTER (WHERE lost = 0 AND frame % 3 <> 0) >= 3 AS comparable FROM poses GROUP BY recording"""),
    "g5_span": sql("poses", body=_POS + f"""SELECT recording, {q('sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2) + pow(arg_max(z, frame) - arg_min(z, frame), 2))')} AS travel_mm
        FROM pos GROUP BY recording"""),
    "g6_assess": sql("poses", body=_POS + _steps("est", "moved") + ", listed AS (SELECT recording, frame FROM pos)" + _ASSESS.format(k="recording", jump=30) + f"""
        SELECT recording, frames, posed, {q('round_even(share, 3)')} AS posed_fraction, jumps, {q('round_even(jumpy, 3)')} AS jump_fraction,
        share < 0.8 OR jumpy > 0.2 AS failed, concat_ws('; ', CASE WHEN share < 0.8 THEN 'posed ' || posed || '/' || frames || ' < 80%' END,
        CASE WHEN jumpy > 0.2 THEN jumps || ' jumps > 30 mm (' || round_even(jumpy * 100, 0)::BIGINT || '% of steps)' END) AS reasons FROM ass"""),
    "g7_restart": sql("poses", body=_POS + """, sz AS (SELECT recording, count(DISTINCT frame) AS n FROM pos GROUP BY recording),
        sts AS (SELECT recording, 0::BIGINT AS start FROM sz UNION ALL SELECT recording, unnest(range(5, floor(n * 0.7)::BIGINT + 1, 5)) FROM sz),
        run AS (SELECT e.*, start FROM est e JOIN sts USING (recording) WHERE frame >= start),
        listed AS (SELECT p.recording, p.frame, start FROM pos p JOIN sts USING (recording) WHERE frame >= start)""" + _steps("run", "moved", ", start") +
        _ASSESS.format(k="recording, start", jump=22) + """, v AS (SELECT recording, start, share < 0.75 OR jumpy > 0.3 AS failed FROM ass),
        p AS (SELECT recording, min(start) FILTER (WHERE NOT failed) AS f FROM v GROUP BY recording)
        SELECT recording, count(*) AS attempts, any_value(CASE WHEN f > 0 THEN f END) AS kept_start FROM v JOIN p USING (recording) WHERE f IS NULL OR start <= f GROUP BY recording"""),
    "g8_anchor_method": sql("poses", body=_POS + _steps("est", "a") + _steps("pos", "c") + f""", s AS (SELECT recording, 'est' AS m, quantile_cont(step, 0.95) AS p FROM a GROUP BY recording
        UNION ALL SELECT recording, 'ref', quantile_cont(step, 0.95) FROM c GROUP BY recording)
        SELECT recording, arg_min(m, p) AS anchor, {q('min(p)')} AS p95_step FROM s GROUP BY recording"""),
    "g9_clean_reference": sql("poses", body=_POS + """, e AS (SELECT recording % 3 AS recording, frame, x, y, z FROM pos),
        l AS (SELECT recording, (x - lag(x) OVER w) / (frame - lag(frame) OVER w) AS vx, (y - lag(y) OVER w) / (frame - lag(frame) OVER w) AS vy,
          (z - lag(z) OVER w) / (frame - lag(frame) OVER w) AS vz FROM e WINDOW w AS (PARTITION BY recording ORDER BY frame)),
        v AS (SELECT recording, quantile_cont(vx, 0.5) AS vx, quantile_cont(vy, 0.5) AS vy, quantile_cont(vz, 0.5) AS vz FROM l GROUP BY recording),
        p AS (SELECT a.recording, a.frame, count(*) AS n, quantile_cont(m.x + vx * (a.frame - m.frame), 0.5) AS px, quantile_cont(m.y + vy * (a.frame - m.frame), 0.5) AS py,
          quantile_cont(m.z + vz * (a.frame - m.frame), 0.5) AS pz FROM e a JOIN e m ON a.recording = m.recording AND a.frame <> m.frame AND abs(a.frame - m.frame) <= 5
          JOIN v ON v.recording = a.recording GROUP BY a.recording, a.frame)
        SELECT recording, frame, coalesce(n, 0) AS predictions, coalesce(n >= 3 AND sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) > 25, false) AS dropped
        FROM e LEFT JOIN p USING (recording, frame)"""),
    "g10_path_segments": sql("poses", body=_POS + _steps("pos", "c") + """SELECT recording, frame, (sum((coalesce(step, 0) > 22)::INT) OVER (PARTITION BY recording
        ORDER BY frame))::BIGINT AS segment FROM c"""),
    "g11_nearest_posed": sql("poses", body=""", l AS (SELECT recording::BIGINT AS recording, frame, lost, row_number() OVER (PARTITION BY recording ORDER BY frame) AS pos FROM poses),
        c AS (SELECT a.recording, a.frame, b.frame AS source_frame, row_number() OVER (PARTITION BY a.recording, a.frame ORDER BY abs(a.pos - b.pos), b.pos) AS rn
          FROM l a JOIN l b ON a.recording = b.recording AND b.lost = 0) SELECT recording, frame, source_frame FROM c WHERE rn = 1"""),
    "g12_comparison_table": sql("poses", "cost_samples", body=_POS + _steps("est", "a") + f""", s AS (SELECT recording, quantile_cont(step, 0.95) AS p FROM a GROUP BY recording),
        c AS (SELECT run AS recording, sum(rss_mb) / count(*) AS spf FROM cost_samples GROUP BY run)
        SELECT r.recording, 'est' AS method, r.n AS frames, r.p AS posed, {q('s.p')} AS p95_step, {q('spf', 3)} AS s_per_frame
        FROM (SELECT recording::BIGINT AS recording, count(*) AS n, count(*) FILTER (WHERE lost = 0) AS p FROM poses GROUP BY recording) r LEFT JOIN s USING (recording) LEFT JOIN c USING (recording)
        UNION ALL SELECT recording, 'ref', count(*), count(*), NULL, NULL FROM pos GROUP BY recording"""),
    "g13_tags_per_frame": sql("detections", body="""SELECT tags, count(*) AS frames FROM (SELECT image, count(DISTINCT tag) AS tags FROM detections
        GROUP BY image) GROUP BY tags"""),
    "g14_coalesce_poses": sql("poses", body=_rebase()),
}
