"""Registered queries: synchronisation, selection and column geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions import geometry as g
from stratacloud.functions.columns import quantise
from stratacloud.operators import homography, sync, views
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql

GATE_MS = 300_000.0
K = (900.0, 910.0, 800.0, 600.0)
D = (0.1, -0.05, 0.001, 0.002, 0.01)
Q = [1.0, 0, 0, -32.0, 0, 1.0, 0, -24.0, 0, 0, 0, 100.0, 0, 0, 0.02, 0]
TURN = [0.8, -0.6, 0, 5.0, 0.6, 0.8, 0, -3.0, 0, 0, 1.0, 2.0, 0, 0, 0, 1.0]


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def b1(spark, sf):
    return quantised(sync.match_left(b.timestamps(spark, sf)), "dt_ms")


def b2(spark, sf):
    pairs = sync.match_left(b.timestamps(spark, sf))
    kept = sync.gap_gate(pairs, GATE_MS)
    return sync.gap_counts(pairs, GATE_MS).crossJoin(kept.agg(quantise(F.avg("dt_ms"), 2).alias("mean_kept_ms")))


def b3(spark, sf):
    return sync.strided(b.names(spark, sf), ["url", "page_id"], 7, 3, 20).select("page_id")


def b3_range(spark, sf):
    return sync.frame_range(b.poses(spark, sf).select("recording", "frame"), "frame", 40, 400, 9) \
        .withColumn("recording", F.col("recording").cast("long"))


def _pixels(spark, sf):
    return b.rasters(spark, sf).select("frame", "row_", "col_", F.col("d").alias("v"))


def b4(spark, sf):
    return quantised(sync.sharpness(_pixels(spark, sf)), "score")


def b5(spark, sf):
    return quantised(sync.noise_sigma(_pixels(spark, sf)), "noise")


def _scores(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS camera", "o_orderkey AS name", "o_custkey AS label",
        "o_totalprice / 1000 AS blur")


def b6(spark, sf):
    return quantised(sync.blur_percentiles(_scores(spark, sf)), *[f"p{p}" for p in sync.REPORT_PERCENTILES])


def b6_thresholds(spark, sf):
    return quantised(sync.blur_thresholds(_scores(spark, sf)), "threshold")


def b6_worst(spark, sf):
    return quantised(sync.blur_verdict(sync.blurriest(_scores(spark, sf)), 2.0), "blur")


def b7(spark, sf):
    return sync.blur_select(_scores(spark, sf), percentile=60, require_pairs=True).select("camera", "name", "label")


def with_pose(poses):
    """The pose binding with its reference pose as T (camera to world)."""
    return poses.withColumn("T", g.quaternion_pose(["qw", "qx", "qy", "qz"], ["tx", "ty", "tz"]))


def b8(spark, sf):
    poses = with_pose(b.poses(spark, sf)).withColumn("n_tags", F.col("frame") % 20)
    return sync.select_posed(poses, (1.0, -2.0, 3.0), 25.0, 8).select("frame")


def _pairs(spark, sf):
    return b.detections(spark, sf).select(F.col("image").alias("pair"), "camera", "tag", "u", "v")


def b9(spark, sf):
    required = b.detections(spark, sf).where("tag IN (5, 12)").select("tag")
    return sync.tags_in_both(_pairs(spark, sf), required)


def b9_block(spark, sf):
    """Homography from the required tags' plan positions to each image, then the block against the image's region."""
    plan = b.detections(spark, sf).where("tag IN (5, 12, 20, 33, 47)").groupBy("tag").agg(
        F.avg(F.col("u") / 100).alias("px"), F.avg(F.col("v") / 100 + F.col("tag")).alias("py"))
    once = _pairs(spark, sf).groupBy("pair", "camera", "tag").agg(F.count("*").alias("n"), F.min("u").alias("u"),
                                                                  F.min("v").alias("v")).where("n = 1").drop("n")
    block = [(4.0, 10.0), (10.0, 10.0), (10.0, 30.0), (4.0, 30.0)]
    region = [(0.0, 0.0), (1600.0, 0.0), (1600.0, 1200.0), (0.0, 1200.0)]
    return homography.block_in_view(once, plan, block, region).select("pair", "camera", "tags", "inside", "reason")


def _views(spark, sf):
    poses = b.poses(spark, sf)
    length = F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + 1)
    return poses.select("frame", F.col("frame").alias("name"),
                        F.when(F.col("frame") % 2 == 0, F.col("frame") + 1).otherwise(F.col("frame") - 1).alias("partner"),
                        *[(F.col(f"t{a}") * 10).alias(f"c{a}") for a in "xyz"], (F.col("qx") / length).alias("ax"),
                        (F.col("qy") / length).alias("ay"), (1 / length).alias("az"))


def b10(spark, sf):
    return quantised(sync.source_views(_views(spark, sf), 5), "angle", digits=3)


def b11(spark, sf):
    names = b.poses(spark, sf).select("recording", F.lpad(F.col("frame").cast("string"), 8, "0").alias("name"))
    return sync.match_pairs(names, 2, keys=["recording"]).withColumn("recording", F.col("recording").cast("long"))


def _members(spark, sf):
    return b.detections(spark, sf).select("camera", "channel", "image")


def b12(spark, sf):
    middle = sync.figure_frame(_members(spark, sf), "middle", ["camera"], "channel", "image")
    capped = sync.figure_frame(_members(spark, sf), 9999, ["camera"], "channel", "image")
    return middle.join(capped.withColumnRenamed("image", "last_image"), "camera")


def b13(spark, sf):
    frames = b.poses(spark, sf).select(F.col("recording").cast("long").alias("recording"), "frame")
    return sync.spread_sample(frames, 6, "frame", ["recording"])


def b14(spark, sf):
    poses = b.poses(spark, sf).select("frame", g.quaternion_pose(
        [F.lit(1.0), F.col("qx") * 0.1, F.col("qy") * 0.1, F.col("qz") * 0.1],
        [F.col("tx") - 25, F.col("ty") - 50, F.col("tz") + 200]).alias("T"))
    return quantised(views.best_view(b.points(spark, sf), poses, (400.0, 400.0, 800.0, 600.0), (0.0,) * 5, (1600, 1200), 500),
                     "inside", "off_centre")


def c1(spark, sf):
    poses = with_pose(b.poses(spark, sf))
    e = [F.col("ex"), F.col("ey"), F.col("ez")]
    moved = poses.withColumns({"p": F.array(*g.apply_pose("T", e)), "I": g.inverse("T"), "TT": g.compose("T", "T")})
    back = g.apply_pose("I", [F.col("p")[k] for k in range(3)])
    shift, turn = g.motion("T")
    quat = g.pose_quaternion("T")
    error = F.abs(back[0] - e[0]) + F.abs(back[1] - e[1]) + F.abs(back[2] - e[2])
    return moved.select("frame", *[quantise(F.col("p")[k]).alias(a) for k, a in enumerate("xyz")],
                        quantise(shift).alias("shift_mm"), quantise(turn, 3).alias("turn_deg"),
                        quantise(g.turn_deg("TT"), 3).alias("twice_deg"),
                        *[quantise(c).alias(f"q{n}") for n, c in zip("wxyz", [quat[k] for k in range(4)])], (error < 1e-6).alias("round_trip"))


def _scene(spark, sf):
    return b.points(spark, sf).select("scan", "method", "x", "y", (F.col("z") * 10 + 200).alias("z"))


def c2(spark, sf):
    u, v = g.project([F.col("x"), F.col("y"), F.col("z")], K, D)
    seen = _scene(spark, sf).withColumn("e2", (u - F.col("x") * 32) * (u - F.col("x") * 32) + (v - F.col("y") * 11) * (v - F.col("y") * 11))
    side = [F.when(F.col("method") == m, F.col("e2")) for m in ("O", "F")]
    return seen.groupBy("scan").agg(quantise(g.reprojection_rms(*side), 3).alias("rms_px"), F.count("*").alias("n"))


def c2_undistort(spark, sf):
    u, v = g.project([F.col("x"), F.col("y"), F.col("z")], K, D)
    rays = _scene(spark, sf).withColumn("r", g.undistort(u, v, K, D))
    return rays.groupBy("scan").agg(quantise(F.avg("r.x")).alias("mean_x"), quantise(F.avg("r.y")).alias("mean_y"))


def _rays(spark, sf):
    once = b.detections(spark, sf).groupBy("image", "tag", "camera").agg(
        F.count("*").alias("n"), F.min((F.col("u") - 800) / 1000).alias("a"), F.min((F.col("v") - 600) / 1000).alias("b")).where("n = 1")
    left = once.where("camera = 'O'").select("image", "tag", F.col("a").alias("lx"), F.col("b").alias("ly"))
    right = once.where("camera = 'F'").select("image", "tag", F.col("a").alias("rx"), F.col("b").alias("ry"))
    return left.join(right, ["image", "tag"])


def c3(spark, sf):
    return quantised(g.triangulate(_rays(spark, sf), [1.0, 0, 0, 0, 0.8, -0.6, 0, 0.6, 0.8], [-120.0, 5.0, 2.0]), "x", "y", "z") \
        .drop("lx", "ly", "rx", "ry")


def c4(spark, sf):
    mask = b.rasters(spark, sf).select("frame", "row_", "col_", ((F.col("row_") + F.col("col_")) % 3).alias("mask"))
    low, _ = g.disparity_range(100.0, 50.0, 150.0, 1000.0)
    points = g.disparity_points(b.rasters(spark, sf), Q, float(low), 150.0, 1000.0, TURN, mask)
    return quantised(points, "x", "y", "z").select("frame", "row_", "col_", "x", "y", "z")


def c5(spark, sf):
    rasters = b.rasters(spark, sf)
    left = rasters.select("frame", "row_", "col_", (F.col("d") / 4).alias("d"))
    right = rasters.select("frame", "row_", "col_", (F.col("truth") / 4).alias("d"))
    return quantised(g.left_right_check(left, right, 2.0, 1.5), "back", "d")


def c6(spark, sf):
    r = F.col("u") / 1000
    return b.residuals(spark, sf).groupBy("camera", "technique").agg(
        quantise(F.avg(g.refract_radial(r, 1.333))).alias("water"), quantise(F.avg(g.unrefract_radial(r, 1.333))).alias("air"),
        F.count(g.unrefract_radial(r, 1.333)).alias("below_critical"))


def _quads(spark, sf):
    u, v = F.col("u") / 10, F.col("v") / 10
    corner = [F.struct((u + du).alias("u"), (v + dv).alias("v")) for du, dv in ((-1.3, -1.7), (1.9, -1.1), (1.4, 1.6), (-1.8, 1.2))]
    return b.detections(spark, sf).where("tag < 70").select(F.col("image").alias("frame"), "camera", F.array(*corner).alias("quad"))


def c7(spark, sf):
    return g.masked_pixels(_quads(spark, sf), (160, 120)).groupBy("frame", "camera").agg(F.count("*").alias("pixels"))


def c7_summary(spark, sf):
    frames = b.detections(spark, sf).select(F.col("image").alias("frame"), "camera").distinct()
    poses = b.poses(spark, sf).where("frame % 3 = 0").select("frame")
    shares = g.mask_summary(frames, poses, g.masked_pixels(_quads(spark, sf), (160, 120)), (160, 120))
    from stratacloud.functions.quantiles import exact_quantiles

    counts = shares.groupBy("status").agg(F.countDistinct("frame").alias("frames"))
    return quantised(counts.join(exact_quantiles(shares, ["status"], "masked", {"median_masked": ("linear", 0.5)}), "status"),
                     "median_masked")


def c8(spark, sf):
    d = g.plane_disparity(F.col("col_") * 10, F.col("row_") * 10, [F.lit(0.2), F.lit(-0.1), F.lit(-0.9)], F.lit(-400.0),
                          (500.0, 320.0, 240.0), (500.0, 0.02, 0.001))
    gated = b.rasters(spark, sf).select("frame", "row_", "col_", d.alias("plane"))
    return quantised(gated.where((F.col("plane") > 0) & (F.col("plane") < F.col("col_") * 10)), "plane")


def c9(spark, sf):
    r = g.normalised_radius("u", "v", (800.0, 600.0), (1600.0, 1200.0))
    return b.residuals(spark, sf).groupBy("camera").agg(quantise(F.avg(r)).alias("mean_r"), quantise(F.max(r)).alias("max_r"))


QUERIES = {
    "b1_nearest_timestamp": b1, "b2_gap_gate": b2, "b3_strided": b3, "b3_frame_range": b3_range, "b4_sharpness": b4,
    "b5_noise": b5, "b6_blur_percentiles": b6, "b6_blur_thresholds": b6_thresholds, "b6_blurriest": b6_worst,
    "b7_blur_select": b7, "b8_select_posed": b8, "b9_tags_in_both": b9, "b9_block_in_view": b9_block,
    "b10_source_views": b10, "b11_match_pairs": b11, "b12_figure_frame": b12, "b13_spread_sample": b13,
    "b14_best_view": b14, "c1_rigid_motion": c1, "c2_reprojection": c2, "c2_undistort": c2_undistort,
    "c3_midpoint": c3, "c4_disparity_points": c4, "c5_left_right": c5, "c6_refraction": c6, "c7_masked_pixels": c7,
    "c7_mask_summary": c7_summary, "c8_plane_disparity": c8, "c9_normalised_radius": c9,
}

_MATCHED = """, l AS (SELECT pts_ns, min(frame) AS frame FROM timestamps WHERE camera = 'left' GROUP BY pts_ns),
r AS (SELECT pts_ns, frame FROM timestamps WHERE camera = 'right'),
pairs AS (SELECT r.frame AS right_frame, r.pts_ns AS right_pts_ns,
  CASE WHEN p.pts_ns IS NULL OR n.pts_ns - r.pts_ns < r.pts_ns - p.pts_ns THEN n.frame ELSE p.frame END AS left_frame,
  CASE WHEN p.pts_ns IS NULL OR n.pts_ns - r.pts_ns < r.pts_ns - p.pts_ns THEN n.pts_ns ELSE p.pts_ns END AS left_pts_ns
  FROM r ASOF LEFT JOIN l p ON r.pts_ns >= p.pts_ns ASOF LEFT JOIN l n ON r.pts_ns <= n.pts_ns),
matched AS (SELECT *, (right_pts_ns - left_pts_ns) / 1e6 AS dt_ms FROM pairs)
"""
_SCORES = """WITH scores AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS camera, o_orderkey AS name,
  o_custkey AS label, o_totalprice / 1000 AS blur FROM orders)
"""


def _stencil(body):
    cells = ", ".join(f"p{dr + 1}{dc + 1}.d AS n{dr + 1}{dc + 1}" for dr in (-1, 0, 1) for dc in (-1, 0, 1))
    joins = " ".join(f"LEFT JOIN rasters p{dr + 1}{dc + 1} ON p{dr + 1}{dc + 1}.frame = c.frame AND p{dr + 1}{dc + 1}.row_ = c.row_ + ({dr}) "
                     f"AND p{dr + 1}{dc + 1}.col_ = c.col_ + ({dc})" for dr in (-1, 0, 1) for dc in (-1, 0, 1))
    mirrored = ", ".join(f"coalesce(n{r}{c}, n{2 - r}{c}, n{r}{2 - c}, n{2 - r}{2 - c}, n11) AS m{r}{c}" for r in range(3) for c in range(3))
    return f", near AS (SELECT c.frame, {cells} FROM rasters c {joins}), m AS (SELECT frame, {mirrored} FROM near) {body}"


_Q = """SELECT *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS s FROM poses"""
_ROT = """, n AS (SELECT *, qw/s AS w, qx/s AS i, qy/s AS j, qz/s AS k FROM (""" + _Q + """)),
rot AS (SELECT *, 1-2*(j*j+k*k) AS r00, 2*(i*j-w*k) AS r01, 2*(i*k+w*j) AS r02, 2*(i*j+w*k) AS r10, 1-2*(i*i+k*k) AS r11,
  2*(j*k-w*i) AS r12, 2*(i*k-w*j) AS r20, 2*(j*k+w*i) AS r21, 1-2*(i*i+j*j) AS r22 FROM n)
"""
_PROJ = """, scene AS (SELECT scan, method, x, y, z * 10 + 200 AS z FROM points),
n AS (SELECT *, x / z AS a, y / z AS b, (x/z)*(x/z) + (y/z)*(y/z) AS r2 FROM scene),
d AS (SELECT *, 1 + r2*(0.1e0 + r2*(-0.05e0 + r2*0.01e0)) AS g FROM n),
px AS (SELECT *, 900e0*(a*g + 2*0.001e0*a*b + 0.002e0*(r2 + 2*a*a)) + 800 AS u,
  910e0*(b*g + 0.001e0*(r2 + 2*b*b) + 2*0.002e0*a*b) + 600 AS v FROM d)
"""
_MASK = """, quads AS (SELECT image AS frame, camera, u / 10 AS u, v / 10 AS v FROM detections WHERE tag < 70),
grown AS (SELECT frame, camera,
  [round_even(c.u + (p[1] - c.mu) * 1.6e0 + c.mu, 0) FOR p IN [[-1.3e0, -1.7e0], [1.9e0, -1.1e0], [1.4e0, 1.6e0], [-1.8e0, 1.2e0]]] AS us,
  [round_even(c.v + (p[2] - c.mv) * 1.6e0 + c.mv, 0) FOR p IN [[-1.3e0, -1.7e0], [1.9e0, -1.1e0], [1.4e0, 1.6e0], [-1.8e0, 1.2e0]]] AS vs
  FROM (SELECT *, (-1.3e0 + 1.9e0 + 1.4e0 - 1.8e0) / 4 AS mu, (-1.7e0 - 1.1e0 + 1.6e0 + 1.2e0) / 4 AS mv FROM quads) c),
pix AS (SELECT frame, camera, us, vs, r AS row_, c AS col_ FROM (SELECT *, unnest(range(greatest(list_min(vs), 0)::BIGINT,
  least(list_max(vs), 119)::BIGINT + 1)) AS r FROM grown) t, LATERAL (SELECT unnest(range(greatest(list_min(us), 0)::BIGINT,
  least(list_max(us), 159)::BIGINT + 1)) AS c)),
side AS (SELECT frame, camera, row_, col_, [(us[k % 4 + 1] - us[k]) * (row_ - vs[k]) - (vs[k % 4 + 1] - vs[k]) * (col_ - us[k])
  FOR k IN [1, 2, 3, 4]] AS s FROM pix),
mask AS (SELECT DISTINCT frame, camera, row_, col_ FROM side WHERE list_min(s) >= 0 OR list_max(s) <= 0)
"""

ORACLES = {
    "b1_nearest_timestamp": sql("timestamps", body=_MATCHED + f"""SELECT right_frame, left_frame, right_pts_ns, left_pts_ns,
        {q('dt_ms')} AS dt_ms FROM matched"""),
    "b2_gap_gate": sql("timestamps", body=_MATCHED + f"""SELECT count(*) FILTER (WHERE abs(dt_ms) <= 300000) AS kept,
        count(*) FILTER (WHERE abs(dt_ms) > 300000) AS dropped, {q('avg(dt_ms) FILTER (WHERE abs(dt_ms) <= 300000)', 2)} AS mean_kept_ms
        FROM matched"""),
    "b3_strided": """WITH r AS (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 - 3 AS pos FROM pages)
        SELECT page_id FROM r WHERE pos >= 0 AND pos % 7 = 0 AND pos // 7 < 20""",
    "b3_frame_range": sql("poses", body="""SELECT recording::BIGINT AS recording, frame FROM poses WHERE frame BETWEEN 40 AND 400
        AND (frame - 40) % 9 = 0"""),
    "b4_sharpness": sql("rasters", body=_stencil(f"SELECT frame, {q('var_pop(m01 + m21 + m10 + m12 - 4 * m11)')} AS score FROM m GROUP BY frame")),
    "b5_noise": sql("rasters", body=_stencil(f""", r AS (SELECT frame, sqrt(pow((m02 + 2*m12 + m22) - (m00 + 2*m10 + m20), 2)
        + pow((m20 + 2*m21 + m22) - (m00 + 2*m01 + m02), 2)) AS g,
        abs(m00 - 2*m01 + m02 - 2*m10 + 4*m11 - 2*m12 + m20 - 2*m21 + m22) AS k FROM m),
        e AS (SELECT frame, quantile_cont(g, 0.9) AS edge FROM r GROUP BY frame)
        SELECT frame, {q('avg(k) * sqrt(pi() / 2) / 6')} AS noise FROM r JOIN e USING (frame) WHERE g <= edge GROUP BY frame""")),
    "b6_blur_percentiles": _SCORES + "SELECT camera, count(*) AS n, " + ", ".join(
        f"{q(f'quantile_cont(blur, {p / 100})')} AS p{p}" for p in sync.REPORT_PERCENTILES) + " FROM scores GROUP BY camera",
    "b6_blur_thresholds": _SCORES + f""", t AS (SELECT p AS percentile, (SELECT quantile_cont(blur, [0.1, 0.25, 0.5, 0.75]) FROM scores)[i] AS threshold
        FROM (SELECT unnest([10::BIGINT, 25, 50, 75]) AS p, unnest([1, 2, 3, 4]) AS i))
        SELECT camera, percentile, {q('any_value(threshold)')} AS threshold, count(*) FILTER (WHERE blur >= threshold) AS kept
        FROM scores, t GROUP BY camera, percentile""",
    "b6_blurriest": _SCORES + f"""SELECT camera, name, label, {q('blur')} AS blur, CASE WHEN blur < 2 THEN 'BLURRY' ELSE 'sharp' END AS verdict
        FROM scores ORDER BY scores.blur, camera, name LIMIT 5""",
    "b7_blur_select": _SCORES + """, kept AS (SELECT * FROM scores WHERE blur >= (SELECT quantile_cont(blur, 0.6) FROM scores))
        SELECT camera, name, label FROM kept WHERE label IN (SELECT label FROM kept GROUP BY label HAVING count(DISTINCT camera) = 2)""",
    "b8_select_posed": sql("poses", body=_ROT + """SELECT frame FROM rot WHERE frame % 20 >= 8 AND sqrt(
        pow(-(r00*tx + r10*ty + r20*tz) - 1, 2) + pow(-(r01*tx + r11*ty + r21*tz) + 2, 2) + pow(-(r02*tx + r12*ty + r22*tz) - 3, 2)) <= 25"""),
    "b9_tags_in_both": sql("detections", body=""", h AS (SELECT image, count(DISTINCT (camera, tag)) AS hits FROM detections
        WHERE tag IN (5, 12) GROUP BY image)
        SELECT image AS pair, coalesce(hits, 0) AS hits, CASE WHEN coalesce(hits, 0) < 4 THEN 'tags' END AS reason
        FROM (SELECT DISTINCT image FROM detections) LEFT JOIN h USING (image)"""),
    "b10_source_views": sql("poses", body=f""", v AS (SELECT frame AS name, CASE WHEN frame % 2 = 0 THEN frame + 1 ELSE frame - 1 END AS partner,
        tx*10 AS cx, ty*10 AS cy, tz*10 AS cz, qx / sqrt(qx*qx + qy*qy + 1) AS ax, qy / sqrt(qx*qx + qy*qy + 1) AS ay,
        1 / sqrt(qx*qx + qy*qy + 1) AS az FROM poses),
        p AS (SELECT a.name, a.partner, o.name AS other, a.cx - (a.cx + 450*a.ax) AS rx, a.cy - (a.cy + 450*a.ay) AS ry, a.cz - (a.cz + 450*a.az) AS rz,
          o.cx - (a.cx + 450*a.ax) AS ox, o.cy - (a.cy + 450*a.ay) AS oy, o.cz - (a.cz + 450*a.az) AS oz, o.ax AS bx, o.ay AS by_, o.az AS bz
          FROM v a JOIN v o ON a.name <> o.name),
        s AS (SELECT *, degrees(acos(least(1, greatest(-1, (rx*ox + ry*oy + rz*oz) / sqrt(rx*rx + ry*ry + rz*rz) / sqrt(ox*ox + oy*oy + oz*oz))))) AS angle,
          degrees(acos(least(1, greatest(-1, -(ox*bx + oy*by_ + oz*bz) / sqrt(ox*ox + oy*oy + oz*oz))))) AS off_axis FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (other <> partner), abs(angle - 15), other) AS rank FROM s
          WHERE angle BETWEEN 4 AND 40 AND off_axis <= 35)
        SELECT name, rank, other, {q('angle', 3)} AS angle FROM k WHERE rank <= 5"""),
    "b11_match_pairs": sql("poses", body=""", r AS (SELECT recording, lpad(frame::VARCHAR, 8, '0') AS name,
        row_number() OVER (PARTITION BY recording ORDER BY lpad(frame::VARCHAR, 8, '0')) AS rn FROM poses),
        c AS (SELECT unnest(['left', 'right']) AS cam)
        SELECT DISTINCT a.recording::BIGINT AS recording, least(x.cam || '/' || a.name, y.cam || '/' || o.name) AS first,
        greatest(x.cam || '/' || a.name, y.cam || '/' || o.name) AS second
        FROM r a JOIN r o ON a.recording = o.recording AND o.rn BETWEEN a.rn AND a.rn + 2, c x, c y
        WHERE x.cam || '/' || a.name <> y.cam || '/' || o.name"""),
    "b12_figure_frame": sql("detections", body=""", m AS (SELECT camera, channel, image FROM detections),
        c AS (SELECT camera, image, row_number() OVER (PARTITION BY camera ORDER BY image) - 1 AS rn, count(*) OVER (PARTITION BY camera) AS n
          FROM m JOIN (SELECT camera, count(DISTINCT channel) AS need FROM m GROUP BY camera) USING (camera)
          GROUP BY camera, image, need HAVING count(DISTINCT channel) = need)
        SELECT a.camera, a.image, z.image AS last_image FROM c a JOIN c z ON a.camera = z.camera AND z.rn = z.n - 1 WHERE a.rn = a.n // 2"""),
    "b13_spread_sample": sql("poses", body=""", r AS (SELECT recording, frame, row_number() OVER (PARTITION BY recording ORDER BY frame) - 1 AS rn,
        count(*) OVER (PARTITION BY recording) AS n FROM poses)
        SELECT recording::BIGINT AS recording, frame, pick FROM r, (SELECT unnest([1::BIGINT, 2, 3, 4, 5, 6]) AS pick)
        WHERE rn = floor(pick * ((n - 1) / 7e0))"""),
    "c1_rigid_motion": sql("poses", body=_ROT + f""", m AS (SELECT *, degrees(acos(least(1, greatest(-1, (r00 + r11 + r22 - 1) / 2)))) AS deg FROM rot)
        SELECT frame, {q('r00*ex + r01*ey + r02*ez + tx')} AS x, {q('r10*ex + r11*ey + r12*ez + ty')} AS y,
        {q('r20*ex + r21*ey + r22*ez + tz')} AS z, {q('sqrt(tx*tx + ty*ty + tz*tz)')} AS shift_mm, {q('deg', 3)} AS turn_deg,
        {q('CASE WHEN deg > 90 THEN 360 - 2*deg ELSE 2*deg END', 3)} AS twice_deg,
        {q('CASE WHEN w < 0 THEN -w ELSE w END')} AS qw, {q('CASE WHEN w < 0 THEN -i ELSE i END')} AS qx,
        {q('CASE WHEN w < 0 THEN -j ELSE j END')} AS qy, {q('CASE WHEN w < 0 THEN -k ELSE k END')} AS qz, true AS round_trip FROM m"""),
    "c2_reprojection": sql("points", body=_PROJ + f"""SELECT scan, {q('sqrt(avg(pow(u - x*32, 2) + pow(v - y*11, 2)))', 3)} AS rms_px,
        count(*) AS n FROM px GROUP BY scan"""),
    "c2_undistort": sql("points", body=_PROJ + f"SELECT scan, {q('avg(a)')} AS mean_x, {q('avg(b)')} AS mean_y FROM px GROUP BY scan"),
    "c3_midpoint": sql("detections", body=f""", o AS (SELECT image, tag, camera, min((u - 800) / 1000) AS a, min((v - 600) / 1000) AS b FROM detections
        GROUP BY image, tag, camera HAVING count(*) = 1),
        p AS (SELECT l.image, l.tag, l.a AS x1, l.b AS y1, 1e0 AS z1, 120e0 AS ox, -(0.8e0*5 + 0.6e0*2) AS oy, -(-0.6e0*5 + 0.8e0*2) AS oz,
          r.a AS x2, 0.8e0*r.b + 0.6e0 AS y2, -0.6e0*r.b + 0.8e0 AS z2 FROM o l JOIN o r ON l.image = r.image AND l.tag = r.tag AND l.camera = 'O' AND r.camera = 'F'),
        t AS (SELECT *, x1*x1 + y1*y1 + z1*z1 AS a, x1*x2 + y1*y2 + z1*z2 AS b, x2*x2 + y2*y2 + z2*z2 AS c, -(x1*ox + y1*oy + z1*oz) AS d,
          -(x2*ox + y2*oy + z2*oz) AS e FROM p),
        w AS (SELECT *, (b*e - c*d) / nullif(a*c - b*b, 0) AS s, (a*e - b*d) / nullif(a*c - b*b, 0) AS t FROM t)
        SELECT image, tag, {q('0.5e0*(s*x1 + ox + t*x2)')} AS x, {q('0.5e0*(s*y1 + oy + t*y2)')} AS y, {q('0.5e0*(s*z1 + oz + t*z2)')} AS z FROM w"""),
    "c4_disparity_points": sql("rasters", body=f""", p AS (SELECT frame, row_, col_, (col_ - 32) / (0.02e0 * d) AS x, (row_ - 24) / (0.02e0 * d) AS y,
        100 / (0.02e0 * d) AS z FROM rasters WHERE d >= 0 AND (row_ + col_) % 3 > 0)
        SELECT frame, row_, col_, {q('0.8e0*x - 0.6e0*y + 5')} AS x, {q('0.6e0*x + 0.8e0*y - 3')} AS y, {q('z + 2')} AS z FROM p WHERE z BETWEEN 150 AND 1000"""),
    "c5_left_right": sql("rasters", body=f""", e AS (SELECT frame, max(col_) AS m FROM rasters GROUP BY frame),
        a AS (SELECT frame, row_, col_, d / 4 AS d, m, greatest(0, least(col_ - d / 4, m)) AS pos FROM rasters JOIN e USING (frame)),
        bk AS (SELECT a.frame, a.row_, a.col_, a.d, (1 - (pos - floor(pos))) * p.truth / 4 + (pos - floor(pos)) * n.truth / 4 AS back FROM a
          JOIN rasters p ON p.frame = a.frame AND p.row_ = a.row_ AND p.col_ = floor(pos)
          JOIN rasters n ON n.frame = a.frame AND n.row_ = a.row_ AND n.col_ = least(floor(pos) + 1, m))
        SELECT frame, row_, col_, {q('d')} AS d, {q('back')} AS back FROM bk WHERE d > 0 AND abs(back - d) < 3"""),
    "c6_refraction": sql("residuals", body=f""", s AS (SELECT *, sin(atan(u / 1000)) AS s FROM residuals)
        SELECT camera, technique, {q('avg(tan(asin(s / 1.333e0)))')} AS water,
        {q('avg(CASE WHEN 1.333e0 * s <= 1 THEN tan(asin(least(1, 1.333e0 * s))) END)')} AS air,
        count(*) FILTER (WHERE 1.333e0 * s <= 1) AS below_critical FROM s GROUP BY camera, technique"""),
    "c7_masked_pixels": sql("detections", body=_MASK + "SELECT frame, camera, count(*) AS pixels FROM mask GROUP BY frame, camera"),
    "c7_mask_summary": sql("detections", "poses", body=_MASK + f""", f AS (SELECT DISTINCT image AS frame, camera FROM detections),
        s AS (SELECT f.frame, f.camera, coalesce(n, 0) / 19200e0 AS masked, CASE WHEN f.frame IN (SELECT frame FROM poses WHERE frame % 3 = 0)
          THEN 'projected' WHEN f.frame IN (SELECT frame FROM mask) THEN 'detected_only' ELSE 'unmasked' END AS status
          FROM f LEFT JOIN (SELECT frame, camera, count(*) AS n FROM mask GROUP BY ALL) m ON m.frame = f.frame AND m.camera = f.camera)
        SELECT status, count(DISTINCT frame) AS frames, {q('quantile_cont(masked, 0.5)')} AS median_masked FROM s GROUP BY status"""),
    "c8_plane_disparity": sql("rasters", body=f""", z AS (SELECT frame, row_, col_, -400 / nullif(0.2e0*(col_*10 - 320) / 500 + -0.1e0*(row_*10 - 240) / 500 - 0.9e0, 0) AS z
        FROM rasters), p AS (SELECT *, (500 / z - 0.001e0) / 0.02e0 AS plane FROM z WHERE z > 0)
        SELECT frame, row_, col_, {q('plane')} AS plane FROM p WHERE plane > 0 AND plane < col_ * 10"""),
    "c9_normalised_radius": sql("residuals", body=f"""SELECT camera, {q('avg(sqrt(pow(u - 800, 2) + pow(v - 600, 2)) / 1000)')} AS mean_r,
        {q('max(sqrt(pow(u - 800, 2) + pow(v - 600, 2)) / 1000)')} AS max_r FROM residuals GROUP BY camera"""),
}
