"""Registered queries: detection and calibration analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions.columns import quantise
from stratacloud.operators import detection as d
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql
from stratacloud.session import cut_lineage

SIZE = 35.0


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def _quads(spark, sf):
    u, v = F.col("u") / 100, F.col("v") / 100
    corners = F.array(*[F.struct((u + du).alias("u"), (v + dv).alias("v")) for du, dv in ((1, 0), (0, 0), (0, 1), (1, 1))])
    return b.detections(spark, sf).select("channel", "camera", "image", "tag", corners.alias("quad"))


def h1(spark, sf):
    merged = d.merge_channels(_quads(spark, sf), ["camera", "image"], ("A", "N", "R"), 4.0)
    return quantised(merged.select("camera", "image", "tag", "channel", F.col("quad")[0]["u"].alias("u"), "conflict"), "u")


def h1_counts(spark, sf):
    merged = d.merge_channels(_quads(spark, sf), ["camera", "image"], ("A", "N", "R"), 4.0)
    return d.merge_counts(merged, ["camera", "image"])


def _accounting(spark, sf):
    return d.image_accounting(b.detections(spark, sf), ["channel", "camera", "image"], 14)


def h2(spark, sf):
    return _accounting(spark, sf)


def h2_tags(spark, sf):
    return d.images_per_tag(b.detections(spark, sf), ["channel", "camera"])


def h2_cameras(spark, sf):
    return d.camera_summary(_accounting(spark, sf), ["channel", "camera"])


def h3(spark, sf):
    named = b.detections(spark, sf).where("tag < 70").select("camera", "tag", F.concat(
        F.lit("s"), F.col("image") % 7, F.when(F.col("camera") == "O", "_Left_").otherwise("_Right_"), F.col("image")).alias("name"))
    pairs = d.stereo_pairs(named.where("camera = 'O'").select("name", "tag"), named.where("camera = 'F'").select("name", "tag"), 25)
    return pairs.groupBy("left_name", "right_name").agg(F.max("shared").alias("shared"), F.sum("tag").alias("tag_sum"))


def _tag_errors(spark, sf):
    """Residual rows as tags of images, with the residual the caller's fit is about to judge."""
    return b.residuals(spark, sf).select(F.concat_ws("-", "camera", "frame", "technique").alias("image"), (F.col("u") / 32).cast("long").alias("tag"), "du", "dv")


def h4(spark, sf):
    rows = cut_lineage(_tag_errors(spark, sf))

    def residuals(kept):
        # the "fit" of a round: the mean residual of the kept tags is taken out of every tag
        shift = rows.join(kept, ["image", "tag"], "left_semi").agg(F.avg("du").alias("_mu"), F.avg("dv").alias("_mv"))
        e2 = (F.col("du") - F.col("_mu")) * (F.col("du") - F.col("_mu")) + (F.col("dv") - F.col("_mv")) * (F.col("dv") - F.col("_mv"))
        return rows.crossJoin(F.broadcast(shift)).groupBy("image", "tag").agg(F.sqrt(F.max(e2)).alias("worst"), F.avg(e2).alias("mean_square"))

    _, log = d.reject_outliers(rows.select("image", "tag"), residuals, 10, tag_floor=0.05, image_floor=0.03)
    return log


def _named(spark, sf):
    images = _accounting(spark, sf)
    folder = F.concat(F.lit("Water_C"), (F.col("image") % 4) * 2 + 1, F.lit("_frames/c_"), F.col("camera"), F.lit("_"), F.col("image"), F.lit(".png"))
    return images.withColumn("name", folder)


def h5(spark, sf):
    named = _named(spark, sf)
    labels = named.select("name", "image").distinct().select("name", ((F.col("image") % 5) * 10.0 + 20).alias("label"))
    table = d.recall_table(d.with_labels(named, labels), ["channel"])
    return quantised(table, "recall", "false_id_rate", "duplicate_rate", digits=6)


def h6(spark, sf):
    images = b.detections(spark, sf).select("camera", "image").distinct().crossJoin(F.broadcast(
        b.detections(spark, sf).select("channel").distinct()))
    full = d.image_accounting(b.detections(spark, sf), ["channel", "camera", "image"], 14, images).withColumn("recall", F.col("tags") / d.N_TAGS)
    return quantised(d.paired_delta(full, "A", "recall", ["camera", "image"]), "delta", "delta_se", digits=6)


def _per_image(spark, sf):
    return b.residuals(spark, sf).where(F.col("frame_distance_mm") > 1450 - F.ascii("technique")).groupBy("camera", "technique", F.concat_ws("-", "frame", "split").alias("image")).agg(
        F.sqrt(F.avg(F.col("du") * F.col("du") + F.col("dv") * F.col("dv"))).alias("rms"))


def h7(spark, sf):
    return quantised(d.common_rms(_per_image(spark, sf), "technique", ["camera"]), "rms_common", "rms_all", "rms_extra", digits=6)


def h8(spark, sf):
    common = d.common_items(_per_image(spark, sf), "technique", ["image"], ["camera"])
    extra = _per_image(spark, sf).join(common, ["camera", "image"], "left_anti")
    return quantised(extra.groupBy("camera", "technique").agg(F.count("*").alias("extra"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms")), "rms", digits=6)


def h9(spark, sf):
    errors = d.found_once(b.detections(spark, sf).where("tag < 70"), ["camera", "channel", "image"], [
        F.max(F.when(F.col("u") > 60, F.pow(F.col("u") / 800 - F.col("v") / 600, F.lit(2.0))).otherwise(F.lit(float("inf")))).alias("mean_square")])
    return quantised(d.matched_tag_rms(errors, "channel", ["camera"]), "rms", "median", "p95", "over_2px")


def _agreement(spark, sf):
    return d.agreement_counts(b.detections(spark, sf), ["camera", "image"], 3, "A")


def h10(spark, sf):
    return d.most_disagreeing(_agreement(spark, sf), 12, ["camera", "image"]).select("camera", "image", "disagreement")


def h11(spark, sf):
    return _agreement(spark, sf).withColumn("found_by_none", F.col("found_by_none").cast("long"))


def h12(spark, sf):
    runs = b.residuals(spark, sf).groupBy("camera", "technique").agg((F.avg("u") * 2).alias("fx"), (F.stddev_samp("u") / 100).alias("fx_std"))
    return quantised(d.focal_agreement(runs, ["camera"]), "fx_spread", "fx_sigma")


def h13(spark, sf):
    runs = b.summary_rows(spark, sf).select(F.col("session").alias("footage"), F.col("method").alias("preset"), F.concat("scan", F.lit("-"), "version").alias("run"))
    return d.disambiguate(runs).groupBy("footage", "label").agg(F.count("*").alias("runs"))


def h14(spark, sf):
    cams = F.when(F.col("camera") == "O", "left").otherwise("right")
    detections = b.detections(spark, sf).select(F.when(F.col("image") % 2 == 0, "air").otherwise("water").alias("medium"), F.col("channel").alias("preset"),
                                                cams.alias("camera"), "image", "tag", "u", "v")
    accounting = d.image_accounting(detections, ["medium", "preset", "camera", "image"], 14)
    per_image = detections.where("tag < 70").groupBy("medium", "preset", "camera", "image").agg((F.avg("u") / 1000).alias("rms"), F.count("*").alias("_n")).where("_n >= 22")
    expected = detections.select("medium", "preset").distinct()
    out = d.preset_summary(accounting, per_image.drop("_n"), expected)
    return quantised(out, "bad_rate", "rms_left", "rms_right", "rms_common_left", "rms_common_right", digits=6)


def _target(spark, sf):
    """Triangulated corners of target tags: a 35 mm square per (setup, pair, tag), each corner pushed by the detection."""
    seen = b.detections(spark, sf).groupBy(F.col("channel").alias("setup"), F.col("image").alias("pair"), "tag").agg(
        F.avg("u").alias("u"), F.avg("v").alias("v"))
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for k, (x, y) in enumerate(((SIZE, 0.0), (0.0, 0.0), (0.0, SIZE), (SIZE, SIZE)))])
    return seen.withColumn("_c", F.explode(corners)).select(
        "setup", "pair", "tag", "u", (F.col("v") + 200).alias("distance_mm"), F.col("_c.corner").alias("corner"),
        (F.col("_c.cx") * (1 + F.col("u") / 40000) + F.col("_c.corner") / 10).alias("x"), (F.col("_c.cy") * (1 + F.col("v") / 30000)).alias("y"), (F.col("_c.corner") * 0.2).alias("z"))


STATS = ("bias_mm", "bias_pct", "sd_mm", "mae_mm", "rms_mm", "max_abs_mm")


def h15(spark, sf):
    corners = _target(spark, sf)
    errors = d.tag_edges(corners, ["setup", "pair"], SIZE)
    tags = corners.groupBy("setup", "pair", "tag").agg(F.avg("u").alias("u"))
    regions = d.tag_regions(tags, ["setup", "pair"], (3, 4, 5)).select("setup", "pair", "tag", "region")
    shared = d.shared_by_setups(tags, "setup", ["pair"]).select("setup", "pair", "tag", F.lit(True).alias("shared"))
    placed = errors.join(regions, ["setup", "pair", "tag"]).join(shared, ["setup", "pair", "tag"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return quantised(d.edge_statistics(placed, ["setup", "region", "shared"], SIZE, ["setup", "pair"]), *STATS)


def h16(spark, sf):
    corners = _target(spark, sf)
    tags = corners.groupBy("setup", "pair", "tag").agg(F.max("distance_mm").alias("distance_mm"))
    training = b.residuals(spark, sf).where("frame_distance_mm < 600").select(F.col("frame_distance_mm").alias("distance_mm"))
    out = d.by_calibration_range(tags, d.tag_edges(corners, ["setup", "pair"], SIZE), training, ["setup", "pair"], SIZE)
    return quantised(out, *STATS, "tag_median_error_mm")


def _settings(spark, sf):
    """Detections under candidate settings: a setting keeps the detections its threshold lets through."""
    return b.detections(spark, sf).withColumn("setting", F.explode(F.array(*[F.lit(k) for k in range(1, 6)]))).where(
        (F.col("u") / 32 > F.col("setting") * 4) | (F.col("tag") < 12 * F.col("setting"))).withColumn("setting", F.concat(F.lit("s"), "setting"))


def h17(spark, sf):
    scores = cut_lineage(d.score_settings(_settings(spark, sf), 30, 0.26))
    best = d.best_setting(scores).select("setting", F.lit(True).alias("best"))
    return quantised(scores.join(best, "setting", "left").withColumn("best", F.coalesce("best", F.lit(False))), "bad_rate", digits=6)


def h18(spark, sf):
    """Search two settings; each axis is one job over all its candidates."""
    detections = cut_lineage(b.detections(spark, sf))

    def score(candidates):
        rows = [(d.settings_key(c), float(c["reach"]), float(c["edge"])) for c in candidates]
        table = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(r).alias("reach"), F.lit(e).alias("edge")) for k, r, e in rows])
        seen = detections.withColumn("_s", F.explode(table)).select("*", "_s.*").where(
            (F.col("u") < F.col("reach") * 100) & (F.col("v") > F.col("edge") * 10 + F.col("reach") * 5) & ((F.col("tag") < 70) | (F.col("u") < F.col("reach") * F.col("reach") * 8)))
        found = d.score_settings(seen, 20, 0.10).collect()     # one row per candidate of an axis
        out = {r["setting"]: ((r["board_tags"], -(r["duplicates"] + r["false_ids"]), r["usable_images"]), r["refused"]) for r in found}
        return {k: out.get(k, ((0, 0, 0), False)) for k, _, _ in rows}

    best, log = d.coordinate_descent({"reach": 4, "edge": 40}, {"reach": [4, 8, 12, 16], "edge": [10, 40, 80]}, score, 4)
    return spark.range(1).select(F.lit(best["reach"]).cast("long").alias("reach"), F.lit(best["edge"]).cast("long").alias("edge"), F.lit(len(log)).cast("long").alias("trials"))


def h19(spark, sf):
    rows = b.detections(spark, sf).select("image", F.when(F.col("camera") == "O", "keypoint").otherwise("cloud").alias("kind"), "u", "v",
                                          (F.col("tag") % 3 > 0).alias("used"), (F.col("tag") % 4 == 0).alias("grip"))
    corner = [(300.0, 200.0), (1200.0, 260.0), (1300.0, 900.0), (250.0, 800.0)]
    outlines = rows.select("image").distinct().select("image", F.array(*[F.struct((F.lit(u) + F.col("image") % 50).alias("u"), F.lit(v).alias("v")) for u, v in corner]).alias("quad"))
    out = d.region_shares(rows, outlines, ["image"])
    return quantised(out, "triangulated_on_board", "points_on_board", "resisting", "resisting_on_board")


QUERIES = {
    "h1_merge_channels": h1, "h1_merge_counts": h1_counts, "h2_image_accounting": h2, "h2_images_per_tag": h2_tags, "h2_camera_summary": h2_cameras,
    "h3_stereo_pairs": h3, "h4_reject_outliers": h4, "h5_recall": h5, "h6_paired_delta": h6, "h7_common_rms": h7, "h8_beyond_common": h8,
    "h9_matched_tags": h9, "h10_most_disagreeing": h10, "h11_agreement": h11, "h12_focal_agreement": h12, "h13_labels": h13, "h14_preset_summary": h14,
    "h15_edge_accuracy": h15, "h16_calibration_range": h16, "h17_candidate_scores": h17, "h18_coordinate_descent": h18, "h19_region_shares": h19,
}

_MERGE = """, o AS (SELECT camera, image, tag, channel, min(u) / 100 AS u, min(v) / 100 AS v, CASE channel WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS r
  FROM detections GROUP BY camera, image, tag, channel HAVING count(*) = 1),
f AS (SELECT camera, image, tag, arg_min(channel, r) AS channel, arg_min(u, r) AS fu, arg_min(v, r) AS fv FROM o GROUP BY ALL),
mg AS (SELECT f.camera, f.image, f.tag, any_value(f.channel) AS channel, any_value(fu) + 1 AS u, f.tag < 70 AND max(sqrt(pow(o.u - fu, 2) + pow(o.v - fv, 2))) > 4 AS conflict
  FROM f JOIN o USING (camera, image, tag) GROUP BY f.camera, f.image, f.tag)
"""
_ACC = """, ac AS (SELECT channel, camera, image, count(DISTINCT tag) FILTER (WHERE tag < 70) AS tags, count(*) FILTER (WHERE tag >= 70) AS false_ids,
  count(*) FILTER (WHERE tag < 70) - count(DISTINCT tag) FILTER (WHERE tag < 70) AS duplicates,
  count(DISTINCT tag) FILTER (WHERE tag < 70) >= 14 AS usable FROM detections GROUP BY channel, camera, image)
"""
_PER_IMAGE = """, pi AS (SELECT camera, technique, frame || '-' || split AS image, sqrt(avg(du*du + dv*dv)) AS rms FROM residuals
  WHERE frame_distance_mm > 1450 - ascii(technique) GROUP BY camera, technique, frame, split),
nd AS (SELECT camera, count(DISTINCT technique) AS need FROM pi GROUP BY camera),
cm AS (SELECT camera, image FROM pi JOIN nd USING (camera) GROUP BY camera, image, need HAVING count(DISTINCT technique) = need)
"""
_AGREE = """, o AS (SELECT camera, image, channel, tag FROM detections WHERE tag < 70 GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT camera, image, tag, count(*) AS c, bool_or(channel = 'A') AS f FROM o GROUP BY ALL),
g AS (SELECT camera, image, count(*) AS u, count(*) FILTER (WHERE c = 3) AS a, count(*) FILTER (WHERE NOT f) AS added FROM t GROUP BY ALL),
ag AS (SELECT camera, image, coalesce(a, 0) AS found_by_all, coalesce(u - a, 0) AS found_by_some, coalesce(added, 0) AS added, 70 - coalesce(u, 0) AS found_by_none,
  coalesce(u - a, 0) AS disagreement FROM (SELECT DISTINCT camera, image FROM detections) LEFT JOIN g USING (camera, image))
"""
_TARGET = """, s AS (SELECT channel AS setup, image AS pair, tag, avg(u) AS u, avg(v) AS v FROM detections GROUP BY ALL),
k AS (SELECT unnest([0, 1, 2, 3]) AS c, unnest([35e0, 0e0, 0e0, 35e0]) AS kx, unnest([0e0, 0e0, 35e0, 35e0]) AS ky),
co AS (SELECT setup, pair, tag, u, v + 200 AS dist, c, kx * (1 + u / 40000) + c / 10 AS x, ky * (1 + v / 30000) AS y, c * 0.2e0 AS z FROM s, k),
ed AS (SELECT a.setup, a.pair, a.tag, a.u, a.dist, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) - 35 AS e FROM co a JOIN co b
  ON a.setup = b.setup AND a.pair = b.pair AND a.tag = b.tag AND b.c = (a.c + 1) % 4)
"""
_STATS = f"""count(DISTINCT (setup, pair, tag)) AS n_tags, count(*) AS n_edges, {q('avg(e)')} AS bias_mm, {q('100 * avg(e) / 35')} AS bias_pct, {q('stddev_samp(e)')} AS sd_mm,
  {q('avg(abs(e))')} AS mae_mm, {q('sqrt(avg(e*e))')} AS rms_mm, {q('max(abs(e))')} AS max_abs_mm"""

ORACLES = {
    "h1_merge_channels": sql("detections", body=_MERGE + f"SELECT camera, image, tag, channel, {q('u')} AS u, conflict FROM mg"),
    "h1_merge_counts": sql("detections", body=_MERGE + """SELECT camera, image, count(*) FILTER (WHERE NOT conflict) AS tags, count(*) FILTER (WHERE conflict) AS conflicts
        FROM mg GROUP BY camera, image"""),
    "h2_image_accounting": sql("detections", body=_ACC + "SELECT * FROM ac"),
    "h2_images_per_tag": sql("detections", body=""", s AS (SELECT channel, camera, tag, count(DISTINCT image) AS images FROM detections WHERE tag < 70 GROUP BY ALL),
        g AS (SELECT channel, camera, unnest(range(70)) AS tag FROM (SELECT DISTINCT channel, camera FROM detections))
        SELECT channel, camera, tag, coalesce(images, 0) AS images FROM g LEFT JOIN s USING (channel, camera, tag)"""),
    "h2_camera_summary": sql("detections", body=_ACC + """SELECT channel, camera, count(*) AS images, sum(tags)::BIGINT AS tags, sum(false_ids)::BIGINT AS false_ids,
        sum(duplicates)::BIGINT AS duplicates, count(*) FILTER (WHERE usable) AS usable_images, count(*) FILTER (WHERE tags = 0) AS images_without,
        quantile_cont(tags, 0.5)::DOUBLE AS median_tags FROM ac GROUP BY channel, camera"""),
    "h3_stereo_pairs": sql("detections", body=""", n AS (SELECT DISTINCT camera, tag, 's' || (image % 7) || CASE WHEN camera = 'O' THEN '_Left_' ELSE '_Right_' END || image AS name
        FROM detections WHERE tag < 70),
        s AS (SELECT l.name AS left_name, r.name AS right_name, l.tag FROM n l JOIN n r ON l.camera = 'O' AND r.camera = 'F' AND replace(l.name, '_Left_', '_Right_') = r.name AND l.tag = r.tag)
        SELECT left_name, right_name, count(*) AS shared, sum(tag)::BIGINT AS tag_sum FROM s GROUP BY ALL HAVING count(*) >= 25"""),
    "h5_recall": sql("detections", body=_ACC + f""", l AS (SELECT *, 'C' || (image % 4 * 2 + 1) AS angle, (image % 5) * 10e0 + 20 AS label FROM ac)
        SELECT channel, angle, label, {q('avg(tags / 70)', 6)} AS recall, count(*) AS images, count(*) FILTER (WHERE usable) AS usable_images,
        {q('sum(false_ids) / (sum(tags) + sum(false_ids) + sum(duplicates))', 6)} AS false_id_rate,
        {q('sum(duplicates) / (sum(tags) + sum(false_ids) + sum(duplicates))', 6)} AS duplicate_rate
        FROM l GROUP BY GROUPING SETS ((channel), (channel, label), (channel, angle, label))"""),
    "h6_paired_delta": sql("detections", body=_ACC + f""", fl AS (SELECT channel, camera, image, coalesce(tags, 0) / 70 AS r FROM (SELECT DISTINCT camera, image FROM detections)
        CROSS JOIN (SELECT DISTINCT channel FROM detections) LEFT JOIN ac USING (channel, camera, image)),
        dl AS (SELECT a.channel, a.r - b.r AS g FROM fl a JOIN fl b ON b.channel = 'A' AND a.camera = b.camera AND a.image = b.image)
        SELECT channel, {q('avg(g)', 6)} AS delta, {q('stddev_samp(g) / sqrt(count(*))', 6)} AS delta_se, count(*) AS n FROM dl GROUP BY channel"""),
    "h7_common_rms": sql("residuals", body=_PER_IMAGE + f""", r AS (SELECT pi.*, cm.image IS NOT NULL AS c FROM pi LEFT JOIN cm USING (camera, image))
        SELECT camera, technique, {q('sqrt(avg(rms*rms) FILTER (WHERE c))', 6)} AS rms_common, {q('sqrt(avg(rms*rms))', 6)} AS rms_all,
        {q('sqrt(avg(rms*rms) FILTER (WHERE NOT c))', 6)} AS rms_extra, count(*) FILTER (WHERE c) AS n_common, count(*) AS n_images, count(*) FILTER (WHERE NOT c) AS n_extra
        FROM r GROUP BY camera, technique"""),
    "h8_beyond_common": sql("residuals", body=_PER_IMAGE + f"""SELECT camera, technique, count(*) AS extra, {q('sqrt(avg(rms*rms))', 6)} AS rms FROM pi
        WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.camera = pi.camera AND cm.image = pi.image) GROUP BY camera, technique"""),
    "h9_matched_tags": sql("detections", body=f""", o AS (SELECT camera, channel, image, tag, CASE WHEN min(u) > 60 THEN pow(min(u) / 800 - min(v) / 600, 2) END AS ms FROM detections
        WHERE tag < 70 GROUP BY ALL HAVING count(*) = 1),
        sh AS (SELECT camera, image, tag FROM o GROUP BY ALL HAVING count(DISTINCT channel) = 3)
        SELECT camera, channel, count(*) AS n_tags, {q('sqrt(avg(ms))')} AS rms, {q('avg((sqrt(ms) > 2)::INT)')} AS over_2px, count(*) FILTER (WHERE ms IS NULL) AS unposed,
        {q('quantile_cont(sqrt(ms), 0.5)')} AS median, {q('quantile_cont(sqrt(ms), 0.95)')} AS p95 FROM o JOIN sh USING (camera, image, tag) GROUP BY camera, channel"""),
    "h10_most_disagreeing": sql("detections", body=_AGREE + "SELECT camera, image, disagreement FROM ag ORDER BY disagreement DESC, camera DESC, image DESC LIMIT 12"),
    "h11_agreement": sql("detections", body=_AGREE + "SELECT * FROM ag"),
    "h12_focal_agreement": sql("residuals", body=f""", r AS (SELECT camera, avg(u) * 2 AS fx, stddev_samp(u) / 100 AS s FROM residuals GROUP BY camera, technique)
        SELECT camera, {q('max(fx) - min(fx)')} AS fx_spread, {q('max(s)')} AS fx_sigma, count(*) AS runs, CASE WHEN count(*) < 2 THEN NULL WHEN max(fx) - min(fx) <= max(s)
        THEN 'within' ELSE 'wider' END AS verdict FROM r GROUP BY camera"""),
    "h13_labels": sql("summary_rows", body=""", r AS (SELECT session, method, scan || '-' || version AS run, count(*) OVER (PARTITION BY session, method) AS n FROM summary_rows)
        SELECT session AS footage, CASE WHEN n > 1 THEN method || ' [' || run || ']' ELSE method END AS label, count(*) AS runs FROM r GROUP BY ALL"""),
    "h14_preset_summary": sql("detections", body=f""", x AS (SELECT CASE WHEN image % 2 = 0 THEN 'air' ELSE 'water' END AS medium, channel AS preset, CASE WHEN camera = 'O' THEN 'left'
        ELSE 'right' END AS camera, image, tag, u FROM detections),
        a AS (SELECT medium, preset, camera, image, count(DISTINCT tag) FILTER (WHERE tag < 70) AS t, count(*) AS n FROM x GROUP BY ALL),
        c AS (SELECT medium, preset, sum(t)::BIGINT AS tags, count(*) FILTER (WHERE t >= 14) AS usable, count(*) AS images, (sum(n) - sum(t))::BIGINT AS bad FROM a GROUP BY ALL),
        p AS (SELECT medium, preset, camera, image, avg(u) / 1000 AS rms FROM x WHERE tag < 70 GROUP BY ALL HAVING count(*) >= 22),
        cm AS (SELECT medium, camera, image FROM p JOIN (SELECT medium, camera, count(DISTINCT preset) AS need FROM p GROUP BY ALL) USING (medium, camera)
          GROUP BY medium, camera, image, need HAVING count(DISTINCT preset) = need),
        s AS (SELECT medium, preset, camera, count(*) AS kept, sqrt(avg(rms*rms)) AS r, sqrt(avg(rms*rms) FILTER (WHERE cm.image IS NOT NULL)) AS rc FROM p
          LEFT JOIN cm USING (medium, camera, image) GROUP BY ALL)
        SELECT c.medium, c.preset, tags, usable, images, bad, {q('bad / (tags + bad)', 6)} AS bad_rate, l.kept AS kept_left, {q('l.r', 6)} AS rms_left, {q('l.rc', 6)} AS rms_common_left,
        g.kept AS kept_right, {q('g.r', 6)} AS rms_right, {q('g.rc', 6)} AS rms_common_right FROM c
        LEFT JOIN (SELECT * FROM s WHERE camera = 'left') l USING (medium, preset) LEFT JOIN (SELECT * FROM s WHERE camera = 'right') g USING (medium, preset)"""),
    "h15_edge_accuracy": sql("detections", body=_TARGET + f""", m AS (SELECT setup, pair, quantile_cont(u, 0.5) AS m FROM s GROUP BY ALL),
        sh AS (SELECT pair, tag FROM s GROUP BY ALL HAVING count(DISTINCT setup) = 3)
        SELECT setup, CASE WHEN tag IN (3, 4, 5) THEN 'middle row' WHEN u < m THEN 'left column' ELSE 'right column' END AS region,
        EXISTS (SELECT 1 FROM sh WHERE sh.pair = ed.pair AND sh.tag = ed.tag) AS shared, {_STATS} FROM ed JOIN m USING (setup, pair) GROUP BY 1, 2, 3"""),
    "h16_calibration_range": sql("detections", "residuals", body=_TARGET + f""", rc AS (SELECT max(frame_distance_mm) AS r FROM residuals WHERE frame_distance_mm < 600),
        pl AS (SELECT ed.*, CASE WHEN dist <= r THEN 'inside' ELSE 'outside' END AS range FROM ed, rc),
        tm AS (SELECT range, quantile_cont(e, 0.5) AS m FROM pl GROUP BY range, setup, pair, tag),
        tt AS (SELECT range, {q('quantile_cont(m, 0.5)')} AS t FROM tm GROUP BY range)
        SELECT range, {_STATS}, any_value(t) AS tag_median_error_mm FROM pl JOIN tt USING (range) GROUP BY range"""),
    "h17_candidate_scores": sql("detections", body=f""", x AS (SELECT 's' || k AS setting, camera, image, tag FROM detections, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
        WHERE u / 32 > k * 4 OR tag < 12 * k),
        a AS (SELECT setting, camera, image, count(DISTINCT tag) FILTER (WHERE tag < 70) AS t, count(*) FILTER (WHERE tag < 70) AS b, count(*) FILTER (WHERE tag >= 70) AS f FROM x GROUP BY ALL),
        s AS (SELECT setting, sum(t)::BIGINT AS board_tags, sum(b - t)::BIGINT AS duplicates, sum(f)::BIGINT AS false_ids, count(*) FILTER (WHERE t >= 30) AS usable_images,
          sum(b - t + f) / sum(b + f) AS rate FROM a GROUP BY setting),
        bs AS (SELECT setting FROM s WHERE rate <= 0.26 ORDER BY board_tags DESC, duplicates + false_ids, usable_images DESC, setting LIMIT 1)
        SELECT setting, board_tags, duplicates, false_ids, usable_images, {q('rate', 6)} AS bad_rate, rate > 0.26 AS refused, setting IN (SELECT setting FROM bs) AS best FROM s"""),
    "h19_region_shares": sql("detections", body=f""", r AS (SELECT image, camera = 'O' AS k, u, v, tag % 3 > 0 AS used, tag % 4 = 0 AS grip, image % 50 AS o FROM detections),
        s AS (SELECT *, [900e0 * (v - 200) - 60e0 * (u - 300 - o), 100e0 * (v - 260) - 640e0 * (u - 1200 - o), -1050e0 * (v - 900) + 100e0 * (u - 1300 - o),
          50e0 * (v - 800) + 600e0 * (u - 250 - o)] AS sd FROM r),
        i AS (SELECT *, (list_min(sd) >= 0 OR list_max(sd) <= 0)::INT AS i FROM s)
        SELECT image, count(*) FILTER (WHERE k) AS keypoints, count(*) FILTER (WHERE k AND used) AS triangulated, {q('100 * avg(i) FILTER (WHERE k AND used)')} AS triangulated_on_board,
        count(*) FILTER (WHERE NOT k) AS points, {q('100 * avg(i) FILTER (WHERE NOT k)')} AS points_on_board, {q('100 * avg(grip::INT) FILTER (WHERE NOT k)')} AS resisting,
        {q('100 * avg(i) FILTER (WHERE NOT k AND grip)')} AS resisting_on_board FROM i GROUP BY image"""),
}
