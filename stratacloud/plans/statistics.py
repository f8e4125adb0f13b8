"""Registered queries: residual statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions.columns import quantise
from stratacloud.functions.geometry import normalised_radius
from stratacloud.operators import residuals as r
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql

RADII = (0.33, 0.66)
EDGES = [0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 0.9]
SHORT = ("rms", "rms_outer", "rms_near")


def quantised(df, *columns, digits=5):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def rows(spark, sf):
    return b.residuals(spark, sf).withColumn("r", normalised_radius("u", "v", (800.0, 600.0), (1600.0, 1200.0)))


def bars(spark, sf):
    """One bar row per split, technique and held-out pair."""
    return b.residuals(spark, sf).groupBy("split", "technique", "frame").agg(
        F.avg("frame_distance_mm").alias("frame_distance_mm"), F.avg(F.col("du") * 10).alias("length_bias_mm"),
        F.sqrt(F.avg(F.col("dv") * F.col("dv") * 100)).alias("length_rms_mm"), F.max(F.col("split") * 0.5 + 100).cast("double").alias("baseline_mm"))


def i1(spark, sf):
    groups = b.residuals(spark, sf).select(F.col("split").alias("group"))
    return r.leave_groups_out(groups, 2).select("split", F.col("test")[0].alias("first"), F.col("test")[1].alias("second"))


def i2(spark, sf):
    frames = b.residuals(spark, sf).select(F.col("split").alias("group"), "frame_distance_mm")
    splits = r.leave_groups_out(frames, 2)
    means = r.training_means(frames, splits, ["frame_distance_mm"], band=(200.0, 800.0), distance="frame_distance_mm")
    return means.select("split", "n", quantise("frame_distance_mm", 3).alias("mean_mm"))


def i3(spark, sf):
    return quantised(r.residual_rms(rows(spark, sf), ["split", "technique", "camera"]), "rms")


def i4(spark, sf):
    return quantised(r.zone_rms(rows(spark, sf), ["technique", "camera"], RADII), "rms_centre", "rms_mid", "rms_outer",
                     "mid_to_centre", "outer_to_centre")


def i5(spark, sf):
    return quantised(r.binned_rms(rows(spark, sf), ["technique", "camera"], "r", EDGES, 500), "centre", "rms")


def i6(spark, sf):
    return quantised(r.grid_stats(rows(spark, sf), ["camera"], (1500.0, 1100.0), (12, 9), 30), "mean_error", "mean_du", "mean_dv")


def _corners(spark, sf):
    """Corners on a tag grid with a measured position near the true one."""
    d = b.detections(spark, sf).where("tag < 70").groupBy("channel", "image", "tag").agg(
        F.avg("u").alias("u"), F.avg("v").alias("v"))
    tx, ty = (F.col("tag") % 10) * 46.0, F.floor(F.col("tag") / 10) * 46.0
    return d.select("channel", "image", F.col("tag").alias("corner"), tx.cast("double").alias("ox"), ty.cast("double").alias("oy"),
                    F.lit(0.0).alias("oz"), (tx + F.col("u") / 400).alias("x"), (ty + F.col("v") / 300).alias("y"), F.lit(1.0).alias("z"))


def i7(spark, sf):
    return quantised(r.scale_bars(_corners(spark, sf), ["channel", "image"], (92.0, 130.5)), "length_bias_mm", "length_rms_mm",
                     "length_bias_pct", digits=4)


def i8(spark, sf):
    return quantised(r.camera_metrics(rows(spark, sf), RADII), *r.CAMERA_METRICS)


def i9(spark, sf):
    return quantised(r.stereo_metrics(bars(spark, sf)), *r.STEREO_METRICS)


def _metrics(spark, sf):
    return r.camera_metrics(rows(spark, sf), RADII)


def i10(spark, sf):
    values = r.residual_rms(rows(spark, sf), ["split", "technique", "camera"]).withColumnRenamed("rms", "value")
    values = values.withColumn("value", F.when(F.col("split") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).drop("n")
    return quantised(r.split_interval(values, ["technique", "camera"]), "mean", "lo", "hi")


def i11(spark, sf):
    return quantised(r.paired_comparison(_metrics(spark, sf), SHORT), "mean", "lo", "hi")


def i12(spark, sf):
    return quantised(r.profile_with_band(rows(spark, sf), ["technique"], "r", EDGES, 800), "centre", "rms", "lo", "hi")


def i13(spark, sf):
    return quantised(r.length_by_distance(bars(spark, sf), 100.0), "bias", "rms", "lo", "hi", "centre")


def i14(spark, sf):
    return quantised(r.summary_table(_metrics(spark, sf), SHORT, ["technique", "camera"]), "mean", "lo", "hi")


def i15(spark, sf):
    pairs = rows(spark, sf).select("technique").distinct()
    wanted = pairs.select(F.col("technique").alias("a")).join(pairs.select(F.col("technique").alias("b")),
                                                              F.col("a") > F.col("b"))
    return quantised(r.signed_lookup(r.paired_comparison(_metrics(spark, sf), ("rms",)), wanted), "mean", "lo", "hi")


def i16(spark, sf):
    fits = r.correlation_matrix(rows(spark, sf).withColumn("w", F.col("u") * F.col("du") + F.col("frame_distance_mm") / 50),
                                ["technique", "camera"], ["u", "v", "du", "dv", "w"])
    return quantised(r.strongest_correlations(fits, ["technique", "camera"]), "value")


QUERIES = {
    "i1_leave_groups_out": i1, "i2_training_rows": i2, "i3_residual_rms": i3, "i4_zone_rms": i4, "i5_binned_rms": i5,
    "i6_grid_stats": i6, "i7_scale_bars": i7, "i8_camera_metrics": i8, "i9_stereo_metrics": i9, "i10_split_interval": i10,
    "i11_paired_comparison": i11, "i12_profile_band": i12, "i13_length_by_distance": i13, "i14_summary_table": i14,
    "i15_signed_lookup": i15, "i16_strongest_correlations": i16,
}


def Q(expression, digits=5):
    return q(expression, digits)


_ROWS = ", rr AS (SELECT *, sqrt(pow(u - 800, 2) + pow(v - 600, 2)) / 1000 AS r, du*du + dv*dv AS e2 FROM residuals)"
_ZONED = _ROWS + ", zz AS (SELECT *, CASE WHEN r < 0.33 THEN 0 WHEN r < 0.66 THEN 1 ELSE 2 END AS z FROM rr)"
_NEAR, _FAR = "frame_distance_mm >= 200 AND frame_distance_mm < 800", "frame_distance_mm >= 1000 AND frame_distance_mm < 1500"
_CAMERA = _ZONED + f""", cm0 AS (SELECT split, technique, camera, sqrt(avg(e2)) AS rms,
  sqrt(avg(e2) FILTER (WHERE z = 0)) AS rms_centre, sqrt(avg(e2) FILTER (WHERE z = 1)) AS rms_mid, sqrt(avg(e2) FILTER (WHERE z = 2)) AS rms_outer,
  sqrt(avg(e2) FILTER (WHERE {_NEAR})) AS rms_near, sqrt(avg(e2) FILTER (WHERE {_FAR})) AS rms_far,
  sqrt(avg(e2) FILTER (WHERE z = 0 AND {_NEAR})) AS rms_near_centre, sqrt(avg(e2) FILTER (WHERE z = 0 AND {_FAR})) AS rms_far_centre,
  count(*) AS n_points, count(*) FILTER (WHERE z = 0) AS n_centre, count(*) FILTER (WHERE z = 1) AS n_mid, count(*) FILTER (WHERE z = 2) AS n_outer
  FROM zz GROUP BY split, technique, camera),
cm AS (SELECT *, CASE WHEN rms_centre > 0 THEN rms_mid / rms_centre END AS mid_to_centre, CASE WHEN rms_centre > 0 THEN rms_outer / rms_centre END AS outer_to_centre,
  CASE WHEN rms_near > 0 THEN rms_far / rms_near END AS far_to_near, CASE WHEN rms_near_centre > 0 THEN rms_far_centre / rms_near_centre END AS far_to_near_centre FROM cm0)
"""
_LONG = _CAMERA + """, lm AS (SELECT split, technique, camera, 'rms' AS metric, rms AS value FROM cm UNION ALL
  SELECT split, technique, camera, 'rms_outer', rms_outer FROM cm UNION ALL SELECT split, technique, camera, 'rms_near', rms_near FROM cm)
"""
_DIFF = _LONG + """, df AS (SELECT a.technique AS a, b.technique AS b, camera, metric, a.value - b.value AS d FROM lm a
  JOIN lm b USING (split, camera, metric) WHERE a.technique < b.technique)
"""
_BARS = """, bars AS (SELECT split, technique, frame, avg(frame_distance_mm) AS frame_distance_mm, avg(du * 10) AS length_bias_mm,
  sqrt(avg(dv * dv * 100)) AS length_rms_mm, max(split * 0.5e0 + 100) AS baseline_mm FROM residuals GROUP BY split, technique, frame)
"""
_BINS = f"bins AS (SELECT unnest(range({len(EDGES) - 1})) AS bin, unnest({EDGES[:-1]}::DOUBLE[]) AS lo_e, unnest({EDGES[1:]}::DOUBLE[]) AS hi_e)"
_INTERVAL = f"{Q('avg(value)')} AS mean, {Q('quantile_cont(value, 0.025)')} AS lo, {Q('quantile_cont(value, 0.975)')} AS hi, count(value) AS n"

ORACLES = {
    "i1_leave_groups_out": sql("residuals", body=""", g AS (SELECT DISTINCT split AS g FROM residuals)
        SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split, a.g AS first, b.g AS second FROM g a JOIN g b ON a.g < b.g"""),
    "i2_training_rows": sql("residuals", body=f""", f AS (SELECT split AS g, frame_distance_mm AS d FROM residuals),
        g AS (SELECT DISTINCT g FROM f), s AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split, a.g AS x, b.g AS y FROM g a JOIN g b ON a.g < b.g)
        SELECT split, count(*) AS n, {Q('avg(d)', 3)} AS mean_mm FROM f JOIN s ON f.g <> s.x AND f.g <> s.y WHERE d >= 200 AND d < 800 GROUP BY split"""),
    "i3_residual_rms": sql("residuals", body=f"""SELECT split, technique, camera, {Q('sqrt(avg(du*du + dv*dv))')} AS rms, count(*) AS n
        FROM residuals GROUP BY split, technique, camera"""),
    "i4_zone_rms": sql("residuals", body=_ZONED + f""", s AS (SELECT technique, camera, sqrt(avg(e2) FILTER (WHERE z = 0)) AS c,
        sqrt(avg(e2) FILTER (WHERE z = 1)) AS m, sqrt(avg(e2) FILTER (WHERE z = 2)) AS o, count(*) FILTER (WHERE z = 0) AS n_centre,
        count(*) FILTER (WHERE z = 1) AS n_mid, count(*) FILTER (WHERE z = 2) AS n_outer FROM zz GROUP BY technique, camera)
        SELECT technique, camera, {Q('c')} AS rms_centre, {Q('m')} AS rms_mid, {Q('o')} AS rms_outer, n_centre, n_mid, n_outer,
        {Q('m / c')} AS mid_to_centre, {Q('o / c')} AS outer_to_centre FROM s"""),
    "i5_binned_rms": sql("residuals", body=_ROWS + f""", {_BINS}, k AS (SELECT DISTINCT technique, camera FROM residuals),
        g AS (SELECT * FROM k, bins)
        SELECT g.technique, g.camera, g.bin, {Q('any_value((lo_e + hi_e) / 2)')} AS centre,
        CASE WHEN count(e2) >= 500 THEN {Q('sqrt(avg(e2))')} END AS rms, count(e2) AS n FROM g
        LEFT JOIN rr ON rr.technique = g.technique AND rr.camera = g.camera AND r >= lo_e AND r < hi_e GROUP BY ALL"""),
    "i6_grid_stats": sql("residuals", body=f""", p AS (SELECT camera, least(floor(u * 12 / 1500), 11)::BIGINT AS col_, least(floor(v * 9 / 1100), 8)::BIGINT AS row_,
        du, dv FROM residuals WHERE u >= 0 AND u < 1500 AND v >= 0 AND v < 1100),
        f AS (SELECT camera, row_, col_, avg(sqrt(du*du + dv*dv)) AS e, avg(du) AS a, avg(dv) AS b, count(*) AS n FROM p GROUP BY ALL),
        g AS (SELECT camera, row_, col_ FROM (SELECT DISTINCT camera FROM residuals), (SELECT unnest(range(9)) AS row_), (SELECT unnest(range(12)) AS col_))
        SELECT camera, row_, col_, CASE WHEN n >= 30 THEN {Q('e')} END AS mean_error, CASE WHEN n >= 30 THEN {Q('a')} END AS mean_du,
        CASE WHEN n >= 30 THEN {Q('b')} END AS mean_dv, coalesce(n, 0) AS n, coalesce(n, 0) >= 30 AS valid FROM g LEFT JOIN f USING (camera, row_, col_)"""),
    "i7_scale_bars": sql("detections", body=f""", c AS (SELECT channel, image, tag, (tag % 10) * 46e0 AS ox, (tag // 10) * 46e0 AS oy,
        (tag % 10) * 46e0 + avg(u) / 400 AS x, (tag // 10) * 46e0 + avg(v) / 300 AS y FROM detections WHERE tag < 70 GROUP BY channel, image, tag),
        p AS (SELECT channel, image, sqrt(pow(a.ox - b.ox, 2) + pow(a.oy - b.oy, 2)) AS t, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s
          FROM c a JOIN c b USING (channel, image) WHERE a.tag < b.tag)
        SELECT channel, image, {q('avg(s - t)')} AS length_bias_mm, {q('sqrt(avg((s - t) * (s - t)))')} AS length_rms_mm,
        {q('avg((s - t) / t * 100)')} AS length_bias_pct, count(*) AS bars FROM p WHERE t BETWEEN 92 AND 130.5 GROUP BY channel, image"""),
    "i8_camera_metrics": sql("residuals", body=_CAMERA + "SELECT split, technique, camera, n_points, n_centre, n_mid, n_outer, " + ", ".join(
        f"{Q(m)} AS {m}" for m in r.CAMERA_METRICS) + " FROM cm"),
    "i9_stereo_metrics": sql("residuals", body=_BARS + f"""SELECT split, technique, {Q('avg(length_bias_mm)')} AS length_bias_mm,
        {Q('sqrt(avg(length_rms_mm * length_rms_mm))')} AS length_rms_mm, {Q(f'avg(length_bias_mm) FILTER (WHERE {_FAR})')} AS length_bias_far_mm,
        {Q(f'sqrt(avg(length_rms_mm * length_rms_mm) FILTER (WHERE {_FAR}))')} AS length_rms_far_mm, {Q('any_value(baseline_mm)')} AS baseline_mm,
        count(*) AS n_pairs FROM bars GROUP BY split, technique"""),
    "i10_split_interval": sql("residuals", body=f""", v AS (SELECT split, technique, camera, CASE WHEN split % 5 <> 0 THEN sqrt(avg(du*du + dv*dv)) END AS value
        FROM residuals GROUP BY split, technique, camera) SELECT technique, camera, {_INTERVAL} FROM v GROUP BY technique, camera"""),
    "i11_paired_comparison": sql("residuals", body=_DIFF + f"""SELECT a, b, camera, metric, {_INTERVAL.replace('value', 'd')},
        count(d) = 0 OR (quantile_cont(d, 0.025) <= 0 AND quantile_cont(d, 0.975) >= 0) AS within_noise FROM df GROUP BY a, b, camera, metric"""),
    "i12_profile_band": sql("residuals", body=_ROWS + f""", {_BINS}, b AS (SELECT technique, split, bin, e2 FROM rr JOIN bins ON r >= lo_e AND r < hi_e),
        s AS (SELECT technique, split, bin, CASE WHEN count(*) >= 200 THEN sqrt(avg(e2)) END AS v FROM b GROUP BY ALL),
        i AS (SELECT technique, bin, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM s GROUP BY ALL),
        p AS (SELECT technique, bin, CASE WHEN count(*) >= 800 THEN sqrt(avg(e2)) END AS rms, count(*) AS n FROM b GROUP BY ALL),
        g AS (SELECT technique, bin, (lo_e + hi_e) / 2 AS centre FROM (SELECT DISTINCT technique FROM residuals), bins)
        SELECT technique, bin, {Q('centre')} AS centre, {Q('rms')} AS rms, coalesce(n, 0) AS n, CASE WHEN rms IS NOT NULL THEN {Q('lo')} END AS lo,
        CASE WHEN rms IS NOT NULL THEN {Q('hi')} END AS hi FROM g LEFT JOIN p USING (technique, bin) LEFT JOIN i USING (technique, bin)"""),
    "i13_length_by_distance": sql("residuals", body=_BARS + f""", b AS (SELECT *, floor(frame_distance_mm / 100)::BIGINT AS bin FROM bars),
        s AS (SELECT technique, bin, split, avg(length_bias_mm) AS v FROM b GROUP BY ALL),
        i AS (SELECT technique, bin, {Q('quantile_cont(v, 0.025)')} AS lo, {Q('quantile_cont(v, 0.975)')} AS hi FROM s GROUP BY ALL)
        SELECT technique, bin, {Q('avg(length_bias_mm)')} AS bias, {Q('sqrt(avg(length_rms_mm * length_rms_mm))')} AS rms, count(*) AS rows,
        any_value(lo) AS lo, any_value(hi) AS hi, {Q('(bin + 0.5e0) * 100')} AS centre FROM b JOIN i USING (technique, bin)
        GROUP BY technique, bin HAVING count(*) >= 3"""),
    "i14_summary_table": sql("residuals", body=_LONG + f"SELECT technique, camera, metric, {_INTERVAL} FROM lm GROUP BY technique, camera, metric"),
    "i15_signed_lookup": sql("residuals", body=_DIFF + f"""SELECT b AS a, a AS b, camera, metric, {Q('-avg(d)')} AS mean, {Q('-quantile_cont(d, 0.975)')} AS lo,
        {Q('-quantile_cont(d, 0.025)')} AS hi, count(d) AS n, count(d) = 0 OR (quantile_cont(d, 0.025) <= 0 AND quantile_cont(d, 0.975) >= 0) AS within_noise
        FROM df WHERE metric = 'rms' GROUP BY a, b, camera, metric"""),
    "i16_strongest_correlations": sql("residuals", body=""", rw AS (SELECT *, u * du + frame_distance_mm / 50 AS w FROM residuals), c AS (""" + " UNION ALL ".join(
        f"SELECT technique, camera, '{a}' AS first, '{c}' AS second, corr({a}, {c}) AS value FROM rw GROUP BY technique, camera"
        for k, a in enumerate(["u", "v", "du", "dv", "w"]) for c in ["u", "v", "du", "dv", "w"][k + 1:]) + f"""),
        k AS (SELECT *, row_number() OVER (PARTITION BY technique, camera ORDER BY abs(value) DESC, first DESC, second DESC) AS rank FROM c)
        SELECT technique, camera, first, second, {Q('value')} AS value, rank FROM k WHERE rank <= 3"""),
}
