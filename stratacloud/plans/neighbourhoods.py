"""Registered queries: neighbourhoods, meshes and checks between clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions import geometry as g
from stratacloud.functions.columns import quantise
from stratacloud.operators import cloud
from stratacloud.operators import neighbours as n
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql
from stratacloud.session import cut_lineage

MESH_CELL = 8.0


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def _split(spark, sf):
    points = b.points(spark, sf)
    return points.where("method = 'F'"), points.where("method = 'O'")


def mesh(spark, sf):
    """Two triangles per 2x2 block of 8 mm cells of the median height of scan A."""
    field = cloud.cell_quantiles(b.points(spark, sf).where("scan = 'A'").select(
        "z", F.floor(F.col("x") / MESH_CELL).alias("i"), F.floor(F.col("y") / MESH_CELL).alias("j")), ["i", "j"], "z", {"z": ("at", 1, 2)})
    tri = cloud.grid_triangles(field, 100.0)
    x0, y0 = (F.col("i") + 0.5) * MESH_CELL, (F.col("j") + 0.5) * MESH_CELL
    first = F.col("half") == 0
    return tri.select((F.col("i") * 10_000 + F.col("j") * 2 + F.col("half")).alias("tri"),
                      x0.alias("ax"), y0.alias("ay"), F.col("z1").alias("az"),
                      (x0 + MESH_CELL).alias("bx"), F.when(first, y0).otherwise(y0 + MESH_CELL).alias("by"), F.col("z2").alias("bz"),
                      F.when(first, x0 + MESH_CELL).otherwise(x0).alias("cx"), (y0 + MESH_CELL).alias("cy"), F.col("z3").alias("cz"))


def e1(spark, sf):
    return quantised(n.distance_summary(n.place_distances(*_split(spark, sf), ["scan"]), ["scan"]), "median", "p90")


def e1_rows(spark, sf):
    return n.repeated(quantised(n.place_distances(*_split(spark, sf), ["scan"]), "d")).select("scan", "x", "y", "z", "d")


def e2(spark, sf):
    return quantised(n.accuracy_completeness(*_split(spark, sf), ["scan"]), "accuracy", "completeness")


def e3(spark, sf):
    samples, points = _split(spark, sf)
    return quantised(n.coverage_of(samples.withColumn("facet", F.col("frame") % 5), points, 1.5, ["scan"], "facet"), "coverage", "share")


def e4(spark, sf):
    kept = n.remove_outliers(b.points(spark, sf), 8, 1.0, ["frame"])
    return kept.groupBy("frame").agg(F.count("*").alias("kept"), quantise(F.avg("mean_d")).alias("mean_d"))


def e5(spark, sf):
    raised = b.points(spark, sf).where("z > 3")
    return n.density_clusters(raised, 1.6, 5, ["scan"]).groupBy("scan", "cluster").agg(F.count("*").alias("points"))


def e5_object(spark, sf):
    return n.object_places(b.points(spark, sf), 3.0, 12.0, 1.6, 5, ["scan"]).groupBy("scan").agg(F.sum("copies").alias("points"))


def e6(spark, sf):
    return quantised(n.estimate_normals(b.points(spark, sf), 3.0, 30, ["scan"]), "nx", "ny", "nz")


def e7(spark, sf):
    closest = n.closest_on_mesh(b.points(spark, sf), mesh(spark, sf), ["scan"])
    return quantised(closest, "distance", "signed_distance").select("scan", "x", "y", "z", "distance")


def e8(spark, sf):
    card = n.surface_scorecard(b.points(spark, sf), mesh(spark, sf), ["scan"], 3.0, -6.0)
    return quantised(card, *[c for c in card.columns if c not in ("scan", "points", "points_outside")])


def e9(spark, sf):
    tri = cut_lineage(mesh(spark, sf))
    points = cut_lineage(n.in_footprint(b.points(spark, sf).select("x", "y", "z"), tri, 2.0).where("inside").drop("inside"))
    scored = points.join(n.closest_on_mesh(points, tri), ["x", "y", "z"])      # every copy of a position counts
    samples = n.covered(n.sample_surface(tri), b.points(spark, sf))
    return n.facet_scorecard(scored, n.facet_labels(tri, 5.0), samples)


def e10(spark, sf):
    return n.sample_surface(mesh(spark, sf), 1.0, 1000).groupBy("tri").agg(F.count("*").alias("samples"))


def _verdicts(spark, sf):
    sparse, dense = _split(spark, sf)
    return n.cross_check(sparse, dense, ["scan"], 1.2, 5, 2.0)


def e11(spark, sf):
    return _verdicts(spark, sf).select("scan", "frame", "x", "y", "z", "support", "verdict")


def e12(spark, sf):
    judged = n.veto(_verdicts(spark, sf).select("scan", "x", "y", "z", "verdict"), ["scan"], 4.0, 0.5)
    counts = quantised(n.verdict_counts(judged, ["scan"]), "percent")
    fused = n.fuse_checked(_split(spark, sf)[0], judged, ["scan", "x", "y", "z"])
    return counts.join(fused.groupBy("scan").agg(F.count("*").alias("fused")), "scan")


def e13(spark, sf):
    anchors = b.table(spark, sf, "nation").select((F.col("n_nationkey") * 2.0).alias("x"), (F.col("n_nationkey") * 4.0 + 0.37).alias("y"))
    stats = n.anchor_statistics(b.points(spark, sf), anchors, ["scan"], 2.5, 8.0, 6.0, 30.0)
    return quantised(stats, "board_rms", "cx", "cy", "height")


def e14(spark, sf):
    dx, dy, dz = F.col("x") - 25.0, F.col("y") - 50.0, F.col("z") - 5.1
    size = F.sqrt(dx * dx + dy * dy + dz * dz)
    normals = b.points(spark, sf).select("frame", "method", (dx / size).alias("nx"), (dy / size).alias("ny"), (dz / size).alias("nz"))
    qx, qy, qz = F.col("qx"), F.col("qy"), F.col("qz")
    length = F.sqrt(qx * qx + qy * qy + qz * qz)
    directions = b.poses(spark, sf).select("frame", (qx / length).alias("tx"), (qy / length).alias("ty"), (qz / length).alias("tz"))
    counts = n.grip_counts(normals, directions.crossJoin(
        F.broadcast(normals.select("method").distinct())), ["method", "frame"])
    return n.grip_medians(counts, ["method"])


def _frames(spark, sf):
    return b.poses(spark, sf).select("frame", "lost", g.quaternion_pose(
        [F.lit(1.0), F.col("qx") * 0.05, F.col("qy") * 0.05, F.col("qz") * 0.05], [F.col("tx") / 20, F.col("ty") / 20, F.col("tz") / 20]).alias("T"))


def e15(spark, sf):
    used = b.points(spark, sf).select("frame", "x", "y", "z", "grey")
    return n.map_matched(used, _frames(spark, sf), 3.0, 2.0, 10).groupBy("frame").agg(
        F.count("*").alias("points"), F.count(F.when(F.col("matched"), 1)).alias("matched"))


def e16(spark, sf):
    source, target = _split(spark, sf)
    normals = cut_lineage(n.estimate_normals(target, 3.0, 30, ["scan"]))
    by_scan = n.translation_constraint(source.select("scan", "x", "y", "z"), normals, ["scan"], 2.0)
    return quantised(by_scan, "constraint")


def e17(spark, sf):
    d = b.detections(spark, sf)
    pixels = d.where("camera = 'O'").select("image", "u", "v")
    corners = d.where("camera = 'F'").select("image", "u", "v")
    kept = n.observed_places(pixels, corners, ["image"], 30.0)
    x, y = (F.col("u") - 800) / 900, (F.col("v") - 600) / 900
    air = n.ray_angle(x, y)
    water = F.degrees(F.atan(g.refract_radial(F.hypot(x, y), 1.333)))
    gap = F.sum(F.col("copies") * (air - water)) / F.sum("copies")
    return kept.groupBy("image").agg(F.sum("copies").alias("pixels"), quantise(gap).alias("gap_deg"))


QUERIES = {
    "e1_nearest_summary": e1, "e1_nearest_distance": e1_rows, "e2_accuracy_completeness": e2, "e3_radius_coverage": e3,
    "e4_outlier_removal": e4, "e5_density_clusters": e5, "e5_object_points": e5_object, "e6_normals": e6,
    "e7_closest_on_mesh": e7, "e8_scorecard": e8, "e9_facet_scorecard": e9, "e10_sample_surface": e10,
    "e11_cross_check": e11, "e12_veto": e12, "e13_anchor_statistics": e13, "e14_grip": e14, "e15_map_matched": e15,
    "e16_translation_constraint": e16, "e17_observed_only": e17,
}

_NN = """, f AS (SELECT * FROM points WHERE method = 'F'), o AS (SELECT DISTINCT scan, x, y, z FROM points WHERE method = 'O'),
fd AS (SELECT DISTINCT scan, x, y, z FROM f),
nn AS (SELECT s.scan, s.x, s.y, s.z, sqrt(min(pow(s.x - o.x, 2) + pow(s.y - o.y, 2) + pow(s.z - o.z, 2))) AS d
  FROM fd s JOIN o USING (scan) GROUP BY ALL),
d AS (SELECT f.scan, f.frame, f.x, f.y, f.z, nn.d FROM f JOIN nn USING (scan, x, y, z))
"""
_MESH = """, cell AS (SELECT floor(x / 8)::BIGINT AS i, floor(y / 8)::BIGINT AS j, list_sort(list(z))[count(*) // 2 + 1] AS z FROM points
  WHERE scan = 'A' GROUP BY 1, 2),
blk AS (SELECT a.i, a.j, (a.i + 0.5e0) * 8 AS x0, (a.j + 0.5e0) * 8 AS y0, a.z AS a, b.z AS b, c.z AS c, d.z AS d FROM cell a
  JOIN cell d ON d.i = a.i + 1 AND d.j = a.j + 1 LEFT JOIN cell b ON b.i = a.i + 1 AND b.j = a.j LEFT JOIN cell c ON c.i = a.i AND c.j = a.j + 1),
tri AS (SELECT i * 10000 + j * 2 AS tri, x0 AS ax, y0 AS ay, a AS az, x0 + 8 AS bx, y0 AS by_, b AS bz, x0 + 8 AS cx, y0 + 8 AS cy, d AS cz FROM blk WHERE b IS NOT NULL
  UNION ALL SELECT i * 10000 + j * 2 + 1, x0, y0, a, x0 + 8, y0 + 8, d, x0, y0 + 8, c FROM blk WHERE c IS NOT NULL),
nrm AS (SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS uz FROM tri),
nr AS (SELECT *, ux / sqrt(ux*ux+uy*uy+uz*uz) AS nx, uy / sqrt(ux*ux+uy*uy+uz*uz) AS ny, uz / sqrt(ux*ux+uy*uy+uz*uz) AS nz FROM nrm),
p AS (SELECT DISTINCT scan, x, y, z FROM points),
h AS (SELECT *, (x-ax)*nx + (y-ay)*ny + (z-az)*nz AS h FROM p, nr),
ft AS (SELECT *, x - h*nx AS fx, y - h*ny AS fy, z - h*nz AS fz,
  greatest(0, least(1, ((x-ax)*(bx-ax) + (y-ay)*(by_-ay) + (z-az)*(bz-az)) / ((bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) + (bz-az)*(bz-az)))) AS t1,
  greatest(0, least(1, ((x-bx)*(cx-bx) + (y-by_)*(cy-by_) + (z-bz)*(cz-bz)) / ((cx-bx)*(cx-bx) + (cy-by_)*(cy-by_) + (cz-bz)*(cz-bz)))) AS t2,
  greatest(0, least(1, ((x-cx)*(ax-cx) + (y-cy)*(ay-cy) + (z-cz)*(az-cz)) / ((ax-cx)*(ax-cx) + (ay-cy)*(ay-cy) + (az-cz)*(az-cz)))) AS t3 FROM h),
dist AS (SELECT scan, x, y, z, tri, h, least(
  CASE WHEN (bx-ax)*(fy-ay) - (by_-ay)*(fx-ax) >= 0 AND (cx-bx)*(fy-by_) - (cy-by_)*(fx-bx) >= 0 AND (ax-cx)*(fy-cy) - (ay-cy)*(fx-cx) >= 0
    THEN h*h ELSE 'inf'::DOUBLE END,
  pow(x-ax-t1*(bx-ax), 2) + pow(y-ay-t1*(by_-ay), 2) + pow(z-az-t1*(bz-az), 2),
  pow(x-bx-t2*(cx-bx), 2) + pow(y-by_-t2*(cy-by_), 2) + pow(z-bz-t2*(cz-bz), 2),
  pow(x-cx-t3*(ax-cx), 2) + pow(y-cy-t3*(ay-cy), 2) + pow(z-cz-t3*(az-cz), 2)) AS d2 FROM ft),
near AS (SELECT scan, x, y, z, sqrt(min(d2)) AS distance, arg_min(h, d2) AS h FROM dist GROUP BY scan, x, y, z)
"""
_CHECK = """, dense AS (SELECT * FROM points WHERE method = 'O'), sparse AS (SELECT * FROM points WHERE method = 'F'),
spot AS (SELECT DISTINCT scan, x, y FROM dense),
sup AS (SELECT s.scan, s.x, s.y, count(*) AS support, quantile_cont(p.z, 0.5) AS m FROM spot s JOIN sparse p ON s.scan = p.scan
  AND p.x BETWEEN s.x - 1.2 AND s.x + 1.2 AND sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) <= 1.2 GROUP BY s.scan, s.x, s.y),
ver AS (SELECT d.scan, frame, d.x, d.y, d.z, coalesce(support, 0) AS support, CASE WHEN coalesce(support, 0) < 5 THEN 'unchecked'
  WHEN abs(d.z - m) <= 2 THEN 'agree' ELSE 'disagree' END AS verdict FROM dense d LEFT JOIN sup USING (scan, x, y))
"""

ORACLES = {
    "e1_nearest_summary": sql("points", body=_NN + f"""SELECT scan, count(*) AS n, {q('quantile_cont(d, 0.5)')} AS median,
        {q('quantile_cont(d, 0.9)')} AS p90 FROM d GROUP BY scan"""),
    "e1_nearest_distance": sql("points", body=_NN + f"SELECT scan, x, y, z, {q('d')} AS d FROM d"),
    "e2_accuracy_completeness": sql("points", body=_NN + f""", fo AS (SELECT * FROM points WHERE method = 'O'), ff AS (SELECT DISTINCT scan, x, y, z FROM f),
        back AS (SELECT o.scan, o.x, o.y, o.z, sqrt(min(pow(s.x - o.x, 2) + pow(s.y - o.y, 2) + pow(s.z - o.z, 2))) AS d FROM o JOIN ff s USING (scan) GROUP BY ALL),
        e AS (SELECT fo.scan, back.d FROM fo JOIN back USING (scan, x, y, z)), t AS (SELECT unnest([1e0, 2e0, 5e0]) AS threshold),
        a AS (SELECT scan, threshold, {q('avg((d <= threshold)::INT)')} AS accuracy FROM d, t GROUP BY ALL),
        c AS (SELECT scan, threshold, {q('avg((d <= threshold)::INT)')} AS completeness FROM e, t GROUP BY ALL)
        SELECT * FROM a JOIN c USING (scan, threshold)"""),
    "e3_radius_coverage": sql("points", body=_NN + f"""SELECT scan, frame % 5 AS facet, {q('avg((d <= 1.5)::INT)')} AS coverage, count(*) AS samples,
        {q('count(*) / any_value((SELECT count(*) FROM d))')} AS share FROM d GROUP BY scan, frame % 5"""),
    "e4_outlier_removal": sql("points", body=f""", p AS (SELECT row_number() OVER () AS id, frame, x, y, z FROM points),
        k AS (SELECT a.id, a.frame, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM p a JOIN p b USING (frame)),
        r AS (SELECT id, frame, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM k) WHERE rn <= 8 GROUP BY id, frame),
        l AS (SELECT frame, avg(m) + 1.0e0 * stddev_samp(m) AS lim FROM r GROUP BY frame)
        SELECT frame, count(*) AS kept, {q('avg(m)')} AS mean_d FROM r JOIN l USING (frame) WHERE m > 0 AND m < lim GROUP BY frame"""),
    "e7_closest_on_mesh": sql("points", body=_MESH + f"SELECT scan, x, y, z, {q('distance')} AS distance FROM near"),
    "e8_scorecard": sql("points", body=_MESH + f""", box AS (SELECT min(least(ax, bx, cx)) AS x0, max(greatest(ax, bx, cx)) AS x1, min(least(ay, by_, cy)) AS y0,
        max(greatest(ay, by_, cy)) AS y1 FROM tri),
        fl AS (SELECT p.*, x BETWEEN x0 + 6 AND x1 - 6 AND y BETWEEN y0 + 6 AND y1 - 6 AS inn, x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3 AS wide
          FROM points p, box),
        s AS (SELECT scan, sign(h) * distance AS s FROM fl JOIN near USING (scan, x, y, z) WHERE inn),
        o AS (SELECT scan, count(*) FILTER (WHERE wide AND NOT inn) AS points_outside FROM fl GROUP BY scan)
        SELECT scan, count(*) AS points, any_value(points_outside) AS points_outside, {q('avg(s)')} AS mean_signed, {q('stddev_pop(s)')} AS std,
        {q('sqrt(avg(s*s))')} AS rms, {q('max(abs(s))')} AS max_abs, {q('avg((abs(s) < 1)::INT)')} AS within_1mm, {q('avg((abs(s) < 2)::INT)')} AS within_2mm,
        {q('avg((abs(s) < 5)::INT)')} AS within_5mm, {q('quantile_cont(s, 0.5)')} AS median_signed, {q('quantile_cont(abs(s), 0.5)')} AS median_abs,
        {q('quantile_cont(abs(s), 0.9)')} AS p90_abs, {q('quantile_cont(abs(s), 0.95)')} AS p95_abs FROM s JOIN o USING (scan) GROUP BY scan"""),
    "e11_cross_check": sql("points", body=_CHECK + "SELECT * FROM ver"),
    "e12_veto": sql("points", body=_CHECK + f""", org AS (SELECT scan, min(x) AS x0, min(y) AS y0 FROM ver GROUP BY scan),
        pl AS (SELECT ver.*, floor((x - x0) / 2)::BIGINT AS gi, floor((y - y0) / 2)::BIGINT AS gj FROM ver JOIN org USING (scan)),
        sz AS (SELECT scan, max(gi) + 1 AS ni, max(gj) + 1 AS nj FROM pl GROUP BY scan),
        ce AS (SELECT scan, gi, gj, count(*) AS c, count(*) FILTER (WHERE verdict = 'disagree') AS d FROM pl WHERE verdict <> 'unchecked' GROUP BY ALL),
        m AS (SELECT unnest([-1, 0, 1]) AS m),
        im AS (SELECT scan, unnest([gi + 2*ni*a.m, -1 - gi + 2*ni*a.m]) AS ai, gj, c, d, nj FROM ce JOIN sz USING (scan), m a),
        im2 AS (SELECT scan, ai, unnest([gj + 2*nj*b.m, -1 - gj + 2*nj*b.m]) AS aj, c, d FROM im, m b),
        tg AS (SELECT DISTINCT scan, gi, gj FROM pl WHERE verdict = 'unchecked'),
        sh AS (SELECT t.scan, t.gi, t.gj, sum(d) / sum(c) AS share FROM tg t JOIN im2 i ON t.scan = i.scan AND i.ai BETWEEN t.gi - 2 AND t.gi + 2
          AND i.aj BETWEEN t.gj - 2 AND t.gj + 2 GROUP BY ALL),
        fin AS (SELECT pl.scan, CASE WHEN verdict = 'unchecked' AND coalesce(share, 0) > 0.5 THEN 'vetoed' ELSE verdict END AS verdict
          FROM pl LEFT JOIN sh USING (scan, gi, gj)),
        fu AS (SELECT scan, (SELECT count(*) FROM points p WHERE method = 'F' AND p.scan = fin.scan) + count(*) FILTER (WHERE verdict IN ('agree', 'unchecked')) AS fused
          FROM fin GROUP BY scan)
        SELECT scan, verdict, count(*) AS n, {q('100 * count(*) / any_value(t.n)')} AS percent, any_value(fused) AS fused FROM fin
        JOIN (SELECT scan, count(*) AS n FROM fin GROUP BY scan) t USING (scan) JOIN fu USING (scan) GROUP BY scan, verdict"""),
    "e13_anchor_statistics": sql("points", body=f""", a AS (SELECT n_nationkey * 2e0 AS x, n_nationkey * 4e0 + 0.37e0 AS y FROM nation),
        bd AS (SELECT scan, z FROM points p WHERE abs(z) < 8 AND (SELECT min(sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2))) FROM a) < 2.5),
        ra AS (SELECT * FROM points WHERE z > 6), c AS (SELECT scan, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy FROM ra GROUP BY scan),
        ob AS (SELECT scan, count(*) AS n, quantile_cont(z, 0.995) AS h FROM ra JOIN c USING (scan) WHERE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 30 GROUP BY scan)
        SELECT p.scan, p.n AS points, {q('board_rms')} AS board_rms, {q('cx')} AS cx, {q('cy')} AS cy, ob.n AS on_object, {q('h')} AS height
        FROM (SELECT scan, count(*) AS n FROM points GROUP BY scan) p LEFT JOIN (SELECT scan, sqrt(avg(z*z)) AS board_rms FROM bd GROUP BY scan) USING (scan)
        LEFT JOIN c USING (scan) LEFT JOIN ob USING (scan)"""),
    "e14_grip": sql("points", "poses", body=""", l AS (SELECT method, p.frame, abs(((x-25)*qx + (y-50)*qy + (z-5.1e0)*qz)
        / sqrt((x-25)*(x-25) + (y-50)*(y-50) + (z-5.1e0)*(z-5.1e0)) / sqrt(qx*qx + qy*qy + qz*qz)) AS lean FROM points p JOIN poses USING (frame)),
        c AS (SELECT method, frame, count(*) AS n, count(*) FILTER (WHERE lean > 0.5) AS g FROM l GROUP BY method, frame)
        SELECT method, count(*) AS frames, quantile_cont(g, 0.5)::DOUBLE AS grip, quantile_cont(n, 0.5)::DOUBLE AS points FROM c GROUP BY method"""),
    "e17_observed_only": sql("detections", body=f""", o AS (SELECT image, u, v FROM detections WHERE camera = 'O'), f AS (SELECT DISTINCT image, u, v FROM detections WHERE camera = 'F'),
        k AS (SELECT * FROM o WHERE EXISTS (SELECT 1 FROM f WHERE f.image = o.image AND sqrt(pow(f.u - o.u, 2) + pow(f.v - o.v, 2)) <= 30)),
        r AS (SELECT image, sqrt(pow((u - 800) / 900, 2) + pow((v - 600) / 900, 2)) AS r FROM k)
        SELECT image, count(*) AS pixels, {q('avg(degrees(atan(r)) - degrees(asin(sin(atan(r)) / 1.333e0)))')} AS gap_deg FROM r GROUP BY image"""),
}
