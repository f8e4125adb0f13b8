"""Registered queries: point-cloud aggregation and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacloud.functions.columns import quantise
from stratacloud.operators import cloud
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql

BOX = (5.0, 45.0, 10.0, 90.0)
REGION = (10, 40, 20, 80)


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def voted(spark, sf, min_views=3):
    inside = cloud.in_region(b.points(spark, sf), BOX)
    return quantised(cloud.voxel_vote(inside, 2.0, min_views), "x", "y", "z", "grey")


def d1(spark, sf):
    return quantised(cloud.voxel_mean(b.points(spark, sf), 2.0, ["scan"]), "x", "y", "z", "grey")


def d2(spark, sf):
    return quantised(cloud.voxel_vote(b.points(spark, sf), 1.0, 2), "x", "y", "z", "grey")


def d3(spark, sf):
    fan = cloud.view_fanout(cloud.voxel_vote(b.points(spark, sf), 2.0, 1), [2, 3, 5])
    return fan.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("points"), F.sum("views").alias("views"))


def d4(spark, sf):
    return cloud.depth_raster(b.points(spark, sf).where("z > 0"), 0.25)


def d4_oblique(spark, sf):
    raster = cloud.oblique_raster(b.points(spark, sf), 30.0, 40.0, 1.0, 1, ["method"])
    return quantised(raster, "depth").drop("grey")


def d6(spark, sf):
    frames = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame"))
    poses = b.poses(spark, sf).where("lost = 0").select(F.col("frame"))
    depth = b.points(spark, sf).where("z > 9").select("frame")
    return cloud.reconcile_frames(frames, poses, depth).groupBy("status").agg(F.count("*").alias("frames"))


def d7(spark, sf):
    return quantised(cloud.frame_cells(b.points(spark, sf), 4.0).drop("x0", "y0"), "z", "grey")


def d8(spark, sf):
    return quantised(cloud.median_fuse(b.points(spark, sf), 2.0, 5, 8.0), "x", "y", "z", "spread", "grey")


def d9(spark, sf):
    fused = cloud.median_fuse(b.points(spark, sf), 2.0, 1)
    return quantised(cloud.grid_triangles(fused, 4.0), "z1", "z2", "z3").withColumn("half", F.col("half").cast("long"))


def _fields(spark, sf):
    return cloud.height_field(b.points(spark, sf), 1.0)


def _sigmas(spark, sf):
    return cloud.board_noise(b.points(spark, sf))


def d10(spark, sf):
    return quantised(_fields(spark, sf), "h")


SIGMAS = {"A": 0.9, "N": 0.5, "R": 1.4}


def _fixed_sigmas(spark, sf):
    scans = b.points(spark, sf).select("scan").distinct()
    return scans.select("scan", F.when(F.col("scan") == "A", 0.9).when(F.col("scan") == "N", 0.5).otherwise(1.4).alias("sigma"))


def d11(spark, sf):
    return quantised(cloud.weighted_merge(_fields(spark, sf), _fixed_sigmas(spark, sf), 3.0), "h", "centre")


def d12(spark, sf):
    return quantised(cloud.nearest_merge(_fields(spark, sf), _fixed_sigmas(spark, sf)), "h")


def d13(spark, sf):
    points = b.points(spark, sf)
    parts = {s: points.where(F.col("scan") == s).drop("scan") for s in ("A", "N", "R")}
    fields = cloud.height_field(cloud.concat_clouds(parts), 1.0)
    merged = cloud.weighted_merge(fields, _fixed_sigmas(spark, sf), 3.0)
    return quantised(cloud.merge_coverage(fields, merged), "mean_scans")


def d14(spark, sf):
    return quantised(_sigmas(spark, sf), "sigma")


def d15(spark, sf):
    return quantised(cloud.top_surface(b.points(spark, sf), (10, 40), (20, 80), 2.0, ["method"]), "z")


def d16(spark, sf):
    methods = b.points(spark, sf).select("method").distinct().unionByName(spark.range(1).select(F.lit("none").alias("method")))
    return quantised(cloud.region_coverage(b.points(spark, sf), methods, REGION, 2.0), "coverage")


def d17(spark, sf):
    centres = b.poses(spark, sf).select((F.col("tz") - 4.0).alias("z"))
    flipped = cloud.towards_camera(b.points(spark, sf), centres)
    return flipped.groupBy("method").agg(quantise(F.min("z")).alias("low"), quantise(F.max("z")).alias("high"),
                                         F.count("*").alias("n"))


def d18(spark, sf):
    points = b.points(spark, sf)
    corners = points.where("frame % 7 = 0 AND grey > 60")
    boxed = cloud.crop_box(points, corners, -5.0)
    centres = b.table(spark, sf, "nation").selectExpr("n_name AS object", "n_nationkey * 2.0 AS ox", "n_nationkey * 4.0 AS oy") \
        .withColumns({"ox": F.col("ox").cast("double"), "oy": F.col("oy").cast("double")})
    objects = cloud.crop_objects(boxed, centres, 6.0)
    return objects.groupBy("object").agg(F.count("*").alias("points"), quantise(F.avg("z")).alias("mean_z"))


def d19(spark, sf):
    return cloud.thin_manifest(b.points(spark, sf), 1.5, "method", low=0.10, high=0.895, margin=1.0)


def d20(spark, sf):
    cells = cloud.image_cell_coverage(b.detections(spark, sf), (1600, 1200), 100)
    return quantised(cloud.coverage_shares(cells, times=100), "reached", "reached_often")


def d20_cells(spark, sf):
    return cloud.image_cell_coverage(b.detections(spark, sf), (1600, 1200), 100)


def d21(spark, sf):
    return quantised(cloud.slab_profile(b.points(spark, sf), "y", "x", (50.0, 25.0), 3.0, 5, ["method"]), "z")


def d21_section(spark, sf):
    return quantised(cloud.surface_section(b.points(spark, sf), "y", "x", (50.0, 25.0), 0.5, 0.5), "s", "z")


QUERIES = {
    "d1_voxel_mean": d1, "d2_voxel_vote": d2, "d3_view_fanout": d3, "d4_depth_raster": d4,
    "d4_oblique_raster": d4_oblique, "d6_reconcile_frames": d6, "d7_frame_cells": d7, "d8_median_fuse": d8,
    "d9_grid_triangles": d9, "d10_height_field": d10, "d11_weighted_merge": d11, "d12_nearest_merge": d12,
    "d13_merge_coverage": d13, "d14_board_noise": d14, "d15_top_surface": d15, "d16_region_coverage": d16,
    "d17_camera_side": d17, "d18_crops": d18, "d19_clip_and_thin": d19, "d20_image_coverage": d20,
    "d20_image_cells": d20_cells, "d21_slab_profile": d21, "d21_surface_section": d21_section,
    "flagship_cropped_vote": voted,
}

VOXEL = "floor(x / {v})::BIGINT AS vx, floor(y / {v})::BIGINT AS vy, floor(z / {v})::BIGINT AS vz"


def _vote(source, v, views, body="SELECT * FROM voted"):
    return f""", cells AS (
  SELECT {VOXEL.format(v=v)}, frame, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(grey) AS sg, count(*) AS n
  FROM {source} GROUP BY ALL),
voted AS (
  SELECT vx, vy, vz, {q('sum(sx) / sum(n)')} AS x, {q('sum(sy) / sum(n)')} AS y, {q('sum(sz) / sum(n)')} AS z,
         {q('sum(sg) / sum(n)')} AS grey, count(*) AS views
  FROM cells GROUP BY vx, vy, vz HAVING count(*) >= {views})
{body}"""


_ORIGIN = "origin AS (SELECT floor(min(x)) AS x0, floor(min(y)) AS y0 FROM points)"


def _cells(size, keys, body):
    ij = f"floor((x - x0) / {size})::BIGINT AS i, floor((y - y0) / {size})::BIGINT AS j"
    return f""", {_ORIGIN}, celled AS (SELECT p.*, x0, y0, {ij} FROM points p, origin),
cells AS (SELECT {keys}, i, j, list_sort(list(z))[count(*) // 2 + 1] AS h, avg(grey) AS g, any_value(x0) AS x0,
          any_value(y0) AS y0 FROM celled GROUP BY {keys}, i, j)
{body}"""


_FUSED = """, fused AS (
  SELECT i, j, any_value(x0) + (i + 0.5) * {size} AS x, any_value(y0) + (j + 0.5) * {size} AS y, count(*) AS frames,
         list_sort(list(h))[count(*) // 2 + 1] AS z, avg(g) AS grey,
         list_sort(list(h))[count(*) * 9 // 10 + 1] - list_sort(list(h))[count(*) // 10 + 1] AS spread
  FROM cells GROUP BY i, j HAVING count(*) >= {k})
"""
_SIGMA = "sigmas AS (SELECT scan, CASE scan WHEN 'A' THEN 0.9e0 WHEN 'N' THEN 0.5e0 ELSE 1.4e0 END AS sigma FROM (SELECT DISTINCT scan FROM points))"
_MERGED = f""", {_SIGMA}, weighed AS (
  SELECT i, j, scan, h, 1 / (sigma * sigma) AS w, sum(1 / (sigma * sigma)) OVER (PARTITION BY i, j ORDER BY h, scan
         ROWS UNBOUNDED PRECEDING) AS cum, sum(1 / (sigma * sigma)) OVER (PARTITION BY i, j) AS total
  FROM cells JOIN sigmas USING (scan)),
centred AS (SELECT *, min(CASE WHEN cum >= total / 2 THEN h END) OVER (PARTITION BY i, j) AS centre FROM weighed),
merged AS (SELECT i, j, sum(w * h) FILTER (WHERE abs(h - centre) <= 3) / sum(w) FILTER (WHERE abs(h - centre) <= 3) AS h,
           count(*) FILTER (WHERE abs(h - centre) <= 3) AS used, any_value(centre) AS centre FROM centred GROUP BY i, j)
"""

_RIGHT, _UP, _FORWARD = cloud.view_axes(30.0, 40.0)

ORACLES = {
    "d1_voxel_mean": sql("points", body=f"""SELECT scan, {VOXEL.format(v='2.0e0')}, {q('avg(x)')} AS x, {q('avg(y)')} AS y,
        {q('avg(z)')} AS z, {q('avg(grey)')} AS grey, count(*) AS n FROM points GROUP BY scan, vx, vy, vz"""),
    "d2_voxel_vote": sql("points", body=_vote("points", "1.0e0", 2)),
    "d3_view_fanout": sql("points", body=_vote("points", "2.0e0", 1, """
        SELECT k, count(*) AS points, sum(views)::BIGINT AS views
        FROM voted, (SELECT unnest([2::BIGINT, 3, 5]) AS k) WHERE views >= k GROUP BY k""")),
    "d4_depth_raster": sql("points", body=""", near AS (SELECT frame, quantile_cont(z, 0.02) / 0.25e0 AS focal FROM points
        WHERE z > 0 GROUP BY frame),
        placed AS (SELECT frame, x, y, z, grey, focal * x / z AS u, focal * y / z AS v FROM points JOIN near USING (frame)
                   WHERE z > 0),
        corner AS (SELECT frame, floor(min(u)) AS u0, floor(min(v)) AS v0 FROM placed GROUP BY frame),
        pixels AS (SELECT frame, floor(v + 0.5e0 - v0)::BIGINT AS row_, floor(u + 0.5e0 - u0)::BIGINT AS col_,
                   {'z': z, 'x': x, 'y': y, 'grey': grey} AS p FROM placed JOIN corner USING (frame))
        SELECT frame, row_, col_, min(p).z AS depth, min(p).grey AS grey FROM pixels GROUP BY frame, row_, col_"""),
    "d4_oblique_raster": sql("points", body=f""", seen AS (SELECT method, x * {_RIGHT[0]!r} + y * {_RIGHT[1]!r} + z * {_RIGHT[2]!r} AS u,
        x * {_UP[0]!r} + y * {_UP[1]!r} + z * {_UP[2]!r} AS v, x * {_FORWARD[0]!r} + y * {_FORWARD[1]!r} + z * {_FORWARD[2]!r} AS depth
        FROM points), extent AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM seen),
        drawn AS (SELECT method, floor((v1 - v) / 1e0)::BIGINT + dr AS row_, floor((u - u0) / 1e0)::BIGINT + dc AS col_, depth,
          ceil((v1 - v0) / 1e0) AS h, ceil((u1 - u0) / 1e0) AS w FROM seen, extent, (SELECT unnest([-1, 0, 1]) AS dr),
          (SELECT unnest([-1, 0, 1]) AS dc))
        SELECT method, row_, col_, {q('min(depth)')} AS depth FROM drawn WHERE row_ BETWEEN 0 AND h AND col_ BETWEEN 0 AND w
        GROUP BY method, row_, col_"""),
    "d6_reconcile_frames": sql("points", "poses", body="""SELECT CASE WHEN p.frame IS NULL THEN 'no_pose'
        WHEN d.frame IS NULL THEN 'no_depth' ELSE 'used' END AS status, count(*) AS frames
        FROM supplier s LEFT JOIN (SELECT DISTINCT frame FROM poses WHERE lost = 0) p ON p.frame = s.s_suppkey
        LEFT JOIN (SELECT DISTINCT frame FROM points WHERE z > 9) d ON d.frame = s.s_suppkey GROUP BY 1"""),
    "d7_frame_cells": sql("points", body=_cells("4.0e0", "frame", f"SELECT frame, i, j, {q('h')} AS z, {q('g')} AS grey FROM cells")),
    "d8_median_fuse": sql("points", body=_cells("2.0e0", "frame", _FUSED.format(size="2.0e0", k=5) + f"""
        SELECT i, j, {q('x')} AS x, {q('y')} AS y, {q('z')} AS z, {q('spread')} AS spread, {q('grey')} AS grey, frames
        FROM fused WHERE spread <= 8""")),
    "d9_grid_triangles": sql("points", body=_cells("2.0e0", "frame", _FUSED.format(size="2.0e0", k=1) + f""",
        blocks AS (SELECT a.i, a.j, a.z AS a, b.z AS b, c.z AS c, d.z AS d FROM fused a
          JOIN fused d ON d.i = a.i + 1 AND d.j = a.j + 1
          LEFT JOIN fused b ON b.i = a.i + 1 AND b.j = a.j LEFT JOIN fused c ON c.i = a.i AND c.j = a.j + 1),
        halves AS (SELECT i, j, 0::BIGINT AS half, a AS z1, b AS z2, d AS z3 FROM blocks WHERE b IS NOT NULL
          UNION ALL SELECT i, j, 1::BIGINT, a, d, c FROM blocks WHERE c IS NOT NULL)
        SELECT i, j, half, {q('z1')} AS z1, {q('z2')} AS z2, {q('z3')} AS z3 FROM halves
        WHERE greatest(z1, z2, z3) - least(z1, z2, z3) <= 4""")),
    "d10_height_field": sql("points", body=_cells("1.0e0", "scan", f"SELECT scan, i, j, {q('h')} AS h FROM cells")),
    "d11_weighted_merge": sql("points", body=_cells("1.0e0", "scan", _MERGED + f"""
        SELECT i, j, {q('h')} AS h, used, {q('centre')} AS centre FROM merged""")),
    "d12_nearest_merge": sql("points", body=_cells("1.0e0", "scan", f""", {_SIGMA}, ranked AS (SELECT i, j, h, scan,
        row_number() OVER (PARTITION BY i, j ORDER BY sigma, scan) AS rn FROM cells JOIN sigmas USING (scan))
        SELECT i, j, {q('h')} AS h, scan FROM ranked WHERE rn = 1""")),
    "d13_merge_coverage": sql("points", body=_cells("1.0e0", "scan", _MERGED + f"""
        SELECT scan, count(*) AS cells, NULL::DOUBLE AS mean_scans FROM cells GROUP BY scan
        UNION ALL SELECT 'merged', count(*), {q('avg(used)')} FROM merged WHERE used > 0""")),
    "d14_board_noise": sql("points", body=f""", board AS (SELECT scan, pi, pj, x - (pi + 0.5e0) * 20 AS x,
        y - (pj + 0.5e0) * 20 AS y, z FROM (SELECT *, floor(x / 20)::BIGINT AS pi, floor(y / 20)::BIGINT AS pj FROM points
        WHERE abs(z) < 4)),
        s AS (SELECT scan, pi, pj, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx,
              sum(x*y) AS sxy, sum(y*y) AS syy, sum(x*z) AS sxz, sum(y*z) AS syz FROM board GROUP BY ALL HAVING count(*) >= 50),
        dt AS (SELECT *, sxx*(syy*n - sy*sy) - sxy*(sxy*n - sy*sx) + sx*(sxy*sy - syy*sx) AS det FROM s),
        plane AS (SELECT scan, pi, pj,
          (sxz*(syy*n - sy*sy) - sxy*(syz*n - sy*sz) + sx*(syz*sy - syy*sz)) / det AS a,
          (sxx*(syz*n - sy*sz) - sxz*(sxy*n - sy*sx) + sx*(sxy*sz - syz*sx)) / det AS b,
          (sxx*(syy*sz - syz*sy) - sxy*(sxy*sz - syz*sx) + sxz*(sxy*sy - syy*sx)) / det AS c FROM dt),
        r AS (SELECT scan, z - (a*x + b*y + c) AS r FROM board JOIN plane USING (scan, pi, pj)),
        m AS (SELECT scan, quantile_cont(r, 0.5) AS m FROM r GROUP BY scan)
        SELECT scan, {q('1.4826e0 * quantile_cont(abs(r - m), 0.5)')} AS sigma FROM r JOIN m USING (scan) GROUP BY scan"""),
    "d15_top_surface": sql("points", body=f"""SELECT method, j, i, {q('max(z)')} AS z FROM (SELECT method, z,
        floor((x - 10e0) / 2)::BIGINT AS i, floor((80e0 - y) / 2)::BIGINT AS j FROM points)
        WHERE i BETWEEN 0 AND 14 AND j BETWEEN 0 AND 29 GROUP BY method, j, i"""),
    "d16_region_coverage": sql("points", body=f""", inside AS (SELECT method, floor((x - 10e0) / 2) AS i,
        floor((80e0 - y) / 2) AS j FROM points WHERE x >= 10 AND x < 40 AND y >= 20 AND y < 80),
        s AS (SELECT method, count(*) AS points, count(DISTINCT (i, j)) FILTER (WHERE j BETWEEN 0 AND 29) AS filled
              FROM inside GROUP BY method)
        SELECT m.method, s.points, s.filled AS cells_filled, CASE WHEN s.method IS NOT NULL THEN 450 END::BIGINT AS cells_total,
        {q('s.filled / 450e0')} AS coverage
        FROM (SELECT DISTINCT method FROM points UNION ALL SELECT 'none') m LEFT JOIN s USING (method)"""),
    "d17_camera_side": sql("points", "poses", body=f""", side AS (SELECT CASE WHEN quantile_cont(tz - 4, 0.5) >= 0 THEN 1
        ELSE -1 END AS side FROM poses) SELECT method, {q('min(z * side)')} AS low, {q('max(z * side)')} AS high,
        count(*) AS n FROM points, side GROUP BY method"""),
    "d18_crops": sql("points", body=f""", box AS (SELECT min(x) + 5 AS x0, max(x) - 5 AS x1, min(y) + 5 AS y0,
        max(y) - 5 AS y1, min(z) + 5 AS z0, max(z) - 5 AS z1 FROM points WHERE frame % 7 = 0 AND grey > 60),
        boxed AS (SELECT p.* FROM points p, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)
        SELECT n_name AS object, count(*) AS points, {q('avg(z)')} AS mean_z FROM boxed, nation
        WHERE abs(x - n_nationkey * 2) < 6 AND abs(y - n_nationkey * 4) < 6 GROUP BY n_name"""),
    "d19_clip_and_thin": sql("points", body=f""", band AS (SELECT quantile_cont(z, 0.10) - 1 AS lo,
        quantile_cont(z, 0.895) + 1 AS hi FROM points)
        SELECT method, count(*) AS points FROM (SELECT DISTINCT method, {VOXEL.format(v='1.5e0')} FROM points, band
        WHERE z BETWEEN lo AND hi) GROUP BY method"""),
    "d20_image_cells": sql("detections", body=""", hit AS (SELECT camera, least(greatest(floor(u / 100), 0), 15)::BIGINT AS cx,
        least(greatest(floor(v / 100), 0), 11)::BIGINT AS cy, count(DISTINCT image) AS images FROM detections GROUP BY ALL)
        , grid AS (SELECT camera, cx, cy FROM (SELECT DISTINCT camera FROM detections),
        (SELECT unnest(range(16)) AS cx), (SELECT unnest(range(12)) AS cy))
        SELECT camera, cx, cy, coalesce(images, 0) AS images FROM grid LEFT JOIN hit USING (camera, cx, cy)"""),
    "d20_image_coverage": sql("detections", body=f""", hit AS (SELECT camera, least(greatest(floor(u / 100), 0), 15) AS cx,
        least(greatest(floor(v / 100), 0), 11) AS cy, count(DISTINCT image) AS images FROM detections GROUP BY ALL)
        SELECT camera, {q('count(*) / 192e0')} AS reached, {q('count(*) FILTER (WHERE images >= 100) / 192e0')} AS reached_often
        FROM hit GROUP BY camera"""),
    "d21_slab_profile": sql("points", body=f"""SELECT method, floor(y - 50)::BIGINT AS bin,
        CASE WHEN count(*) >= 5 THEN {q('quantile_cont(z, 0.5)')} END AS z, count(*) AS n FROM points WHERE abs(x - 25) < 3
        GROUP BY method, floor(y - 50)"""),
    "d21_surface_section": sql("points", body=f"""SELECT bin, {q('bin * 0.5e0')} AS s, {q('max(z)')} AS z FROM
        (SELECT round_even((y - 50) / 0.5e0, 0)::BIGINT AS bin, z FROM points WHERE abs(x - 25) < 0.5) GROUP BY bin"""),
    "flagship_cropped_vote": sql("points", body=""", inside AS (SELECT * FROM points WHERE x >= 5 AND x < 45 AND y >= 10
        AND y < 90)""" + _vote("inside", "2.0e0", 3)),
}
