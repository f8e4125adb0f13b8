"""Point-cloud aggregation and fusion.

Points are rows (x, y, z, grey, plus keys such as scan, method, frame) in mm. Cells are half-open. A cell, voxel or
frame may hold a large share of all points: sums and counts combine on the map side, order statistics go through
functions.quantiles, and nothing collects a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.columns import cell, col, total
from stratacloud.functions.groups import computed, with_group
from stratacloud.functions.matrices import solve_normal
from stratacloud.functions.quantiles import cell_quantiles, exact_quantiles

AXES = ("x", "y", "z")


def _voxel_keys(voxel: float) -> list[Column]:
    return [cell(a, voxel).alias(f"v{a}") for a in AXES]


def voxel_mean(points: DataFrame, voxel: float, keys: list[str] | None = None) -> DataFrame:
    """One row per occupied voxel and key: mean position, mean grey, point count."""
    keys = keys or []
    return (points.select(*keys, *AXES, "grey", *_voxel_keys(voxel))
            .groupBy(*keys, "vx", "vy", "vz")
            .agg(*[F.avg(a).alias(a) for a in AXES], F.avg("grey").alias("grey"), F.count("*").alias("n")))


def frame_voxel_sums(points: DataFrame, voxel: float, frame: str = "frame", keys: list[str] | None = None) -> DataFrame:
    """Sums per frame and voxel: the unit a frame contributes, however many of its points fall in the voxel."""
    keys = keys or []
    return (points.select(*keys, frame, *AXES, "grey", *_voxel_keys(voxel))
            .groupBy(*keys, "vx", "vy", "vz", frame)
            .agg(*[F.sum(a).alias(f"s{a}") for a in AXES], F.sum("grey").alias("sgrey"), F.count("*").alias("n")))


def voxel_vote(points: DataFrame, voxel: float, min_views: int = 3, frame: str = "frame",
               keys: list[str] | None = None) -> DataFrame:
    """Voxels seen by at least min_views frames: point-weighted mean position and grey, and the number of frames."""
    keys = keys or []
    cells = frame_voxel_sums(points, voxel, frame, keys).groupBy(*keys, "vx", "vy", "vz").agg(
        *[F.sum(f"s{a}").alias(f"s{a}") for a in AXES], F.sum("sgrey").alias("sgrey"), F.sum("n").alias("n"),
        F.count("*").alias("views"))
    return (cells.where(F.col("views") >= min_views)
            .select(*keys, "vx", "vy", "vz", *[(F.col(f"s{a}") / F.col("n")).alias(a) for a in AXES],
                    (F.col("sgrey") / F.col("n")).alias("grey"), "views"))


def view_fanout(cloud: DataFrame, thresholds: list[int]) -> DataFrame:
    """The cloud once per threshold k, keeping the points seen by at least k frames. Write partitioned by k."""
    return (cloud.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in thresholds])))
            .where(F.col("views") >= F.col("k")))


def depth_raster(points: DataFrame, pixel_mm: float, frame: str = "frame") -> DataFrame:
    """Perspective depth buffer per frame: the nearest point per pixel, pixels pixel_mm wide at the near depth.

    The near depth is the 2nd percentile of the frame's z. Pixel (0, 0) holds the frame's smallest u and v."""
    ahead = points.where(F.col("z") > 0)
    near = exact_quantiles(ahead, [frame], "z", {"near": ("linear", 0.02)})
    focal = F.col("near") / F.lit(float(pixel_mm))
    placed = ahead.join(near, frame).select(frame, *AXES, "grey", (focal * F.col("x") / F.col("z")).alias("u"),
                                            (focal * F.col("y") / F.col("z")).alias("v"))
    corner = placed.groupBy(frame).agg(F.floor(F.min("u")).alias("u0"), F.floor(F.min("v")).alias("v0"))
    pixels = placed.join(corner, frame).select(
        frame, F.floor(F.col("v") + 0.5 - F.col("v0")).alias("row_"), F.floor(F.col("u") + 0.5 - F.col("u0")).alias("col_"),
        F.struct("z", "x", "y", "grey").alias("p"))
    return (pixels.groupBy(frame, "row_", "col_").agg(F.min("p").alias("p"))
            .select(frame, "row_", "col_", F.col("p.z").alias("depth"), F.col("p.grey").alias("grey")))


def view_axes(azimuth: float, elevation: float) -> tuple:
    """Right, up and forward directions of an orthographic view (degrees)."""
    a, e = math.radians(azimuth), math.radians(elevation)
    forward = (-math.cos(e) * math.cos(a), -math.cos(e) * math.sin(a), -math.sin(e))
    length = math.hypot(forward[0], forward[1])
    right = (forward[1] / length, -forward[0] / length, 0.0)
    up = (right[1] * forward[2], -right[0] * forward[2], right[0] * forward[1] - right[1] * forward[0])
    return right, up, forward


def oblique_raster(points: DataFrame, azimuth: float, elevation: float, pixel_mm: float, splat: int = 0,
                   keys: list[str] | None = None) -> DataFrame:
    """Orthographic depth buffer seen from azimuth and elevation (degrees), each point painted as a square of
    2 * splat + 1 pixels; the nearest point wins a pixel. One extent for all keys, so their images line up."""
    keys = keys or []
    right, up, forward = view_axes(azimuth, elevation)

    def along(axis):
        return total([F.col(c) * F.lit(w) for c, w in zip(AXES, axis)])

    view = points.select(*keys, *AXES, "grey", along(right).alias("u"), along(up).alias("v"),
                         along(forward).alias("depth"))
    extent = view.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    steps = F.array(*[F.lit(k) for k in range(-splat, splat + 1)])
    size = F.lit(float(pixel_mm))
    placed = (view.crossJoin(F.broadcast(extent))
              .withColumn("row_", F.floor((F.col("v1") - F.col("v")) / size)).withColumn("col_", F.floor((F.col("u") - F.col("u0")) / size))
              .withColumns({"rows_": F.ceil((F.col("v1") - F.col("v0")) / size), "cols_": F.ceil((F.col("u1") - F.col("u0")) / size)}))
    # the nearest point of a pixel's own points paints the square for all of them
    nearest = placed.groupBy(*keys, "row_", "col_", "rows_", "cols_").agg(F.min(F.struct("depth", "grey", "x", "y", "z")).alias("p"))
    drawn = (nearest.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
             .withColumns({"row_": F.col("row_") + F.col("dr"), "col_": F.col("col_") + F.col("dc")})
             .where((F.col("row_") >= 0) & (F.col("col_") >= 0) & (F.col("row_") <= F.col("rows_")) & (F.col("col_") <= F.col("cols_"))))
    return (drawn.groupBy(*keys, "row_", "col_").agg(F.min("p").alias("p"))
            .select(*keys, "row_", "col_", F.col("p.depth").alias("depth"), F.col("p.grey").alias("grey")))


def reconcile_frames(frames: DataFrame, poses: DataFrame, depth: DataFrame, frame: str = "frame") -> DataFrame:
    """Every listed frame with its status: used, no_pose, or no_depth."""
    posed = poses.select(frame).distinct().withColumn("_pose", F.lit(True))
    deep = depth.select(frame).distinct().withColumn("_depth", F.lit(True))
    return (frames.select(frame).distinct().join(posed, frame, "left").join(deep, frame, "left")
            .select(frame, F.when(F.col("_pose").isNull(), "no_pose").when(F.col("_depth").isNull(), "no_depth")
                    .otherwise("used").alias("status")))


def grid_origin(points: DataFrame) -> DataFrame:
    """One row: the whole-mm corner the height grids start from."""
    return points.agg(F.floor(F.min("x")).cast("double").alias("x0"), F.floor(F.min("y")).cast("double").alias("y0"))


def with_cells(points: DataFrame, size: float) -> DataFrame:
    """Points with their grid cell (i, j) counted from grid_origin, and the origin."""
    return points.crossJoin(F.broadcast(grid_origin(points))).withColumns(
        {"i": cell("x", size, F.col("x0")), "j": cell("y", size, F.col("y0"))})


def frame_cells(points: DataFrame, size: float, frame: str = "frame") -> DataFrame:
    """Per frame and cell: the order-statistic median height z[n // 2] and the mean grey."""
    return cell_quantiles(with_cells(points, size), [frame, "i", "j"], "z", {"z": ("at", 1, 2)},
                          [F.avg("grey").alias("grey"), F.first("x0").alias("x0"), F.first("y0").alias("y0")])


def correct_frames(points: DataFrame, corrections: DataFrame, frame: str = "frame") -> DataFrame:
    """Points moved by their frame's 4x4 correction (row-major array T); frames without one stay as they are."""
    t = F.col("T")

    def moved(row):
        full = t[4 * row] * F.col("x") + t[4 * row + 1] * F.col("y") + t[4 * row + 2] * F.col("z") + t[4 * row + 3]
        return F.when(t.isNull(), F.col(AXES[row])).otherwise(full)

    return points.join(corrections.select(frame, "T"), frame, "left").withColumns(
        {a: moved(k) for k, a in enumerate(AXES)}).drop("T")


def median_fuse(points: DataFrame, size: float = 1.0, min_frames: int = 5, max_spread: float | None = None,
                frame: str = "frame", corrections: DataFrame | None = None) -> DataFrame:
    """Height field over frames: median height, spread between the 1/10 and 9/10 order statistics, mean grey."""
    if corrections is not None:
        points = correct_frames(points, corrections, frame)
    per_frame = frame_cells(points, size, frame)
    fused = cell_quantiles(per_frame, ["i", "j"], "z",
                           {"median": ("at", 1, 2), "high": ("at", 9, 10), "low": ("at", 1, 10)},
                           [F.count("*").alias("frames"), F.avg("grey").alias("grey"), F.first("x0").alias("x0"),
                            F.first("y0").alias("y0")])
    fused = fused.where(F.col("frames") >= min_frames).withColumn("spread", F.col("high") - F.col("low"))
    if max_spread is not None:
        fused = fused.where(F.col("spread") <= max_spread)
    return fused.select("i", "j", (F.col("x0") + (F.col("i") + 0.5) * size).alias("x"),
                        (F.col("y0") + (F.col("j") + 0.5) * size).alias("y"), F.col("median").alias("z"),
                        "spread", "grey", "frames")


def grid_triangles(cells: DataFrame, max_step: float = 4.0) -> DataFrame:
    """Two triangles per 2x2 block of filled cells (i, j, z), each unless its heights span more than max_step.

    Every cell is sent to the four blocks it is a corner of, so one grouping finds all blocks."""
    corners = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(k).alias("corner"))
                        for k, (di, dj) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))])
    spread = (cells.select("i", "j", "z", F.explode(corners).alias("c"))
              .select((F.col("i") - F.col("c.di")).alias("i"), (F.col("j") - F.col("c.dj")).alias("j"),
                      F.col("c.corner").alias("corner"), "z"))
    blocks = spread.groupBy("i", "j").agg(
        *[F.max(F.when(F.col("corner") == k, F.col("z"))).alias(n) for k, n in enumerate("abcd")])
    halves = blocks.select("i", "j", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("a").alias("z1"), F.col("b").alias("z2"), F.col("d").alias("z3")),
        F.struct(F.lit(1).alias("half"), F.col("a").alias("z1"), F.col("d").alias("z2"), F.col("c").alias("z3"))
    )).alias("t")).select("i", "j", "t.*")
    full = F.col("z1").isNotNull() & F.col("z2").isNotNull() & F.col("z3").isNotNull()
    step = F.greatest("z1", "z2", "z3") - F.least("z1", "z2", "z3")
    return halves.where(full & (step <= max_step))


def height_field(points: DataFrame, size: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Per key (a scan) and cell, the order-statistic median height."""
    keys = ["scan"] if keys is None else keys
    return cell_quantiles(with_cells(points, size), [*keys, "i", "j"], "z", {"h": ("at", 1, 2)})


def weighted_merge(fields: DataFrame, sigmas: DataFrame, reject: float = 3.0) -> DataFrame:
    """Merge one height per scan and cell: weights 1/sigma^2; the weighted median is the first height at which the
    running weight reaches half; heights further than reject from it are dropped; weighted mean of the rest, and the
    number of scans used. A cell holds one row per scan."""
    by_cell = Window.partitionBy("i", "j")
    ranked = by_cell.orderBy("h", "scan").rowsBetween(Window.unboundedPreceding, 0)
    weighed = (fields.join(sigmas, "scan")
               .withColumn("w", 1.0 / (F.col("sigma") * F.col("sigma")))
               .withColumn("cum", F.sum("w").over(ranked))
               .withColumn("total", F.sum("w").over(by_cell.rowsBetween(Window.unboundedPreceding,
                                                                        Window.unboundedFollowing)))
               .withColumn("centre", F.min(F.when(F.col("cum") >= F.col("total") / 2, F.col("h"))).over(by_cell)))
    near = F.abs(F.col("h") - F.col("centre")) <= reject
    return weighed.groupBy("i", "j").agg(
        (F.sum(F.when(near, F.col("w") * F.col("h"))) / F.sum(F.when(near, F.col("w")))).alias("h"),
        F.count(F.when(near, 1)).alias("used"), F.first("centre").alias("centre"))


def nearest_merge(fields: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Per cell, the height of the lowest-noise scan that has the cell."""
    return (fields.join(sigmas, "scan")
            .groupBy("i", "j").agg(F.min(F.struct("sigma", "scan", "h")).alias("best"))
            .select("i", "j", F.col("best.h").alias("h"), F.col("best.scan").alias("scan")))


def concat_clouds(clouds: dict[str, DataFrame]) -> DataFrame:
    """Aligned clouds under each other with a scan column."""
    parts = [cloud.withColumn("scan", F.lit(scan)) for scan, cloud in clouds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_coverage(fields: DataFrame, merged: DataFrame) -> DataFrame:
    """Cells per scan, and for the merged field its cells and the mean number of scans behind a cell."""
    per_scan = fields.groupBy("scan").agg(F.count("*").alias("cells")).withColumn("mean_scans", F.lit(None).cast("double"))
    whole = merged.where(F.col("used") > 0).agg(F.count("*").alias("cells"), F.avg("used").alias("mean_scans"))
    return per_scan.unionByName(whole.select(F.lit("merged").alias("scan"), "cells", "mean_scans"))


def board_noise(points: DataFrame, keys: list[str] | None = None, band: float = 4.0, patch: float = 20.0,
                min_points: int = 50) -> DataFrame:
    """Robust spread of bare-board points (|z| < band) about least-squares planes of patch-sized squares holding at
    least min_points: 1.4826 x the median absolute deviation of all residuals, per key."""
    keys = ["scan"] if keys is None else keys
    x = F.col("x") - (F.col("pi") + 0.5) * patch
    y = F.col("y") - (F.col("pj") + 0.5) * patch
    board = (points.where(F.abs("z") < band).withColumns({"pi": cell("x", patch), "pj": cell("y", patch)})
             .withColumns({"cx": x, "cy": y}).select(*keys, "pi", "pj", "cx", "cy", "z"))
    cx, cy, z = F.col("cx"), F.col("cy"), F.col("z")
    sums = board.groupBy(*keys, "pi", "pj").agg(
        F.count("*").cast("double").alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"), F.sum(z).alias("sz"),
        F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy"), F.sum(cy * cy).alias("syy"),
        F.sum(cx * z).alias("sxz"), F.sum(cy * z).alias("syz")).where(F.col("n") >= min_points)
    planes = sums.select(*keys, "pi", "pj", solve_normal(
        F.array("sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "n"), F.array("sxz", "syz", "sz")).alias("plane"))
    residuals = with_group(board, planes, [*keys, "pi", "pj"]).select(
        *keys, (z - (F.col("plane")[0] * cx + F.col("plane")[1] * cy + F.col("plane")[2])).alias("r"))
    middle = exact_quantiles(residuals, keys, "r", {"m": ("linear", 0.5)})
    centred = with_group(residuals, middle, keys)
    mad = exact_quantiles(centred, keys, F.abs(F.col("r") - F.col("m")), {"mad": ("linear", 0.5)})
    return mad.select(*keys, (F.lit(1.4826) * F.col("mad")).alias("sigma"))


def top_surface(points: DataFrame, x_range: tuple, y_range: tuple, size: float, keys: list[str] | None = None) -> DataFrame:
    """Per cell of the region the highest z (nearest the camera); rows run from the top of y downwards."""
    keys = keys or []
    nx, ny = (math.ceil((r[1] - r[0]) / size) for r in (x_range, y_range))
    placed = points.select(*keys, F.floor((F.lit(float(y_range[1])) - F.col("y")) / size).alias("j"),
                           F.floor((F.col("x") - float(x_range[0])) / size).alias("i"), "z")
    inside = F.col("i").between(0, nx - 1) & F.col("j").between(0, ny - 1)
    return placed.where(inside).groupBy(*keys, "j", "i").agg(F.max("z").alias("z"))


def in_region(points: DataFrame, region: tuple) -> DataFrame:
    """Half-open crop [x0, x1) x [y0, y1)."""
    x0, x1, y0, y1 = (float(v) for v in region)
    return points.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def region_coverage(points: DataFrame, methods: DataFrame, region: tuple, size: float) -> DataFrame:
    """Per listed method: points in the region, cells filled, and their share of all cells. Methods without a cloud
    keep a blank row."""
    x0, x1, y0, y1 = region
    cells_total = math.ceil((x1 - x0) / size) * math.ceil((y1 - y0) / size)
    have = points.select("method").distinct().withColumn("_have", F.lit(True))
    filled = (in_region(points, region)
              .select("method", F.floor((F.col("x") - x0) / size).alias("i"),
                      F.floor((F.lit(float(y1)) - F.col("y")) / size).alias("j"))
              .groupBy("method", "i", "j").agg(F.count("*").alias("n"))
              # the last row of y is the closed edge of the reversed axis
              .groupBy("method").agg(F.sum("n").alias("points"),
                                     F.count(F.when(F.col("j").between(0, math.ceil((y1 - y0) / size) - 1), 1)).alias("filled")))
    out = methods.select("method").join(have, "method", "left").join(filled, "method", "left")
    seen = F.col("_have").isNotNull()
    return out.select(
        "method", F.when(seen, F.coalesce("points", F.lit(0))).cast("long").alias("points"),
        F.when(seen, F.coalesce("filled", F.lit(0))).cast("long").alias("cells_filled"),
        F.when(seen, F.lit(cells_total)).cast("long").alias("cells_total"),
        F.when(seen, F.coalesce("filled", F.lit(0)) / F.lit(cells_total)).alias("coverage"))


def camera_side(centres: DataFrame) -> DataFrame:
    """One row: +1 where the median camera-centre height is not negative, else -1."""
    return exact_quantiles(centres, [], "z", {"m": ("linear", 0.5)}).select(
        F.when(F.col("m") >= 0, 1.0).otherwise(-1.0).alias("side"))


def towards_camera(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Clouds with z flipped, if need be, to height towards the camera."""
    return (points.crossJoin(F.broadcast(camera_side(centres)))
            .withColumn("z", F.col("z") * F.col("side")).drop("side"))


def crop_box(points: DataFrame, corners: DataFrame, margin: float) -> DataFrame:
    """Points inside the closed box around the tag corners, widened by margin."""
    bounds = corners.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo_", F.min), ("hi_", F.max))])
    inside = [(F.col(a) >= F.col(f"lo_{a}") - margin) & (F.col(a) <= F.col(f"hi_{a}") + margin) for a in AXES]
    return (points.crossJoin(F.broadcast(bounds)).where(inside[0] & inside[1] & inside[2])
            .drop(*[f"{n}{a}" for a in AXES for n in ("lo_", "hi_")]))


def crop_objects(points: DataFrame, centres: DataFrame, half: float) -> DataFrame:
    """The points strictly inside a square around each object centre (object, ox, oy); one point may join several.

    Centres are matched through the grid of squares, so neither side is paired with all of the other."""
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spots = (centres.withColumn("_di", F.explode(near)).withColumn("_dj", F.explode(near))
             .withColumn("gi", cell("ox", half) + F.col("_di")).withColumn("gj", cell("oy", half) + F.col("_dj"))
             .drop("_di", "_dj"))
    placed = points.withColumns({"gi": cell("x", half), "gj": cell("y", half)})
    strict = (F.abs(F.col("x") - F.col("ox")) < half) & (F.abs(F.col("y") - F.col("oy")) < half)
    return placed.join(spots, ["gi", "gj"]).where(strict).drop("gi", "gj")


def robust_clip(points: DataFrame, low: float = 0.10, high: float = 0.995, margin: float = 10.0,
                keys: list[str] | None = None) -> DataFrame:
    """Points whose z lies in the pooled percentile band, widened by margin (per key, or over all)."""
    keys = keys or []
    band = exact_quantiles(points, keys, "z", {"_lo": ("linear", low), "_hi": ("linear", high)})
    joined = points.join(band, keys) if keys else points.crossJoin(F.broadcast(band))
    return joined.where(F.col("z").between(F.col("_lo") - margin, F.col("_hi") + margin)).drop("_lo", "_hi")


def thin_manifest(points: DataFrame, voxel: float = 1.5, key: str = "method", **band) -> DataFrame:
    """Clip pooled over methods, thin by voxel, and count what is left per method."""
    return voxel_mean(robust_clip(points, **band), voxel, [key]).groupBy(key).agg(F.count("*").alias("points"))


def image_cell_coverage(corners: DataFrame, size: tuple, cell_px: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Per key and image cell, the number of images with a corner in it (zero rows included)."""
    keys = ["camera"] if keys is None else keys
    nx, ny = -(-size[0] // cell_px), -(-size[1] // cell_px)

    def clipped(c, n):
        return F.greatest(F.lit(0), F.least(F.floor(col(c) / cell_px), F.lit(n - 1))).cast("long")

    hits = (corners.select(*keys, "image", clipped("u", nx).alias("cx"), clipped("v", ny).alias("cy")).distinct()
            .groupBy(*keys, "cx", "cy").agg(F.count("*").alias("images")))
    grid = (corners.select(*keys).distinct()
            .withColumn("cx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))))
            .withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long")))))
    return grid.join(hits, [*keys, "cx", "cy"], "left").withColumn("images", F.coalesce("images", F.lit(0).cast("long")))


def coverage_shares(cells: DataFrame, keys: list[str] | None = None, times: int = 3) -> DataFrame:
    """Share of image cells reached at all, and by at least `times` images."""
    keys = ["camera"] if keys is None else keys
    return cells.groupBy(*keys).agg(F.avg((F.col("images") > 0).cast("double")).alias("reached"),
                                    F.avg((F.col("images") >= times).cast("double")).alias("reached_often"))


def slab_profile(points: DataFrame, axis: str, other: str, apex: tuple, half: float = 3.0, min_points: int = 5,
                 keys: list[str] | None = None) -> DataFrame:
    """Median height per 1 mm bin along axis of the points within half of the apex across it; null below min_points."""
    keys = keys or []
    slab = points.where(F.abs(F.col(other) - float(apex[1])) < half).select(
        *keys, F.floor(F.col(axis) - float(apex[0])).alias("bin"), "z")
    stats = cell_quantiles(slab, [*keys, "bin"], "z", {"median": ("linear", 0.5)}, [F.count("*").alias("n")])
    return stats.select(*keys, "bin", F.when(F.col("n") >= min_points, F.col("median")).alias("z"), "n")


def surface_section(samples: DataFrame, axis: str, other: str, apex: tuple, half: float = 0.5, step: float = 0.5) -> DataFrame:
    """The top of a surface sample per half-even bin of `step` along axis: the model's own cross-section."""
    return (samples.where(F.abs(F.col(other) - float(apex[1])) < half)
            .select(F.bround((F.col(axis) - float(apex[0])) / step).cast("long").alias("bin"), "z")
            .groupBy("bin").agg(F.max("z").alias("z"))
            .select("bin", (F.col("bin") * F.lit(step)).alias("s"), "z"))


# ---- truncated signed distance fusion ---------------------------------------------------------------------------------

def frame_intrinsics(points: DataFrame, pixel_mm: float, frame: str = "frame") -> DataFrame:
    """Per frame the focal length and image corner depth_raster uses: focal, u0, v0."""
    ahead = points.where(F.col("z") > 0)
    near = exact_quantiles(ahead, [frame], "z", {"near": ("linear", 0.02)}).select(frame, (F.col("near") / float(pixel_mm)).alias("focal"))
    u, v = F.col("focal") * F.col("x") / F.col("z"), F.col("focal") * F.col("y") / F.col("z")
    return ahead.join(near, frame).groupBy(frame, "focal").agg(F.floor(F.min(u)).alias("u0"), F.floor(F.min(v)).alias("v0"))


def _pixel(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    u, v = F.col("focal") * x / z, F.col("focal") * y / z
    return F.floor(v + 0.5 - F.col("v0")).cast("long"), F.floor(u + 0.5 - F.col("u0")).cast("long")


def tsdf_voxels(points: DataFrame, poses: DataFrame, voxel: float = 1.0, trunc: float = 4.0, pixel_mm: float = 1.0,
                min_weight: int = 3) -> DataFrame:
    """Truncated signed distance volume of depth frames (frame, x, y, z, grey in camera coordinates) under poses (frame,
    T = camera to world): voxels (vx, vy, vz) with the mean truncated distance d (positive in front of the surface), mean
    grey and weight = frames that saw the voxel.

    A frame only touches voxels along the viewing rays of its own depth pixels, within trunc of the surface. These are
    made distinct per frame before each looks up its pixel's depth by equality on (frame, row, column)."""
    from stratacloud.functions.geometry import apply_pose, inverse

    intrinsics = frame_intrinsics(points, pixel_mm)
    raster = depth_raster(points, pixel_mm).select("frame", F.col("row_").cast("long").alias("row_"), F.col("col_").cast("long").alias("col_"), "depth", "grey")
    # a pixel's ray has many times its bytes: the pixels are dealt over all tasks, not merged into few by their size, and
    # a frame's few numbers go to them
    raster = raster.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame", "row_", "col_")
    setup = computed(intrinsics.join(poses.select("frame", "T"), "frame"))
    steps = int(math.ceil(trunc / voxel))
    offsets = F.array(*[F.lit(k * float(voxel)) for k in range(-steps, steps + 1)])
    # the pixel's centre ray, sampled through the band around its depth
    ray = raster.join(setup, "frame").select("frame", "T", "focal", "u0", "v0", "row_", "col_", F.explode(offsets).alias("o"), "depth")
    depth = F.col("depth") + F.col("o")
    at = [(F.col("col_") + F.col("u0")) / F.col("focal") * depth, (F.col("row_") + F.col("v0")) / F.col("focal") * depth, depth]
    world = ray.where(depth > 0).select("frame", *[F.floor(c / float(voxel)).cast("long").alias(f"v{a}") for a, c in zip(AXES, apply_pose("T", at))])
    touched = world.distinct()
    centred = touched.join(setup.withColumn("I", inverse("T")), "frame")
    middle = [(F.col(f"v{a}") + 0.5) * float(voxel) for a in AXES]
    local = centred.select("frame", "vx", "vy", "vz", "focal", "u0", "v0", *[c.alias(a) for a, c in zip(AXES, apply_pose("I", middle))]).where(F.col("z") > 0)
    row, column = _pixel(F.col("x"), F.col("y"), F.col("z"))
    seen = local.select("frame", "vx", "vy", "vz", "z", row.alias("row_"), column.alias("col_")).join(raster, ["frame", "row_", "col_"])
    gap = F.col("depth") - F.col("z")
    return (seen.where(gap >= -trunc).groupBy("vx", "vy", "vz")
            .agg(F.avg(F.least(gap, F.lit(float(trunc)))).alias("d"), F.avg("grey").alias("grey"), F.count("*").alias("weight"))
            .where(F.col("weight") >= min_weight))


def tsdf_surface(voxels: DataFrame, voxel: float = 1.0) -> DataFrame:
    """Surface points where the distance changes sign between axis neighbours, placed by linear interpolation. Each voxel
    is sent to the three edges above and the three below it, so one grouping meets all neighbours."""
    ends = F.array(*[F.struct(F.lit(axis).alias("axis"), F.lit(high).alias("high"), *[F.lit(int(high and k == axis)).alias(f"s{k}") for k in range(3)])
                     for axis in range(3) for high in (False, True)])
    sent = voxels.withColumn("_e", F.explode(ends)).select(
        *[(F.col(f"v{a}") - F.col(f"_e.s{k}")).alias(f"v{a}") for k, a in enumerate(AXES)], F.col("_e.axis").alias("axis"), F.col("_e.high").alias("high"), "d", "grey")
    edges = sent.groupBy("vx", "vy", "vz", "axis").agg(
        F.max(F.when(~F.col("high"), F.col("d"))).alias("d0"), F.max(F.when(F.col("high"), F.col("d"))).alias("d1"), F.avg("grey").alias("grey"))
    cross = edges.where(((F.col("d0") > 0) & (F.col("d1") <= 0)) | ((F.col("d0") <= 0) & (F.col("d1") > 0)))
    share = F.col("d0") / (F.col("d0") - F.col("d1"))
    return cross.select(*[((F.col(f"v{a}") + 0.5 + F.when(F.col("axis") == k, share).otherwise(0.0)) * float(voxel)).alias(a) for k, a in enumerate(AXES)], "grey")
