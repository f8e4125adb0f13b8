"""Geometry over columns: poses are row-major array<double> of 16 entries, points are three columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.columns import clip_unit, col, norm, total
from stratacloud.session import cut_lineage


def dot(a, b) -> Column:
    return total([x * y for x, y in zip(a, b)])


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def entries(t: Column | str, n: int = 16) -> list[Column]:
    t = col(t)
    return [t[i] for i in range(n)]


def apply_pose(t: Column | str, point) -> list[Column]:
    """T applied to a point."""
    m = entries(t)
    return [m[4 * k] * point[0] + m[4 * k + 1] * point[1] + m[4 * k + 2] * point[2] + m[4 * k + 3] for k in range(3)]


def rotate(t: Column | str, vector) -> list[Column]:
    m = entries(t)
    return [m[4 * k] * vector[0] + m[4 * k + 1] * vector[1] + m[4 * k + 2] * vector[2] for k in range(3)]


def pose_array(rotation: list[Column], shift: list[Column]) -> Column:
    """4x4 pose from nine rotation entries and a translation."""
    rows = []
    for k in range(3):
        rows += [*rotation[3 * k:3 * k + 3], shift[k]]
    return F.array(*[c.cast("double") for c in rows], *[F.lit(float(v)) for v in (0, 0, 0, 1)])


def inverse(t: Column | str) -> Column:
    """Inverse of a rigid pose."""
    m = entries(t)
    rotation = [m[4 * c + r] for r in range(3) for c in range(3)]
    shift = [-(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11]) for r in range(3)]
    return pose_array(rotation, shift)


def compose(a: Column | str, b: Column | str) -> Column:
    """a after b."""
    m, n = entries(a), entries(b)
    rotation = [total([m[4 * r + k] * n[4 * k + c] for k in range(3)]) for r in range(3) for c in range(3)]
    shift = [total([m[4 * r + k] * n[4 * k + 3] for k in range(3)]) + m[4 * r + 3] for r in range(3)]
    return pose_array(rotation, shift)


def centre(t: Column | str) -> list[Column]:
    """Where the frame of T has its origin: -R^T t."""
    m = entries(t)
    return [-(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11]) for r in range(3)]


def turn_deg(t: Column | str) -> Column:
    """Rotation angle of a pose in degrees."""
    m = entries(t)
    return F.degrees(F.acos(clip_unit((m[0] + m[5] + m[10] - 1) / 2)))


def motion(t: Column | str) -> tuple[Column, Column]:
    """Size of a rigid motion: translation length and rotation in degrees."""
    m = entries(t)
    return norm(m[3], m[7], m[11]), turn_deg(t)


def quaternion_pose(q, shift) -> Column:
    """Pose from a quaternion (w, x, y, z), normalised here, and a translation."""
    size = norm(*[col(c) for c in q])
    w, x, y, z = (col(c) / size for c in q)
    rotation = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
                2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
                2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return pose_array(rotation, [col(s) for s in shift])


def pose_quaternion(t: Column | str) -> Column:
    """Quaternion array (w, x, y, z) of a pose, by the largest of its four squares, w not negative. The pose is bound
    once by a transform, so its own expression is not repeated."""

    def parts(m: Column) -> Column:
        r = {(i, j): m[4 * i + j] for i in range(3) for j in range(3)}
        squares = [1 + r[0, 0] + r[1, 1] + r[2, 2], 1 + r[0, 0] - r[1, 1] - r[2, 2],
                   1 - r[0, 0] + r[1, 1] - r[2, 2], 1 - r[0, 0] - r[1, 1] + r[2, 2]]
        products = {(0, 1): r[2, 1] - r[1, 2], (0, 2): r[0, 2] - r[2, 0], (0, 3): r[1, 0] - r[0, 1],
                    (1, 2): r[0, 1] + r[1, 0], (1, 3): r[0, 2] + r[2, 0], (2, 3): r[1, 2] + r[2, 1]}
        options = []
        for lead in range(4):
            root = F.sqrt(F.greatest(squares[lead], F.lit(0.0)))
            options.append(F.array(*[root / 2 if lead == k else products[min(lead, k), max(lead, k)] / (2 * root)
                                     for k in range(4)]))
        largest = F.greatest(*squares)
        return (F.when(squares[0] == largest, options[0]).when(squares[1] == largest, options[1])
                .when(squares[2] == largest, options[2]).otherwise(options[3]))

    raw = F.transform(F.array(col(t)), parts)
    return F.transform(raw, lambda q: F.transform(q, lambda v: F.when(q[0] < 0, -v).otherwise(v)))[0]


def project(point, k: tuple, d: tuple) -> tuple[Column, Column]:
    """Pixel of a camera-frame point; k = (fx, fy, cx, cy), d = (k1, k2, p1, p2, k3). Null at or behind the camera."""
    x, y, z = point
    return project_normalised(F.when(z > 0, x / z), F.when(z > 0, y / z), k, d)


def project_normalised(xn, yn, k: tuple, d: tuple) -> tuple:
    """Pixel of a normalised ray, for columns and arrays alike."""
    r2 = xn * xn + yn * yn
    radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
    xd = xn * radial + 2 * d[2] * xn * yn + d[3] * (r2 + 2 * xn * xn)
    yd = yn * radial + d[2] * (r2 + 2 * yn * yn) + 2 * d[3] * xn * yn
    return k[0] * xd + k[2], k[1] * yd + k[3]


def undistort(u: Column, v: Column, k: tuple, d: tuple, steps: int = 20) -> Column:
    """Normalised ray struct(x, y) of a pixel: the distortion removed by a fixed number of fixed-point steps, taken by a
    batch of pixels at once."""
    @F.arrow_udf("struct<x:double,y:double>")
    def rays(us: pa.Array, vs: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        missing = pc.or_(pc.is_null(us), pc.is_null(vs)).to_numpy(zero_copy_only=False)
        x0, y0 = ((c.to_numpy(zero_copy_only=False).astype(float) - k[2 + i]) / k[i] for i, c in enumerate((us, vs)))
        x, y = x0, y0
        with np.errstate(all="ignore"):
            for _ in range(steps):
                r2 = x * x + y * y
                radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
                dx = 2 * d[2] * x * y + d[3] * (r2 + 2 * x * x)
                dy = d[2] * (r2 + 2 * y * y) + 2 * d[3] * x * y
                x, y = (x0 - dx) / radial, (y0 - dy) / radial
        return pa.StructArray.from_arrays([pa.array(x, mask=missing), pa.array(y, mask=missing)], names=["x", "y"])

    return rays(col(u).cast("double"), col(v).cast("double"))


def reprojection_rms(squared_left: Column, squared_right: Column) -> Column:
    """RMS pixel distance over both cameras from per-corner squared distances (an aggregate)."""
    return F.sqrt((F.sum(squared_left) + F.sum(squared_right)) / (F.count(squared_left) + F.count(squared_right)))


def midpoint(o1, d1, o2, d2) -> list[Column]:
    """Halfway between two rays (origin, direction), along their common perpendicular; null for parallel rays.

    With n = d1 x d2, crossing the gap between the origins with one direction and projecting on n leaves only how far
    to go along the other."""
    n, gap = cross(d1, d2), [b - a for a, b in zip(o1, o2)]
    along = [F.try_divide(dot(cross(gap, d), n), dot(n, n)) for d in (d2, d1)]
    ends = [[o + k * d for o, d in zip(origin, direction)] for origin, direction, k in zip((o1, o2), (d1, d2), along)]
    return [(a + b) / 2 for a, b in zip(*ends)]


def triangulate(rays: DataFrame, r: list[float], t: list[float]) -> DataFrame:
    """Add x, y, z (left camera frame) to rows with normalised rays lx, ly, rx, ry; X_right = R X_left + t."""
    back = [F.lit(0.0 - total([r[3 * k + c] * t[k] for k in range(3)])) for c in range(3)]
    right = [F.col("rx"), F.col("ry"), F.lit(1.0)]
    d2 = [total([right[k] * F.lit(float(r[3 * k + c])) for k in range(3)]) for c in range(3)]
    point = midpoint([F.lit(0.0)] * 3, [F.col("lx"), F.col("ly"), F.lit(1.0)], back, d2)
    return rays.withColumns(dict(zip("xyz", point)))


def disparity_range(focal: float, baseline: float, depth_min: float, depth_max: float) -> tuple[int, int]:
    """Smallest disparity and number of disparities (a multiple of 16) covering the depth limits, 8 px to spare."""
    low = max(math.floor(focal * baseline / depth_max) - 8, 0)
    return low, math.ceil((focal * baseline / depth_min - low + 8) / 16) * 16


def disparity_points(disparity: DataFrame, q: list[float], minimum: float, depth_min: float, depth_max: float,
                     pose: list[float] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Points of a disparity raster (frame, row_, col_, d) through the 4x4 matrix q: kept where d reaches the minimum,
    the mask (rows with mask > 0) allows and the depth lies in the closed limits; then moved by pose."""
    valid = disparity.where(F.col("d") >= minimum)
    if mask is not None:
        valid = valid.join(mask.where(F.col("mask") > 0), ["frame", "row_", "col_"], "left_semi")
    column = [F.col("col_").cast("double"), F.col("row_").cast("double"), F.col("d"), F.lit(1.0)]
    h = [total([F.lit(float(q[4 * r + c])) * column[c] for c in range(4)]) for r in range(4)]
    raw = valid.withColumns({"x": F.try_divide(h[0], h[3]), "y": F.try_divide(h[1], h[3]), "z": F.try_divide(h[2], h[3])})
    kept = raw.where(F.col("z").between(depth_min, depth_max))
    if pose is None:
        return kept
    t = F.array(*[F.lit(float(v)) for v in pose])
    return kept.withColumns(dict(zip("xyz", apply_pose(t, [F.col("x"), F.col("y"), F.col("z")]))))


def left_right_check(left: DataFrame, right: DataFrame, tolerance: float, scale: float = 1.0) -> DataFrame:
    """Left disparities confirmed by the right raster, linearly interpolated at column col - d and clamped to the
    image: keep d > 0 with |back - d| < tolerance * scale."""
    edge = right.groupBy("frame").agg(F.max("col_").alias("_last"))
    found = (left.where(F.col("d") > 0).join(edge, "frame")
             .withColumn("_at", F.greatest(F.lit(0.0), F.least((F.col("col_") - F.col("d")).cast("double"), F.col("_last").cast("double"))))
             .withColumn("_c0", F.floor("_at").cast("long")))
    side = right.select("frame", "row_", F.col("col_").alias("_c"), F.col("d").alias("_d"))
    # one join brings both neighbours: each left pixel asks for its two columns
    asked = found.withColumn("_step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_c", F.least(F.col("_c0") + F.col("_step"), F.col("_last")).cast("long"))
    met = asked.join(side, ["frame", "row_", "_c"])
    part = F.col("_at") - F.col("_c0")
    share = F.when(F.col("_step") == 1, part).otherwise(1 - part)
    back = met.groupBy("frame", "row_", "col_", "d").agg(F.sum(share * F.col("_d")).alias("back"), F.count("*").alias("_n"))
    return back.where((F.col("_n") == 2) & (F.abs(F.col("back") - F.col("d")) < tolerance * scale)).drop("_n")


def refract_radial(r: Column, n_w: float) -> Column:
    """Normalised radius in air to the normalised radius of the same ray in water."""
    return F.tan(F.asin(clip_unit(F.sin(F.atan(r)) / F.lit(n_w))))


def unrefract_radial(r_w: Column, n_w: float) -> Column:
    """Inverse of refract_radial; null past the critical angle."""
    s = F.lit(n_w) * F.sin(F.atan(r_w))
    return F.when(F.abs(s) <= 1, F.tan(F.asin(clip_unit(s))))


def grow_quad(quad: str, scale: float = 1.6) -> Column:
    """Quad array<struct<u, v>> grown about its centre."""
    q = F.col(quad)
    mid = {c: (q[0][c] + q[1][c] + q[2][c] + q[3][c]) / 4 for c in "uv"}
    return F.transform(q, lambda p: F.struct(*[(mid[c] + (p[c] - mid[c]) * scale).alias(c) for c in "uv"]))


def in_convex(u: Column, v: Column, quad: Column, n: int = 4) -> Column:
    """Whether a point lies in or on a convex polygon (array<struct<u, v>>), either winding."""
    sides = []
    for k in range(n):
        a, b = quad[k], quad[(k + 1) % n]
        sides.append((b["u"] - a["u"]) * (v - a["v"]) - (b["v"] - a["v"]) * (u - a["u"]))
    low, high = F.least(*sides), F.greatest(*sides)
    return (low >= 0) | (high <= 0)


def masked_pixels(quads: DataFrame, size: tuple, scale: float = 1.6, keys: list[str] | None = None) -> DataFrame:
    """Distinct pixels covered by the grown quads of each image. A quad makes its own pixels row by row inside its
    bounding box, clipped to the image, so no pixel grid is joined."""
    keys = ["frame", "camera"] if keys is None else keys
    grown = quads.select(*keys, F.transform(grow_quad("quad", scale), lambda p: F.struct(
        F.bround(p["u"]).alias("u"), F.bround(p["v"]).alias("v"))).alias("g"))
    spans = {}
    for c, limit in (("u", size[0]), ("v", size[1])):
        values = F.col("g")[c]
        spans[c] = (F.greatest(F.lit(0), F.array_min(values)).cast("int"),
                    F.least(F.lit(limit - 1), F.array_max(values)).cast("int"))
    sized = grown.withColumns({"u0": spans["u"][0], "u1": spans["u"][1], "v0": spans["v"][0], "v1": spans["v"][1]}).where(
        (F.col("u0") <= F.col("u1")) & (F.col("v0") <= F.col("v1")))
    # quads that cover the same pixels of an image make them once
    rows = sized.distinct().withColumn("row_", F.explode(F.sequence("v0", "v1")))
    pixels = rows.withColumn("col_", F.explode(F.sequence("u0", "u1")))
    return pixels.where(in_convex(F.col("col_"), F.col("row_"), F.col("g"))).select(*keys, "row_", "col_").distinct()


def mask_summary(frames: DataFrame, poses: DataFrame, pixels: DataFrame, size: tuple) -> DataFrame:
    """Per image the masked share, and the status of its frame: projected (it has a pose), detected_only, unmasked."""
    area = F.lit(float(size[0] * size[1]))
    share = cut_lineage(pixels.groupBy("frame", "camera").agg((F.count("*") / area).alias("masked")))     # pixels are made once
    posed = poses.select("frame").distinct().withColumn("_posed", F.lit(True))
    seen = share.select("frame").distinct().withColumn("_seen", F.lit(True))
    return (frames.join(share, ["frame", "camera"], "left").join(posed, "frame", "left").join(seen, "frame", "left")
            .select("frame", "camera", F.coalesce("masked", F.lit(0.0)).alias("masked"),
                    F.when(F.col("_posed"), "projected").when(F.col("_seen"), "detected_only").otherwise("unmasked").alias("status")))


def plane_disparity(u: Column, v: Column, normal, offset, p1: tuple, q: tuple) -> Column:
    """Disparity of the plane n.X = offset along the ray of pixel (u, v); p1 = (f, cx, cy), q = (Q23, Q32, Q33). Null
    where the plane is not in front."""
    f, cx, cy = p1
    slope = normal[0] * (u - cx) / f + normal[1] * (v - cy) / f + normal[2]
    z = F.try_divide(offset, slope)
    return F.when(z > 0, (q[0] / z - q[2]) / q[1])


def normalised_radius(u: Column | str, v: Column | str, principal: tuple, size: tuple) -> Column:
    """Distance to the principal point over the farthest image corner's."""
    far = max(math.hypot(x - principal[0], y - principal[1]) for x in (0, size[0]) for y in (0, size[1]))
    return F.hypot(col(u) - principal[0], col(v) - principal[1]) / far
