"""Plane-to-image maps per image, and whether a block of the plane is in view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.geometry import in_convex
from stratacloud.functions.normal import fit_linear


def plane_homography(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the eight entries (h33 = 1) mapping plan (px, py) to image (u, v), by linear least squares on sums.
    Needs four matches in general position; groups with fewer get none."""
    x, y = F.col("px"), F.col("py")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = matches.withColumn("_row", F.explode(F.array(
        F.struct(F.array(x, y, one, zero, zero, zero, -F.col("u") * x, -F.col("u") * y).alias("f"), F.col("u").alias("t")),
        F.struct(F.array(zero, zero, zero, x, y, one, -F.col("v") * x, -F.col("v") * y).alias("f"), F.col("v").alias("t")))))
    fitted = fit_linear(rows, keys, [F.col("_row.f")[i] for i in range(8)], F.col("_row.t"),
                        extras=[F.count("*").alias("_n")], name="h")
    return fitted.where(F.col("_n") >= 8).drop("_n")


def block_in_view(detections: DataFrame, plan: DataFrame, block: list[tuple], region: list[tuple]) -> DataFrame:
    """Per (pair, camera): reason `tags` unless every planned tag was found once, else `block` unless every block
    corner, mapped by the tags' homography, lies in the image's valid region; null reason = in view."""
    need = plan.agg(F.count("*").alias("_need"))
    found = detections.join(plan, "tag")
    counts = found.groupBy("pair", "camera").agg(F.count("*").alias("tags"))
    images = detections.select("pair", "camera").distinct().join(counts, ["pair", "camera"], "left").crossJoin(F.broadcast(need))
    images = images.withColumn("tags", F.coalesce("tags", F.lit(0).cast("long")))
    full = images.where(F.col("tags") >= F.col("_need")).select("pair", "camera")
    maps = plane_homography(found.join(full, ["pair", "camera"], "left_semi"), ["pair", "camera"])
    valid = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in region])
    checks = []
    for x, y in block:
        h = F.col("h")
        w = h[6] * x + h[7] * y + 1
        u, v = F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)
        checks.append(F.coalesce(in_convex(u, v, valid, len(region)), F.lit(False)))
    inside = checks[0]
    for c in checks[1:]:
        inside = inside & c
    return images.join(maps, ["pair", "camera"], "left").select(
        "pair", "camera", "tags", F.when(F.col("h").isNotNull(), inside).alias("inside"),
        F.when((F.col("tags") < F.col("_need")) | F.col("h").isNull(), "tags").when(~inside, "block").alias("reason"))
