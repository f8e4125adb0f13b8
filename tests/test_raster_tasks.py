"""Depth pixels are dealt over all tasks before their rays are made."""

from pyspark.sql import functions as F

from stratacloud.operators import cloud


def test_pixels_are_dealt_over_all_tasks(spark):
    points = spark.range(60).select((F.col("id") % 3).alias("frame"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"),
                                    F.lit(100.0).alias("z"), F.lit(1.0).alias("grey"))
    pose = F.array(*[F.lit(float(i % 5 == 0)) for i in range(12)])
    poses = spark.range(3).select(F.col("id").alias("frame"), pose.alias("T"))
    plan = cloud.tsdf_voxels(points, poses, 2.0, 4.0, 2.0, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
