"""Streaming forms of the operators that are incremental by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratacloud.operators.cloud import AXES, frame_voxel_sums


def cost_windows(samples: DataFrame, window: str = "1 minute", delay: str = "2 minutes", keys: tuple = ("stage",),
                 measure: str = "rss_mb", time: str = "ts") -> DataFrame:
    """Peak, mean and count of a measure per stage and tumbling window; samples later than delay are dropped. Runs on a
    stream or on a table alike."""
    return (samples.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *keys)
            .agg(F.max(measure).alias(f"peak_{measure}"), F.avg(measure).alias(f"mean_{measure}"), F.count("*").alias("samples"))
            .select(F.col("w.start").alias("window_start"), *keys, f"peak_{measure}", f"mean_{measure}", "samples"))


def event_time(stamps: DataFrame) -> DataFrame:
    """Nanosecond stamps with an event-time column in microseconds."""
    return stamps.withColumn("event_time", F.timestamp_micros(F.floor(F.col("pts_ns") / 1000).cast("long")))


def paired_stream(right: DataFrame, left: DataFrame, max_dt_ms: float, delay: str = "10 seconds") -> DataFrame:
    """Right frames with the nearest left frame within max_dt_ms (the earlier one on a tie): an interval join of two
    watermarked streams, then the best match per right frame. State older than the watermark is let go; right frames
    without a match in reach are dropped, as the batch gate drops them.

    Both sides need event_time, pts_ns and frame; keys other than time belong in front of the call as a filter."""
    reach_ns = int(round(max_dt_ms * 1e6))
    reach = F.expr(f"INTERVAL {reach_ns // 1000 + 1} MICROSECONDS")
    # the join needs an equality: time cut into buckets, a left frame sent to the one or two its reach touches
    width = F.lit(2 * reach_ns + 1)
    bucket = F.floor(F.col("pts_ns") / width).cast("long")
    touched = F.sequence(F.floor((F.col("pts_ns") - reach_ns) / width).cast("long"), F.floor((F.col("pts_ns") + reach_ns) / width).cast("long"))
    r = right.withWatermark("event_time", delay).select(F.col("event_time").alias("r_time"), F.col("frame").alias("right_frame"),
                                                        F.col("pts_ns").alias("right_pts_ns"), bucket.alias("bucket"))
    lft = left.withWatermark("event_time", delay).select(F.col("event_time").alias("l_time"), F.col("frame").alias("left_frame"),
                                                         F.col("pts_ns").alias("left_pts_ns"), F.explode(touched).alias("l_bucket"))
    near = (F.col("bucket") == F.col("l_bucket")) & (F.col("l_time") >= F.col("r_time") - reach) & (F.col("l_time") <= F.col("r_time") + reach)
    gap = F.col("right_pts_ns") - F.col("left_pts_ns")
    joined = r.join(lft, near).where(F.abs(gap) <= reach_ns)
    best = joined.groupBy("r_time", "right_frame", "right_pts_ns").agg(
        F.min(F.struct(F.abs(gap).alias("gap"), "left_pts_ns", "left_frame")).alias("b"))
    return best.select("right_frame", F.col("b.left_frame").alias("left_frame"), "right_pts_ns", F.col("b.left_pts_ns").alias("left_pts_ns"),
                       ((F.col("right_pts_ns") - F.col("b.left_pts_ns")) / F.lit(1e6)).alias("dt_ms"))


def start_voxel_stream(points: DataFrame, voxel: float, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a stream of frame points into per-frame voxel sums, one folder per micro-batch. A batch that is run again
    overwrites its own folder, so every point counts once."""

    def fold(batch: DataFrame, epoch: int) -> None:
        frame_voxel_sums(batch, voxel).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def voted_so_far(spark: SparkSession, path: str, min_views: int = 3) -> DataFrame:
    """Voted voxels of everything folded so far. Sums of a frame split over batches are put together first, so it still
    counts as one view."""
    sums = [F.sum(c).alias(c) for c in ("sx", "sy", "sz", "sgrey", "n")]
    frames = spark.read.parquet(path).groupBy("vx", "vy", "vz", "frame").agg(*sums)
    cells = frames.groupBy("vx", "vy", "vz").agg(*sums, F.count("*").alias("views")).where(F.col("views") >= min_views)
    return cells.select("vx", "vy", "vz", *[(F.col(f"s{a}") / F.col("n")).alias(a) for a in AXES], (F.col("sgrey") / F.col("n")).alias("grey"), "views")


def compact_voxels(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Merge all batches' sums into one folder (the periodic merge); the batches can be dropped afterwards."""
    sums = [F.sum(c).alias(c) for c in ("sx", "sy", "sz", "sgrey", "n")]
    spark.read.parquet(path).groupBy("vx", "vy", "vz", "frame").agg(*sums).write.mode("overwrite").parquet(f"{target}/batch=0")
    return spark.read.parquet(target)
