"""Keyed tables, job lists and provenance records."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY_KEY = ["session", "scan", "method", "reference"]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the new keys replaced, the rest kept."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: list[str]) -> str:
    """Upsert into a versioned table folder: the new version is written whole beside the old ones and then named in the
    pointer file, so a reader or a lost job never meets half a table. Returns the version's path."""
    current = current_version(spark, path)
    rows = new if current is None else upsert(spark.read.parquet(current), new, key)
    number = 0 if current is None else int(current.rsplit("=", 1)[1]) + 1
    target = f"{path}/version={number}"
    rows.orderBy(*order).write.mode("overwrite").parquet(target)
    spark.range(1).select(F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("overwrite").json(f"{path}/_current_{number}")
    return target


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Newest version whose pointer was written after it was complete."""
    number = -1
    while _exists(spark, f"{path}/_current_{number + 1}/_SUCCESS"):
        number += 1
    return None if number < 0 else f"{path}/version={number}"


def skip_done(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs whose output does not exist yet."""
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def settings_hash(columns: list[str]):
    """Stable hash of a settings row: its fields in name order as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def header_hash(header: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(header, sort_keys=True).encode()).hexdigest()[:16]


def load_cache(spark: SparkSession, path: str, header: dict) -> DataFrame | None:
    """Cached evaluations made under the same header; another header's partition is not seen."""
    part = f"{path}/header={header_hash(header)}"
    return spark.read.parquet(part) if _exists(spark, part) else None


def append_cache(scores: DataFrame, path: str, header: dict) -> None:
    scores.write.mode("append").parquet(f"{path}/header={header_hash(header)}")


def not_cached(settings: DataFrame, cache: DataFrame | None, columns: list[str]) -> DataFrame:
    keyed = settings.withColumn("settings_hash", settings_hash(columns))
    return keyed if cache is None else keyed.join(cache.select("settings_hash").distinct(), "settings_hash", "left_anti")


def evaluate_cached(spark: SparkSession, settings: DataFrame, columns: list[str], path: str, header: dict,
                    evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score only the settings the cache does not hold, append them, and return all scores."""
    fresh = not_cached(settings, load_cache(spark, path, header), columns)
    if not fresh.limit(1).isEmpty():
        append_cache(evaluate(fresh), path, header)
    keyed = settings.withColumn("settings_hash", settings_hash(columns)).select("settings_hash")
    return load_cache(spark, path, header).join(keyed, "settings_hash", "left_semi")


def job_matrix(axes: list[DataFrame], extras: DataFrame | None = None) -> DataFrame:
    """Jobs of all combinations of the configured axes (each a short list out of a config) and the extra jobs, without
    repeats."""
    jobs = axes[0]
    for axis in axes[1:]:
        jobs = jobs.crossJoin(axis)
    return (jobs if extras is None else jobs.unionByName(extras)).dropDuplicates()


def settings_diff(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys whose values differ between two settings tables, either side possibly missing."""
    left, right = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    return left.join(right, key, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def run_schema() -> str:
    return ("run string, frames bigint, stages map<string,struct<returncode:int,wall_s:double,peak_tree_rss_mb:double,peak_gpu_mib:double,"
            "mean_cpu_percent:double,mean_gpu_util_percent:double>>, sub_seconds map<string,double>")


def stage_records(runs: DataFrame) -> DataFrame:
    """Stage rows of run records (columns of run_schema): stages that returned 0, and sub-stages with their wall time."""
    stages = runs.select("run", "frames", F.explode("stages").alias("stage", "_r")).where(F.col("_r.returncode") == 0).select(
        "run", "frames", "stage", *[F.col(f"_r.{c}").alias(c) for c in ("wall_s", "peak_tree_rss_mb", "peak_gpu_mib", "mean_cpu_percent", "mean_gpu_util_percent")])
    parts = runs.select("run", "frames", F.explode("sub_seconds").alias("_n", "wall_s")).select(
        "run", "frames", F.concat(F.lit("sfm_"), "_n").alias("stage"), "wall_s")
    return stages.unionByName(parts, allowMissingColumns=True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(run_schema()).option("multiLine", "true").json(path)


def manifest(spark: SparkSession, experiment: str, configs: dict, digests: DataFrame, runs: list[dict], extra: dict | None = None) -> DataFrame:
    """One record of what results were made from. Digests (folder, digest) are one short line per input folder."""
    head = spark.range(1).select(
        F.lit(experiment).alias("experiment"), F.current_timestamp().alias("created"), F.lit(platform.python_version()).alias("python"),
        F.lit(pyspark.__version__).alias("spark"), F.lit(json.dumps(configs, sort_keys=True)).alias("configs"),
        F.lit(json.dumps(runs, sort_keys=True)).alias("runs"), F.lit(json.dumps(extra or {}, sort_keys=True)).alias("extra"))
    folded = digests.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("folder", "digest")))).alias("input_digests"))
    return head.crossJoin(F.broadcast(folded))


def write_manifest(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)
