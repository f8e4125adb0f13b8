"""The given tables bound to the operators' schemas. Each binding has a Spark form and the SQL the check runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lineitem(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*columns)


POINTS = ("l_returnflag AS scan", "l_linestatus AS method", "l_suppkey AS frame", "l_quantity AS x",
          "l_extendedprice / 1000 AS y", "l_discount * 100 AS z", "l_tax * 1000 AS grey")
DETECTIONS = ("l_returnflag AS channel", "l_linestatus AS camera", "l_orderkey % 500 AS image",
              "l_partkey % 80 AS tag", "l_quantity * 32 AS u", "l_extendedprice / 90 AS v")
RESIDUALS = ("l_suppkey % 28 AS split", "l_returnflag AS technique", "l_linestatus AS camera",
             "l_orderkey % 84 AS frame", "l_quantity * 32 AS u", "l_extendedprice / 90 AS v",
             "l_discount - 0.05 AS du", "l_tax - 0.04 AS dv",
             "CAST(200 + l_partkey % 1300 AS DOUBLE) AS frame_distance_mm")
SUMMARY = ("o_orderpriority AS session", "o_orderstatus AS scan",
           "concat('m', CAST(o_custkey % 5 AS VARCHAR(10)), '_v', CAST(o_custkey % 3 AS VARCHAR(10))) AS method",
           "o_orderkey AS version", "o_totalprice AS rms_mm")
COST = ("event_type AS stage", "user_id % 4 AS run", "ts", "value AS rss_mb")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf, *POINTS)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf, *DETECTIONS)


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf, *RESIDUALS)


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    return (_lineitem(spark, sf, "l_suppkey % 20 AS frame", "l_orderkey % 48 AS row_", "l_partkey % 64 AS col_",
                      "l_quantity")
            .groupBy("frame", "row_", "col_")
            .agg(F.min("l_quantity").alias("d"), F.max("l_quantity").alias("truth")))


def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS camera", "event_id AS frame",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) * 1000 AS pts_ns")


def cost_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*COST)


def poses(spark: SparkSession, sf: str) -> DataFrame:
    e = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(10)]
    return table(spark, sf, "embeddings").selectExpr(
        "label AS recording", "vec_id AS frame", f"{e[0]} * 100 AS tx", f"{e[1]} * 100 AS ty", f"{e[2]} * 100 AS tz",
        f"{e[3]} AS qw", f"{e[4]} AS qx", f"{e[5]} AS qy", f"{e[6]} AS qz", f"{e[7]} * 5 AS ex", f"{e[8]} * 5 AS ey",
        f"{e[9]} * 5 AS ez", "CASE WHEN embedding[10] < -0.1 THEN 1 ELSE 0 END AS lost")


def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*SUMMARY)


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


# ---- the same bindings as SQL -------------------------------------------------------------------------------------

_E = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(10)]
SQL = {
    "points": f"SELECT {', '.join(POINTS)} FROM lineitem",
    "detections": f"SELECT {', '.join(DETECTIONS)} FROM lineitem",
    "residuals": f"SELECT {', '.join(RESIDUALS)} FROM lineitem",
    "rasters": ("SELECT l_suppkey % 20 AS frame, l_orderkey % 48 AS row_, l_partkey % 64 AS col_, "
                "min(l_quantity) AS d, max(l_quantity) AS truth FROM lineitem "
                "GROUP BY l_suppkey % 20, l_orderkey % 48, l_partkey % 64"),
    "timestamps": ("SELECT CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS camera, event_id AS frame, "
                   "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) * 1000 AS pts_ns FROM events"),
    "cost_samples": f"SELECT {', '.join(COST)} FROM events",
    "poses": (f"SELECT label AS recording, vec_id AS frame, {_E[0]} * 100 AS tx, {_E[1]} * 100 AS ty, "
              f"{_E[2]} * 100 AS tz, {_E[3]} AS qw, {_E[4]} AS qx, {_E[5]} AS qy, {_E[6]} AS qz, {_E[7]} * 5 AS ex, "
              f"{_E[8]} * 5 AS ey, {_E[9]} * 5 AS ez, CASE WHEN embedding[11] < -0.1 THEN 1 ELSE 0 END AS lost "
              "FROM embeddings"),
    "summary_rows": f"SELECT {', '.join(SUMMARY)} FROM orders",
    "names": "SELECT page_id, url FROM pages",
}


def sql(*bindings: str, body: str) -> str:
    """Check SQL: the named bindings as common tables, then the body, which may add tables of its own after a comma."""
    head = ",\n".join(f"{name} AS ({SQL[name]})" for name in bindings)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {head}\n{body}"
    return f"WITH {head}\n{body}"


def q(expression: str, digits: int = 4) -> str:
    """SQL twin of functions.columns.quantise."""
    return f"(floor(({expression}) * 1e{digits} + 0.4871e0) / 1e{digits})"


def med(expression: str, p: float = 0.5) -> str:
    return f"quantile_cont({expression}, {p})"
