"""Linear least squares as sums: one aggregate per group, then one small solve per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.matrices import solve_normal


def normal_sums(features: list[Column], target: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates of the normal equations: upper triangle of A^T W A, then A^T W b."""
    w = F.lit(1.0) if weight is None else weight
    m = len(features)
    upper = [F.sum(w * features[i] * features[j]).alias(f"_a{i}_{j}") for i in range(m) for j in range(i, m)]
    return upper + [F.sum(w * features[i] * target).alias(f"_b{i}") for i in range(m)]


def normal_solution(m: int) -> Column:
    """Solution array from the columns normal_sums made (least-norm where singular)."""
    matrix = F.array(*[F.col(f"_a{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)])
    return solve_normal(matrix, F.array(*[F.col(f"_b{i}") for i in range(m)]))


def fit_linear(df: DataFrame, keys: list[str], features: list[Column], target: Column, weight: Column | None = None,
               extras: list[Column] | None = None, name: str = "fit") -> DataFrame:
    """Least-squares coefficients per group as an array column, with further aggregates."""
    sums = df.groupBy(*keys).agg(*normal_sums(features, target, weight), *(extras or []))
    kept = [c for c in sums.columns if not c.startswith(("_a", "_b"))]
    return sums.withColumn(name, normal_solution(len(features))).select(*kept, name)
