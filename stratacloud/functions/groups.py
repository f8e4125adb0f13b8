"""Rows joined to one row per group, such as its mean or a band of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.session import cut_lineage

FEW_GROUPS = 10_000     # rows of a small table that go to every task


def computed(groups: DataFrame) -> DataFrame:
    """groups computed once and counted: marked to travel to the rows it is joined to, if there are few."""
    groups = cut_lineage(groups)
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to groups, at most one row per key (or one row for no keys). Few groups go to the rows, so the rows of
    a large group stay where they are; many are shuffled with the rows."""
    if keys:
        return rows.join(computed(groups), keys, how)
    return rows.join(F.broadcast(groups), F.lit(True), how)
