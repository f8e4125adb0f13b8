"""Order-dependent columns over groups of any size.

A plain window per key puts a whole recording into one task. Here a group is cut into buckets of its order column;
windows run inside buckets, one summary row per bucket carries what crosses a bucket's edge, and a join on the bucket
brings it back. Where no numeric order column exists, rows are numbered after a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.session import cut_lineage

BUCKET = 100_000


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("long"))


def _attach(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(edges, [*keys, "_bucket"], "left")


def ordered_lag(df: DataFrame, keys: list[str], order: str, payload: list[str], prefix: str = "prev_",
                width: int = BUCKET) -> DataFrame:
    """Add each row's predecessor within keys by an integer order column: its payload columns with a prefix."""
    row = F.struct(*[F.col(c).alias(c) for c in payload])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    cut = _bucketed(df, order, width).withColumn("_prev", F.lag(row).over(inside))
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(row, F.col(order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = last.select(*keys, "_bucket", F.lag("_last").over(across).alias("_carry"))
    joined = _attach(cut, edges, keys)
    previous = F.coalesce("_prev", "_carry")
    return joined.withColumn("_prev", previous).select(
        *df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in payload])


def ordered_next(df: DataFrame, keys: list[str], order: str, payload: list[str], prefix: str = "next_",
                 width: int = BUCKET) -> DataFrame:
    """The mirror image of ordered_lag."""
    flipped = df.withColumn("_minus", -F.col(order))
    return ordered_lag(flipped, keys, "_minus", payload, prefix, width).drop("_minus")


def running_totals(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = BUCKET) -> DataFrame:
    """Add running sums within keys up to and including each row, one per name."""
    cut = _bucketed(df, order, width).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    summed = _attach(cut.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in values}), edges, keys)
    return summed.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BUCKET) -> DataFrame:
    """running_totals for one value."""
    return running_totals(df, keys, order, {name: value}, width)


def following_extremes(df: DataFrame, keys: list[str], order: str, value: str, width: int = BUCKET) -> DataFrame:
    """Add the smallest and largest value among the strictly later rows within keys: later_min, later_max."""
    cut = _bucketed(df, order, width)
    after = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    spans = cut.groupBy(*keys, "_bucket").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    beyond = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    edges = spans.select(*keys, "_bucket", F.min("_lo").over(beyond).alias("_elo"), F.max("_hi").over(beyond).alias("_ehi"))
    joined = _attach(cut.withColumns({"_ilo": F.min(value).over(after), "_ihi": F.max(value).over(after)}), edges, keys)
    return joined.select(*df.columns, F.least("_ilo", "_elo").alias("later_min"), F.greatest("_ihi", "_ehi").alias("later_max"))


def number_rows(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "rn") -> DataFrame:
    """Add a zero-based row number in the order of keys and order columns, counted within keys.

    A range sort spreads even a single huge key over all tasks. The sorted rows are written once, so the two passes
    over them see the same partitions; one count per partition gives every partition its offset."""
    keys = keys or []
    # id of a row = partition number in the high bits, position inside the partition in the low 33 bits
    marked = cut_lineage(df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    counts = marked.groupBy(part).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    placed = (marked.withColumn("_part", F.shiftright("_id", 33))
              .join(F.broadcast(offsets), "_part")      # one row per partition
              .withColumn("_at", F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1)))
    if not keys:
        return placed.select(*df.columns, F.col("_at").alias(name))
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_start"))
    return placed.join(starts, keys).select(*df.columns, (F.col("_at") - F.col("_start")).alias(name))
