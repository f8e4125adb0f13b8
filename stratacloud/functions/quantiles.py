"""Exact order statistics per group, without ever holding a group in one task.

`percentile` keeps every distinct value of a group in one buffer and a sorted `collect_list` keeps every row, so both
fail when one group holds a large share of the data. The exact route here has two passes. Pass one takes the count and
a mergeable quantile sketch per group (partial aggregation, fixed buffer). The sketch's guaranteed rank error gives a
narrow value band that must hold the wanted rank. Pass two counts what lies below the band and counts the distinct
values inside it; a running count over that thin band picks the exact value. Groups small enough to be harmless use
their whole range as the band.

A rank is ("linear", p): NumPy's interpolated percentile, or ("at", a, b): element n*a div b of the sorted group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.groups import computed

ACCURACY = 10_000
SMALL_GROUP = 100_000     # rows; up to here a whole group is one band, and a sorted list per group is harmless


def median(name: str) -> dict[str, tuple]:
    return {name: ("linear", 0.5)}


def _share(rank: tuple) -> float:
    return rank[1] if rank[0] == "linear" else rank[1] / rank[2]


def _position(rank: tuple, n: Column) -> Column:
    """Fractional zero-based position of the rank in a sorted group of n."""
    if rank[0] == "linear":
        return F.lit(float(rank[1])) * (n - 1).cast("double")
    return F.floor(n * F.lit(int(rank[1])) / F.lit(int(rank[2]))).cast("double")


def exact_quantiles(df: DataFrame, keys: list[str], value: Column | str, ranks: dict[str, tuple],
                    small_group: int = SMALL_GROUP, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group of keys (or one row for no keys) with one column per rank. Nulls are left out."""
    value = F.col(value) if isinstance(value, str) else value
    data = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names = list(ranks)
    shares = [_share(ranks[r]) for r in names]
    guard = 4.0 / accuracy
    probes = [max(0.0, s - guard) for s in shares] + [min(1.0, s + guard) for s in shares]
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", probes, accuracy).alias("_s"))
    # Ends of a group are open (nothing is above NaN): a value that is a sum of doubles can differ in its last digit when
    # the second pass computes it again, and would lie outside ends taken from the first.
    least, most = F.lit(float("-inf")), F.lit(float("nan"))
    whole = F.array(F.struct(F.lit(0).alias("band"), least.alias("lo"), most.alias("hi")))
    narrow = F.array(*[
        F.struct(F.lit(i).alias("band"),
                 F.when(F.lit(probes[i] <= 0.0), least).otherwise(F.col("_s")[i]).alias("lo"),
                 F.when(F.lit(probes[len(names) + i] >= 1.0), most)
                 .otherwise(F.col("_s")[len(names) + i]).alias("hi"))
        for i in range(len(names))])
    bands = sketch.select(*keys, "_n", F.when(F.col("_n") <= small_group, whole).otherwise(narrow).alias("_bands"))
    # few groups go to the rows: a shuffle by few keys would bring all rows to as many tasks
    bands = computed(bands) if keys else F.broadcast(bands)
    joined = data.join(bands, keys) if keys else data.crossJoin(bands)
    # A value below a band only counts; a value above it does not matter.
    touched = joined.select(*keys, "_v", F.explode("_bands").alias("_b")).where(F.col("_v") <= F.col("_b.hi"))
    counted = (touched
               .select(*keys, F.col("_b.band").alias("_band"),
                       F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"))
               .groupBy(*keys, "_band", "_v").agg(F.count("*").alias("_c")))
    order = Window.partitionBy(*keys, "_band").orderBy(F.col("_v").asc_nulls_first())
    running = counted.withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = bands.select(*keys, "_n")
    ranked = running.join(head, keys) if keys else running.crossJoin(F.broadcast(head))
    picks = []
    for i, name in enumerate(names):
        position = _position(ranks[name], F.col("_n"))
        in_band = F.col("_band") == F.when(F.col("_n") <= small_group, F.lit(0)).otherwise(F.lit(i))
        for suffix, wanted in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = in_band & (F.col("_cum") > wanted) & (F.col("_cum") - F.col("_c") <= wanted)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{suffix}{i}"))
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, name in enumerate(names):
        position = _position(ranks[name], F.col("_n"))
        share = position - F.floor(position)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        exact = lo + (hi - lo) * share
        out.append(F.when(lo.isNull() | hi.isNull(),
                          F.raise_error(F.lit(f"rank of {name} lies outside its sketch band")).cast("double"))
                   .otherwise(exact).alias(name))
    return found.select(*keys, *out)


def _list_statistics(ranks: dict[str, tuple], values: Column) -> list[Column]:
    n = F.size(values)
    out = []
    for name, rank in ranks.items():
        position = _position(rank, n)
        lo = F.element_at(values, (F.floor(position) + 1).cast("int"))
        hi = F.element_at(values, (F.ceil(position) + 1).cast("int"))
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return out


def cell_quantiles(df: DataFrame, keys: list[str], value: Column | str, ranks: dict[str, tuple],
                   extras: list[Column] | None = None, small_group: int = SMALL_GROUP) -> DataFrame:
    """Order statistics and plain aggregates (extras) of many groups that are usually small, such as grid cells.

    One counting job looks for a group above small_group. Without one, a single shuffle with a sorted list per group
    does all the work. With one, every group takes the exact two-pass route and the extras join on the keys."""
    extras = extras or []
    value = F.col(value) if isinstance(value, str) else value
    crowded = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small_group).limit(1)
    if crowded.isEmpty():
        grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value.cast("double"))).alias("_values"), *extras)
        kept = [c for c in grouped.columns if c != "_values"]
        return (grouped.where(F.size("_values") > 0)
                .select(*kept, *_list_statistics(ranks, F.col("_values"))))
    stats = exact_quantiles(df, keys, value, ranks, small_group)
    if not extras:
        return stats
    plain = df.groupBy(*keys).agg(*extras)
    ordered = plain.join(stats, keys)
    return ordered.select(*keys, *[c for c in plain.columns if c not in keys], *ranks)


def with_quantiles(df: DataFrame, aggregated: DataFrame, keys: list[str], value: Column | str,
                   ranks: dict[str, tuple]) -> DataFrame:
    """Add exact quantile columns to a table already aggregated by keys."""
    stats = exact_quantiles(df, keys, value, ranks)
    if not keys:
        return aggregated.join(F.broadcast(stats), F.lit(True), "left")
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *ranks)
    condition = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return aggregated.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])
