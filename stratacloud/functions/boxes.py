"""Pairs of boxes that can matter to each other, found by walking two packed trees of boxes together.

Items (points, or anything with a box) are sorted along a space-filling curve and cut into leaves of a few items; 16
leaves in a row make a node, 16 nodes the next one, and so on. Both sides are packed alike, so a place
where either side crowds is many small leaves and never one large group. The walk starts where a side has few nodes and takes both sides
down a level at a time. Two boxes bound the distance of what they hold from below and above, so a node keeps
only the partners that can hold one of the nearest items of one of its own.

A large item makes every box around it large. With size classes, items of like extent are packed together and large
ones form a tree of their own, in as many leaves as there are large items to hold.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.functions.columns import norm
from stratacloud.functions.ordered import number_rows
from stratacloud.session import cut_lineage

LEAF = 32           # items in a leaf
FAN_BITS = 4        # 16 children to a node
CLASS_SHIFT = 40    # a node's number holds its size class above this bit, its place along the curve below
HUB = 256           # partners of one leaf in one group of the last join
FIRST_BITS = 8      # the walk starts at the level with at most 2^8 nodes a side and key: 65,536 pairs at most


class Tree(NamedTuple):
    """items with their leaf _node; leaves with box _lo*, _hi*, _weight and _bound, a distance within which each of their
    items surely has what it looks for (infinite where nothing is known); levels above the leaves."""
    items: DataFrame
    leaves: DataFrame
    height: int


def box_columns(axes: int, prefix: str = "_") -> tuple[list[str], list[str]]:
    return [f"{prefix}lo{k}" for k in range(axes)], [f"{prefix}hi{k}" for k in range(axes)]


def _curve(df: DataFrame, centres: list[Column]) -> tuple[Column, int]:
    """The interleaved bits of the centres' places on a 2^20 grid over their extent, and the number of rows."""
    ends = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{e}{k}") for k, c in enumerate(centres) for e, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return F.lit(0).cast("long"), 0
    lows = [ends[f"lo{k}"] for k in range(len(centres))]
    unit = (max(ends[f"hi{k}"] - low for k, low in enumerate(lows)) or 1.0) / ((1 << 20) - 1)
    curve = F.lit(0).cast("long")
    for k, (c, low) in enumerate(zip(centres, lows, strict=True)):
        place = F.floor((c - F.lit(low)) / unit).cast("long")
        # binary digits read as octal ones stand three bits apart
        curve = curve + F.shiftleft(F.conv(F.bin(place), 8, 10).cast("long"), k)
    return curve, ends["n"]


def pack(items: DataFrame, keys: list[str], low: list[str], high: list[str], leaf: int = LEAF, size_classes: bool = False) -> Tree:
    """The tree of items by their boxes; low and high name the columns of the two ends, equal for points."""
    columns = items.columns
    curve, count = _curve(items, [(F.col(a) + F.col(b)).cast("double") / 2 for a, b in zip(low, high, strict=True)])
    size = F.lit(0).cast("long")
    if size_classes:
        extent = F.greatest(*[F.col(b) - F.col(a) for a, b in zip(low, high, strict=True)])
        size = F.when(extent > 0, F.floor(F.log2(extent)) + 1100).otherwise(0).cast("long")
    placed = number_rows(items.withColumns({"_class": size, "_curve": curve}), [*keys, "_class", "_curve", *low], name="_rn")
    node = F.shiftleft("_class", CLASS_SHIFT).bitwiseOR(F.floor(F.col("_rn") / leaf).cast("long"))
    placed = placed.select(*columns, node.alias("_node"))
    lo, hi = box_columns(len(low))
    leaves = cut_lineage(placed.groupBy(*keys, "_node").agg(
        *[F.min(c).cast("double").alias(n) for c, n in zip(low, lo, strict=True)],
        *[F.max(c).cast("double").alias(n) for c, n in zip(high, hi, strict=True)],
        F.count("*").alias("_weight"), F.lit(float("inf")).alias("_bound")))
    return Tree(placed, leaves, _height(count, leaf))


def _height(count: int, leaf: int) -> int:
    """The level of the trees where the walk starts."""
    return -(-max((max(count - 1, 0) // leaf).bit_length() - FIRST_BITS, 0) // FAN_BITS)


def _level(tree: Tree, keys: list[str], axes: int, level: int, prefix: str) -> DataFrame:
    """The nodes of one level with their parent, columns under prefix."""
    lo, hi = box_columns(axes)
    nodes = tree.leaves
    if level:
        nodes = nodes.groupBy(*keys, F.shiftright("_node", level * FAN_BITS).alias("_node")).agg(
            *[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi], F.sum("_weight").alias("_weight"), F.max("_bound").alias("_bound"))
    return nodes.select(*keys, F.shiftright("_node", FAN_BITS).alias(f"{prefix}parent"), F.col("_node").alias(prefix),
                        *[F.col(c).alias(f"{prefix}{c[1:]}") for c in (*lo, *hi)], F.col("_weight").alias(f"{prefix}weight"), F.col("_bound").alias(f"{prefix}bound"))


def between(axes: int) -> tuple[Column, Column]:
    """Least and greatest distance of a box _alo*, _ahi* to a box _blo*, _bhi*."""
    least = [F.greatest(F.lit(0.0), F.col(f"_blo{k}") - F.col(f"_ahi{k}"), F.col(f"_alo{k}") - F.col(f"_bhi{k}")) for k in range(axes)]
    most = [F.greatest(F.col(f"_bhi{k}") - F.col(f"_alo{k}"), F.col(f"_ahi{k}") - F.col(f"_blo{k}")) for k in range(axes)]
    return norm(*least), norm(*most)


def _known(bound: Column, limit: float | None) -> Column:
    return bound if limit is None else F.least(bound, F.lit(float(limit)))


def _slack(distance: Column) -> Column:
    return distance * (1 + 1e-9) + 1e-9


def _reach(pairs: DataFrame, by: list[str], k: int | None, known: Column) -> DataFrame:
    """Keep the pairs within a known distance, and within the one that surely holds k items of b (any number for None)."""
    pairs = pairs.where(F.col("_least") <= _slack(known))
    if k is None:
        reach = F.lit(None).cast("double")
    elif k == 1:
        reach = F.min("_most").over(Window.partitionBy(*by))
    else:
        near = Window.partitionBy(*by).orderBy("_most").rangeBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("_cum", F.sum("_bweight").over(near))
        reach = F.min(F.when(F.col("_cum") >= k, F.col("_most"))).over(Window.partitionBy(*by))
    return pairs.withColumn("_reach", _slack(F.least(reach, known))).where(F.col("_least") <= F.col("_reach")).drop("_cum")


def _children(pairs: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], axes: int, known: Column) -> DataFrame:
    """All children of the nodes of each pair, a's first: those too far from the whole of b meet none of its children."""
    sides = [f"_b{e}{i}" for e in ("lo", "hi") for i in range(axes)]
    half = (pairs.select(*keys, F.col("_a").alias("_aparent"), F.col("_b").alias("_bparent"), *sides, *[c for c in pairs.columns if c == "_sure"])
            .join(a, [*keys, "_aparent"]).where(between(axes)[0] <= _slack(known)))
    return half.drop(*sides).join(b, [*keys, "_bparent"])


def near_leaves(left: Tree, right: Tree, keys: list[str], axes: int, k: int = 1, limit: float | None = None) -> DataFrame:
    """Pairs of leaves (a, b, with b's box and weight) that can hold an item of a and one of its k nearest in right,
    within limit where there is one. _reach is the distance within which a's items look."""
    height = max(left.height, right.height)
    least, most = between(axes)
    pairs = None
    for level in range(height, -1, -1):
        a, b = _level(left, keys, axes, level, "_a"), _level(right, keys, axes, level, "_b")
        known = _known(F.col("_abound"), limit)
        met = _children(pairs, a, b, keys, axes, known) if pairs is not None else a.join(b, keys) if keys else a.crossJoin(b)
        met = met.withColumns({"_least": least, "_most": most})
        pairs = cut_lineage(_reach(met, [*keys, "_a"], k, known))
    return pairs.select(*keys, "_a", "_b", "_bweight", "_reach", *[f"_{s}{e}{i}" for s in "ab" for e in ("lo", "hi") for i in range(axes)])


def at_points(items: DataFrame, pairs: DataFrame, keys: list[str], coords: list[str], k: int | None = 1,
              limit: float | None = None) -> DataFrame:
    """Left points with the leaves b that can matter to each, _least and _most distance to b's box, and _reach."""
    met = items.withColumnRenamed("_node", "_a").join(pairs, [*keys, "_a"])
    least = norm(*[F.greatest(F.lit(0.0), F.col(f"_blo{i}") - F.col(c), F.col(c) - F.col(f"_bhi{i}")) for i, c in enumerate(coords)])
    most = norm(*[F.greatest(F.abs(F.col(c) - F.col(f"_blo{i}")), F.abs(F.col(c) - F.col(f"_bhi{i}"))) for i, c in enumerate(coords)])
    met = met.withColumns({"_least": least, "_most": most})
    # rows lie by (keys, a) already, and a point has one a: no further shuffle
    known = F.col("_seed") if "_seed" in items.columns else F.lit(float("inf"))
    return _reach(met, [*keys, "_a", *coords], k, _known(known, limit))


def with_partners(candidates: DataFrame, pairs: DataFrame, partners: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (with a, b) joined to the items of leaf b (column _node). A leaf that many others name is copied, and
    each copy takes its share of them, so no leaf is one large group."""
    named = pairs.groupBy(*keys, "_b").agg(F.count("*").alias("_named")).where(F.col("_named") > HUB)
    hubs = named.select(*keys, "_b", F.ceil(F.col("_named") / HUB).alias("_copies"))
    one = F.lit(1).cast("long")
    left = candidates.join(hubs, [*keys, "_b"], "left").withColumn(
        "_copy", F.pmod(F.xxhash64("_a"), F.coalesce("_copies", one))).drop("_copies")
    right = partners.withColumnRenamed("_node", "_b").join(hubs, [*keys, "_b"], "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", one) - 1))).drop("_copies")
    return left.join(right, [*keys, "_b", "_copy"]).drop("_copy", "_b", "_a")
