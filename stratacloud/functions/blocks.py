"""Points dealt to cubic blocks of space, each block with the points around it, as arrays.

A block is a cube of a grid; every point goes to its own block and to all blocks it lies within reach of, so what a block
asks of its surroundings needs no further exchange. Points travel as packed arrays (24 bytes and their copies) and not as
rows. crowd() tells how many rows the fullest block holds, so that a caller can take another route where one is too full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.near import _tasks

MERGED = 1 << 20    # points of a block held before copies among them are merged
PART = ["_points", "_copies"]    # coordinates with extras, copies


def finite(points: DataFrame, keys: list[str], coords: list[str]):
    """Condition: all keys and coordinates are there and finite."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    for c in coords:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < math.inf)
    return known


def numbers(coords: list[str]) -> list[str]:
    return [f"_b{k}" for k in range(len(coords))]


def crowd(points: DataFrame, keys: list[str], coords: list[str], edge: float) -> int:
    """Rows in the fullest block."""
    at = [F.floor(F.col(c).cast("double") / F.lit(edge)).cast("long").alias(b) for b, c in zip(numbers(coords), coords)]
    return points.select(*keys, *at).groupBy(*keys, *numbers(coords)).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def merged(p, w):
    """Distinct rows of p, and their copies."""
    import numpy as np

    order = np.lexsort(p.T[::-1])
    p, w = p[order], w[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    start = np.flatnonzero(new)
    return p[start], np.add.reduceat(w, start) if len(start) else w


def deal(points: DataFrame, keys: list[str], coords: list[str], edge: float, reach: float, extras: tuple = ()) -> DataFrame:
    """Rows of packed points (_points, _copies) per key and block, in several parts. points must be finite(); extras are
    further numbers that a point carries, and points that differ in them are different."""
    axes = len(coords)
    by = [*keys, *numbers(coords)]
    kinds = dict(points.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{b} bigint" for b in numbers(coords)] + [f"{c} binary" for c in PART])
    steps = list(product((-1, 0, 1), repeat=axes)) if reach else [(0,) * axes]
    reach = reach * (1 + 1e-9) + 1e-9

    def pack(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            if keys:
                group = batch.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy().astype(np.int64)
            every = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*coords, *extras)], 1)
            p = every[:, :axes]
            own = np.floor(p / edge).astype(np.int64)
            named, at = [], []
            for step in steps:
                there = own + np.array(step)
                apart = np.maximum(0.0, np.maximum(there * edge - p, p - (there + 1) * edge))
                taken = np.flatnonzero((apart <= reach).all(1)) if any(step) else np.arange(len(p))
                named.append(np.c_[group[taken], there[taken]])
                at.append(taken)
            named, at = np.concatenate(named), np.concatenate(at)
            order = np.lexsort(named.T[::-1])
            named, at = named[order], at[order]
            start = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]).any(1)])
            pieces = [merged(every[rows], np.ones(len(rows), np.int64)) for rows in np.split(at, start[1:])]
            first = batch.take(pa.array(at[start]))
            yield pa.RecordBatch.from_arrays(
                [*[first.column(k) for k in keys], *[pa.array(named[start, 1 + k]) for k in range(axes)],
                 pa.array([q.tobytes() for q, _ in pieces], pa.binary()), pa.array([w.tobytes() for _, w in pieces], pa.binary())],
                names=[*by, *PART])

    return points.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*coords, *extras)]).mapInArrow(pack, schema)


def solved(sides: list[DataFrame], keys: list[str], coords: list[str], solve: Callable, columns: dict[str, str], extras: tuple = ((),)) -> DataFrame:
    """One row per block: what solve(*[(p, w) of each side], block) makes of the distinct points there, as the values of the
    columns (None for no row). sides come from deal, extras name those of each."""
    axes, by = len(coords), [*keys, *numbers(coords)]
    kinds, widths = dict(sides[0].dtypes), [axes + len(e) for e in extras]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"{c} {t}" for c, t in columns.items()])

    def meet(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds_out, state = None, None

        def gather(parts, width):
            if not parts:
                return np.zeros((0, width)), np.zeros(0, np.int64)
            return merged(np.concatenate([q for q, _ in parts]), np.concatenate([w for _, w in parts]))

        def finish():
            name, parts, _ = state
            values = solve(*[gather(mine, width) for mine, width in zip(parts, widths)], np.array([v.as_py() for v in name[len(keys):]]))
            if values is not None:
                arrays = [pa.array([v.as_py()], t) for v, t in zip(name, kinds_out)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array([v]) for v in values]], names=[*by, *columns])

        for batch in batches:
            kinds_out = [batch.schema.field(c).type for c in by]
            names = [batch.column(c) for c in by]
            of = batch.column("_side").to_numpy()
            for i in range(batch.num_rows):
                name = [c[i] for c in names]
                if state is None or state[0] != name:
                    if state is not None:
                        yield from finish()
                    state = [name, [[] for _ in widths], [0] * len(widths)]
                q, w = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(PART, (float, np.int64)))
                k = of[i]
                state[1][k].append((q.reshape(-1, widths[k]).copy(), w.copy()))
                state[2][k] += len(w)
                if state[2][k] > MERGED:
                    state[1][k] = [gather(state[1][k], widths[k])]
                    state[2][k] = 0
        if state is not None:
            yield from finish()

    every = None
    for k, side in enumerate(sides):
        side = side.withColumn("_side", F.lit(k))
        every = side if every is None else every.unionByName(side)
    return every.repartition(_tasks(every), *by).sortWithinPartitions(*by).mapInArrow(meet, schema)
