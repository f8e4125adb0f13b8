"""Neighbour joins of points, on two packed trees of boxes (functions.boxes).

Points are distinct coordinate tuples with a weight (how many copies they stand for), so copies cost nothing. Both sides
are packed together into leaves of a few hundred points, one row per leaf; pairs of leaves that can matter are found from
the boxes alone, and only the points of b within reach of a's box travel to a. There they meet as arrays, so no row per
pair of points is ever made or moved. One route serves every size, with or without a limit: neither side's crowds make a
large group, as a leaf streams its candidates and holds a bounded part of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions import boxes
from stratacloud.functions.columns import norm
from stratacloud.session import cut_lineage

LEAF = 512          # distinct points in a leaf
HELD = 1 << 14      # candidates a leaf holds before it keeps the nearest only
TOGETHER = 32       # left points in a row along the curve that share their candidates
ROWS = 1 << 13      # rows of an Arrow batch handed on
NO_TAG = -(1 << 63)
PACKED = ["_points", "_left", "_right", "_tags"]                  # of a leaf's row: coordinates, copies, tags
COUNTS = ["_lcount", "_lweight", "_rcount", "_rweight"]
GRID = 1 << 22      # cells of a grid of points that meet
FULL = 4            # points in an occupied cell of such a grid, before it is cut finer
ASKED = 1 << 13     # points that search a grid together
FEW_PLACES = 1 << 17    # places that travel to the tasks: 6 MB with a normal each


def distinct_points(points: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """Coordinate tuples with their multiplicity _w."""
    return points.groupBy(*keys, *coords).agg(F.count("*").alias("_w"))


def grid(coords: list[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(float(size))).cast("long").alias(f"_g{k}") for k, c in enumerate(coords)]


def _names(coords: list[str]) -> list[str]:
    return [f"_g{k}" for k in range(len(coords))]


def around(df: DataFrame, coords: list[str], size: float, radius: float) -> DataFrame:
    """Rows repeated for every grid cell their radius touches: two per axis where cells are twice the radius wide."""
    cells, reach = df, F.lit(radius * (1 + 1e-9) + 1e-12)
    for k, c in enumerate(coords):
        low, high = (F.floor(v / F.lit(float(size))).cast("long") for v in (F.col(c) - reach, F.col(c) + reach))
        cells = cells.withColumn(f"_g{k}", F.explode(F.sequence(low, high)))
    return cells


def _distance(coords: list[str]) -> Column:
    return norm(*[F.col(c) - F.col(f"n_{c}") for c in coords])


def radius_pairs(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], radius: float) -> DataFrame:
    """Every left row with every right row within radius: the right's columns get the prefix n_, distance is d. For
    consumers that need all pairs; nearest and exists below prune instead."""
    taken = right.select(*keys, *[F.col(c).alias(f"n_{c}") for c in right.columns if c not in keys], *grid(coords, 2 * radius))
    met = around(left, coords, 2 * radius, radius).join(taken, [*keys, *_names(coords)]).drop(*_names(coords))
    return met.withColumn("d", _distance(coords)).where(F.col("d") <= radius)


class _Grid:
    """Points q (sorted by coordinates) in small cells: the nearest of them to each p within radius. Cells hold a few points;
    a search looks around a point's own cell and goes on outwards until nothing nearer can come."""

    def __init__(self, q, radius: float):
        import numpy as np

        self.q, self.radius = q, radius
        if not len(q):
            return
        self.low, extent = q.min(0), np.ptp(q, axis=0)
        self.size = float(radius)
        while np.prod(np.floor(extent / self.size) + 1) > GRID:
            self.size *= 2
        self._place(extent)
        while len(q) > FULL * self.occupied and self.size > radius / 256 and np.prod(np.floor(2 * extent / self.size) + 1) <= GRID:
            self.size /= 2
            self._place(extent)
        self.order = np.argsort(self.key, kind="stable")
        self.first = np.r_[0, np.cumsum(np.bincount(self.key, minlength=int(np.prod(self.shape))))]

    def _place(self, extent) -> None:
        import numpy as np

        self.shape = np.floor(extent / self.size).astype(np.int64) + 1
        cells = np.minimum(np.floor((self.q - self.low) / self.size).astype(np.int64), self.shape - 1)
        self.key = np.ravel_multi_index(cells.T, self.shape)
        self.occupied = len(np.unique(self.key))

    def nearest(self, p):
        """Positions in q and distances; infinite beyond radius."""
        import numpy as np

        best, distance = np.zeros(len(p), np.int64), np.full(len(p), np.inf)
        if len(self.q):
            reach = self.radius * (1 + 1e-9) + 1e-12
            high = self.q.max(0)
            close = np.flatnonzero(((p >= self.low - reach) & (p <= high + reach)).all(1))
            for start in range(0, len(close), ASKED):
                at = close[start:start + ASKED]
                best[at], distance[at] = self._search(p[at])
        return best, distance

    def _search(self, p):
        import numpy as np

        best, distance = np.full(len(p), len(self.q), np.int64), np.full(len(p), np.inf)
        rings = np.ones(len(p), np.int64)
        open_ = np.arange(len(p))
        while len(open_):
            for ring in np.unique(rings[open_]):
                at = open_[rings[open_] == ring]
                best[at], distance[at] = self._around(p[at], int(ring))
            # all within this many cells have been seen; a nearer point can lie no further than the one found
            seen = rings[open_] * self.size * (1 - 1e-9)
            wanted = np.minimum(distance[open_], self.radius * (1 + 1e-9))
            left = wanted >= seen
            next_ = np.where(np.isinf(distance[open_]), 2 * rings[open_], np.ceil(wanted / (self.size * (1 - 1e-9))).astype(np.int64) + 1)
            most = int(np.ceil(self.radius * (1 + 1e-9) / (self.size * (1 - 1e-9)))) + 1
            rings[open_] = np.minimum(next_, most)
            open_ = open_[left]
        return np.where(np.isinf(distance), 0, best), distance

    def _around(self, p, ring: int):
        import numpy as np

        axes = p.shape[1]
        cells = np.floor((p - self.low) / self.size).astype(np.int64)
        low, high = np.maximum(cells[:, -1] - ring, 0), np.minimum(cells[:, -1] + ring, self.shape[-1] - 1)
        starts, sizes, rows = [], [], []
        for step in np.ndindex(*[2 * ring + 1] * (axes - 1)):
            at = cells[:, :-1] + (np.array(step) - ring)
            there = np.flatnonzero(((at >= 0) & (at < self.shape[:-1])).all(1) & (low <= high))
            base = np.zeros(len(there), np.int64)
            for k in range(axes - 1):
                base = (base + at[there, k]) * self.shape[k + 1]
            start, stop = self.first[base + low[there]], self.first[base + high[there] + 1]
            kept = stop > start
            starts.append(start[kept])
            sizes.append(stop[kept] - start[kept])
            rows.append(there[kept])
        start, size, row = np.concatenate(starts), np.concatenate(sizes), np.concatenate(rows)
        best, distance = np.full(len(p), len(self.q), np.int64), np.full(len(p), np.inf)
        order = np.argsort(row, kind="stable")
        start, size, row = start[order], size[order], row[order]
        ends = np.cumsum(size)
        first = 0
        while first < len(row):      # whole points, a bounded number of candidates at a time
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HELD * 64, "right"))
            last = int(np.searchsorted(row, row[min(last, len(row) - 1)])) if last < len(row) else last
            last = last if last > first else int(np.searchsorted(row, row[first], "right"))
            part = slice(first, last)
            pair = np.repeat(np.arange(first, last), size[part])
            spot = np.arange(len(pair)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + start[pair]
            of, other = row[pair], self.order[spot]
            d = np.zeros(len(pair))
            for k in range(axes):
                gap = p[of, k] - self.q[other, k]
                gap *= gap
                d += gap
            d = np.sqrt(d, out=d)
            d[d > self.radius] = np.inf
            lead = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.minimum.reduceat(d, lead)
            tied = np.where(d == np.repeat(least, np.diff(np.r_[lead, len(d)])), other, len(self.q))
            best[of[lead]], distance[of[lead]] = np.minimum.reduceat(tied, lead), least
            first = last
        return best, distance


def _nearest_within(p, q, radius: float):
    """Positions in q (sorted by coordinates) and distances of the nearest to each p, of equally near ones the first; infinite
    beyond radius."""
    return _Grid(q, radius).nearest(p)


def few_places(places: DataFrame, coords: list[str], extras: list[str]):
    """Distinct places with their extras as one array, sorted by coordinates, in a variable that the tasks share; None for
    more than FEW_PLACES."""
    import numpy as np

    rows = places.where(_whole(coords)).select(*[F.col(c).cast("double") for c in (*coords, *extras)]).limit(FEW_PLACES + 1).toPandas().to_numpy(float)
    if len(rows) > FEW_PLACES:
        return None
    rows = rows[np.lexsort(rows[:, :len(coords)].T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :len(coords)] != rows[:-1, :len(coords)]).any(1)
    return places.sparkSession.sparkContext.broadcast(rows[new])


def nearest_of_few(left: DataFrame, places, coords: list[str], extras: list[str], radius: float) -> DataFrame:
    """nearest_in_cells for one target of few_places that all left rows share, with its extras: it travels to the rows, so
    none is shuffled."""
    def meet(batches):
        for batch in batches:
            q, p = places.value, batch[coords].to_numpy(float)
            best, distance = _nearest_within(p, q[:, :len(coords)], radius)
            kept = distance < float("inf")
            out, found = batch[kept].copy(), q[best[kept]] if len(q) else q
            for k, c in enumerate([f"n_{c}" for c in coords] + extras):
                out[c] = found[:, k]
            out["d"] = distance[kept]
            yield out

    schema = ", ".join([f"`{c}` {t}" for c, t in left.dtypes] + [f"n_{c} double" for c in coords] + [f"{c} double" for c in (*extras, "d")])
    return left.where(_whole(coords)).mapInPandas(meet, schema)


def nearest_in_cells(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], radius: float) -> DataFrame:
    """Left rows with their nearest right point within a short radius as n_<coord> and d (of equally near ones the smaller
    coordinates). For loops that ask anew each time: no trees are packed. A left point lies in one cell of four
    times the radius, a right point in all that it can reach, and they meet there as arrays."""
    by = [*keys, *_names(coords)]
    carried = left.columns
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    asked = left.where(_whole(coords) & known).select("*", *grid(coords, 4 * radius))
    places = right.where(_whole(coords) & known).select(     # keys by a new name and back: both sides may come from one table
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).cast("double").alias(c) for c in coords]).distinct().withColumnsRenamed({f"_{k}": k for k in keys})
    met = around(places, coords, 4 * radius, radius)
    found_names = [f"n_{c}" for c in coords]

    def meet(mine, theirs):
        import numpy as np
        import pandas as pd

        p, q = mine[coords].to_numpy(float), theirs[coords].to_numpy(float)
        q = q[np.lexsort(q.T[::-1])]
        best, distance = _nearest_within(p, q, radius)
        kept = np.isfinite(distance)
        out = {c: pd.Series(mine[c].to_numpy()[kept], dtype=mine[c].dtype if mine[c].dtype.kind in "iufb" else object) for c in carried}
        near_q = q[best[kept]] if len(q) else np.zeros((0, len(coords)))
        return pd.DataFrame({**out, **{c: near_q[:, k] for k, c in enumerate(found_names)}, "d": distance[kept]})

    kinds = dict(left.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carried] + [f"{c} double" for c in (*found_names, "d")])
    cells = [side.repartition(_tasks(left), *by).groupBy(*by) for side in (asked, met)]
    return cells[0].cogroup(cells[1]).applyInPandas(meet, schema)


def _distances(p, q):
    """The matrix of distances, summed axis by axis as functions.columns.norm does."""
    import numpy as np

    d = p[:, 0, None] - q[None, :, 0]
    d *= d
    for k in range(1, p.shape[1]):
        step = p[:, k, None] - q[None, :, k]
        step *= step
        d += step
    return np.sqrt(d, out=d)


def _nearest_of(p, q, k: int, limit: float | None):
    """Positions in q (sorted by coordinates) and distances of the k nearest to each p, by distance and then coordinates;
    infinite where there are fewer."""
    import numpy as np

    d = _distances(p, q)
    if limit is not None:
        d[d > limit] = np.inf
    if k == 1:
        at = d.argmin(1)[:, None]
        return at, np.take_along_axis(d, at, 1)
    if len(q) > k:
        at = np.argpartition(d, k - 1, 1)[:, :k]
        last = np.take_along_axis(d, at, 1).max(1)
        # where a tie crosses the k-th place, the smaller coordinates win
        for i in np.flatnonzero(np.isfinite(last) & ((d <= last[:, None]).sum(1) > k)):
            tied = np.flatnonzero(d[i] <= last[i])
            at[i] = tied[np.argsort(d[i, tied], kind="stable")[:k]]
        at.sort(1)
    else:
        at = np.broadcast_to(np.arange(len(q)), d.shape)
    near = np.take_along_axis(d, at, 1)
    order = np.argsort(near, 1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)


def _known_within(p, q, w, k: int):
    """A distance within which each p surely has k of q: few positions are enough where all have many copies."""
    import numpy as np

    k = -(-k // int(w.min())) if len(w) else 1
    if len(q) < k:
        return np.full(len(p), np.inf)
    d = _distances(p, q)
    return d.min(1) if k == 1 else np.partition(d, k - 1, 1)[:, k - 1]


class _Leaf:
    """The left points of one leaf and the nearest candidates met so far."""

    def __init__(self, points, k: int, limit: float | None, q, w):
        import numpy as np

        self.points, self.k, self.limit = points, k, limit
        self.q, self.w, self.held, self.best = [q], [w], len(q), None
        self.bound = np.concatenate([_known_within(points[i:i + TOGETHER], q, w, k) for i in range(0, len(points), TOGETHER)])
        if limit is not None:
            self.bound = np.minimum(self.bound, limit)

    def add(self, q, w) -> None:
        self.q.append(q)
        self.w.append(w)
        self.held += len(q)
        if self.held > HELD:
            self.settle()

    def settle(self) -> None:
        import numpy as np

        if not self.held:
            return
        q, w = np.concatenate(self.q), np.concatenate(self.w)
        order = np.lexsort(q.T[::-1])
        q, w = q[order], w[order]
        self.q, self.w, self.held = [], [], 0
        parts = []
        for i in range(0, len(self.points), TOGETHER):
            p, reach = self.points[i:i + TOGETHER], self.bound[i:i + TOGETHER].max()
            reach = reach * (1 + 1e-9) + 1e-9
            close = np.flatnonzero(((q >= p.min(0) - reach) & (q <= p.max(0) + reach)).all(1))
            if not len(close):
                close = np.zeros(1, np.int64)       # too far for any of them
            at, d = _nearest_of(p, q[close], self.k, self.limit)
            fill = self.k - at.shape[1]
            parts.append((np.pad(close[at], ((0, 0), (0, fill))), np.pad(d, ((0, 0), (0, fill)), constant_values=np.inf)))
        at, d = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
        found = q[at], d, w[at]
        if self.best is not None:
            found = tuple(np.concatenate([a, b], 1) for a, b in zip(self.best, found))
            order = np.lexsort([*(found[0][..., c] for c in reversed(range(q.shape[1]))), found[1]], axis=1)[:, :self.k]
            found = np.take_along_axis(found[0], order[..., None], 1), *(np.take_along_axis(f, order, 1) for f in found[1:])
        self.best = found
        self.bound = np.minimum(self.bound, found[1][:, -1])

    def result(self):
        """Neighbours q, distances d and how many copies of each count, per left point; None where nothing was met."""
        import numpy as np

        self.settle()
        if self.best is None:
            return None
        q, d, w = self.best
        w = np.where(np.isfinite(d), w, 0)
        before = np.cumsum(w, 1) - w
        return q, d, np.clip(self.k - before, 0, w)


def _whole(coords: list[str]) -> Column:
    whole = F.lit(True)
    for c in coords:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return whole


def _tasks(df: DataFrame) -> int:
    """Tasks for steps whose work is far larger than their bytes: as many as shuffles have, not merged by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _leaves(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], leaf: int, k: int,
            beyond: float | None = None, tag: str | None = None, both_ways: bool = False) -> tuple[DataFrame, int]:
    """One row per leaf of both sides' distinct points, and how many points there are. _points, _left and _right are the
    packed coordinates and copies on either side; _lcount the left points, _l* and _r* the box and weight of either side, _lbound a distance within
    which each left point has k right points in this leaf. Left points that have them within beyond do not count in it, nor
    in the left box and weight: a leaf of such points only has no box. With a tag (a whole number of the left rows) points of
    different tags are different points, and _tags holds them. _rcount and _rbound say of the right points what _lcount and
    _lbound say of the left ones; the bound is only known both_ways (for k = 1).

    Points without a whole position or key are left out. The curve's order is that of a range sort, so a leaf is cut from
    consecutive rows of one partition; its number counts up inside the partition."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    places = [F.col(c).cast("double").alias(c) for c in coords]
    tags = ["_tag"] if tag else []
    both = left.select(*keys, *places, *[F.coalesce(F.col(tag).cast("long"), F.lit(NO_TAG)).alias(t) for t in tags], one.alias("_left"), none.alias("_right")).unionByName(
        right.select(*keys, *places, *[F.lit(NO_TAG).alias(t) for t in tags], none.alias("_left"), one.alias("_right")))
    whole = _whole(coords)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    both = cut_lineage(both.where(whole).groupBy(*keys, *coords, *tags).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right")))
    curve, count = boxes._curve(both, [F.col(c) for c in coords])
    lo, hi = boxes.box_columns(len(coords), "")
    kinds = dict(both.dtypes)
    numbers = [f"_{s}{c}" for s in "lr" for c in (*lo, *hi)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["_node bigint", *[f"{c} binary" for c in PACKED]]
                       + [f"{c} double" for c in numbers] + [f"{c} bigint" for c in COUNTS] + ["_lbound double", "_rbound double"])

    def pack(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        node, out, types = TaskContext.get().partitionId() << 33, [], None

        def within(p, q, w):
            if not len(q) or not len(p):
                return np.full(len(p), np.inf)
            return np.concatenate([_known_within(p[i:i + TOGETHER], q, w, k) for i in range(0, len(p), TOGETHER)])

        def row(table, at, p, mine, theirs, marks):
            nonlocal node
            q, w = p[theirs > 0], theirs[theirs > 0]
            asked = p[mine > 0]
            bound, here = within(asked, q, w), len(asked)
            back = within(q, asked, mine[mine > 0]) if both_ways else np.full(len(q), np.inf)
            if beyond is not None:
                asked, bound = asked[bound > beyond], bound[bound > beyond]
            ends = [f for side in (asked, q) for f in ((*side.min(0), *side.max(0)) if len(side) else [None] * (2 * len(coords)))]
            out.append((*[table.column(c)[at] for c in range(len(keys))], node, p.tobytes(), mine.tobytes(), theirs.tobytes(),
                        None if marks is None else marks.tobytes(), *[None if e is None else float(e) for e in ends], here, len(asked), len(q), int(w.sum()),
                        float(bound.max()) if len(asked) else 0.0, float(back.max()) if len(q) else 0.0))
            node += 1

        def handed():
            columns = list(zip(*out))
            arrays = [pa.array([v.as_py() for v in column], types[c]) for c, column in enumerate(columns[:len(keys)])]
            first = len(keys) + 1 + len(PACKED)
            arrays += [pa.array(columns[len(keys)], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[len(keys) + 1:first]]
            arrays += [pa.array(c, pa.float64()) for c in columns[first:first + len(numbers)]]
            arrays += [*[pa.array(c, pa.int64()) for c in columns[first + len(numbers):-2]], *[pa.array(c, pa.float64()) for c in columns[-2:]]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "_node", *PACKED, *numbers, *COUNTS, "_lbound", "_rbound"])

        def cut(table, last):
            """Rows of all leaves that are complete; what remains is returned."""
            n = table.num_rows
            change = np.zeros(max(n - 1, 0), bool)
            for c in range(len(keys)):
                column = table.column(c).combine_chunks()
                change |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(change) + 1, n]
            p = np.stack([table.column(len(keys) + c).to_numpy() for c in range(len(coords))], 1)
            mine, theirs, *marks = (table.column(c).to_numpy() for c in ("_left", "_right", *tags))
            for start, end in zip(starts[:-1], starts[1:]):
                for at in range(start, end, leaf):
                    to = min(at + leaf, end)
                    if to == n and to - at < leaf and not last:
                        return table.slice(at)
                    row(table, at, p[at:to], mine[at:to], theirs[at:to], marks[0][at:to] if marks else None)
            return None

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            types = [f.type for f in table.schema]
            rest = cut(table if rest is None else pa.concat_tables([rest, table]), False) if batch.num_rows else rest
            while len(out) > 0:
                yield handed()
        if rest is not None and rest.num_rows:
            cut(rest, True)
            yield handed()

    by = [*keys, "_curve", *coords, *tags]
    ordered = both.withColumn("_curve", curve).repartitionByRange(_tasks(both), *by).sortWithinPartitions(*by)
    ordered = ordered.select(*keys, *coords, "_left", "_right", *tags)
    return cut_lineage(ordered.mapInArrow(pack, schema)), count


def _turned(rows: DataFrame) -> DataFrame:
    """The leaves' rows with left as right and right as left."""
    other = {"_l": "_r", "_r": "_l"}
    sided = [c for c in rows.columns if c in ("_left", "_right", *COUNTS) or c[2:].startswith(("lo", "hi", "bound")) and c[:2] in other]
    turned = {c: {"_left": "_right", "_right": "_left"}.get(c, other[c[:2]] + c[2:]) for c in sided}
    # no copies are counted this way round: one right point is enough for k = 1
    turned |= {"_rcount": "_lcount", "_lcount": "_rcount", "_lweight": "_rcount", "_rweight": "_lcount"}
    return rows.select(*[F.col(turned.get(c, c)).alias(c) for c in rows.columns])


def _sides(blocks: DataFrame, count: int, keys: list[str], axes: int, leaf: int, leaves: DataFrame | None = None) -> tuple[boxes.Tree, boxes.Tree]:
    lo, hi = boxes.box_columns(axes, "")
    height = boxes._height(count, leaf)
    leaves = leaves if leaves is not None else cut_lineage(blocks.drop(*PACKED))

    def side(s, bound):
        return leaves.where(F.col(f"_{s}weight") > 0).select(
            *keys, "_node", *[F.col(f"_{s}{c}").alias(f"_{c}") for c in (*lo, *hi)], F.col(f"_{s}weight").alias("_weight"), bound.alias("_bound"))

    return (boxes.Tree(blocks, side("l", F.col("_lbound")), height), boxes.Tree(blocks, side("r", F.lit(float("inf"))), height))


def _trees(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], leaf: int, k: int,
           beyond: float | None = None) -> tuple[boxes.Tree, boxes.Tree]:
    """The trees of both sides' distinct points, without those of a null or NaN coordinate; items are the leaves' rows."""
    blocks, count = _leaves(left, right, keys, coords, leaf, k, beyond)
    return _sides(blocks, count, keys, len(coords), leaf)


def measured(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], k: int, limit: float | None, measure: Callable,
             columns: dict[str, str], leaf: int = LEAF, beyond: float | None = None, copies: str | None = None, tag: str | None = None) -> DataFrame:
    """Distinct left points with what measure makes of their k nearest right points (copies counted, within limit).
    copies names a column for the number of left rows a point stands for, so that none need be joined to it again; with a
    tag, a whole number of the left rows, there is one point per place and tag.

    measure(p, q, d, take) gets arrays: m points, their neighbours (m x k x axes) by distance and then coordinates, the
    distances and how many copies of each count (0: none there). It returns positions in p, one per row, and the columns'
    values. Left points with a key that has no right points are not asked about."""
    blocks, count = _leaves(left, right, keys, coords, leaf, k, beyond, tag)
    return _met(_sides(blocks, count, keys, len(coords), leaf), dict(left.dtypes), keys, coords, k, limit, measure, columns, copies, tag)


def _met(sides: tuple[boxes.Tree, boxes.Tree], given: dict[str, str], keys: list[str], coords: list[str], k: int, limit: float | None,
         measure: Callable, columns: dict[str, str], copies: str | None = None, tag: str | None = None) -> DataFrame:
    """measured for the two sides of packed leaves; given are the types of the left columns."""
    axes = len(coords)
    mine, theirs = sides
    pairs = boxes.near_leaves(mine, theirs, keys, axes, k, limit).where(F.col("_a") != F.col("_b"))
    carried = [c for c in (copies, tag) if c]
    lo, hi = boxes.box_columns(axes, "_a")
    kinds = dict(mine.items.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    comma = ", " if keys else ""

    def travel(batches) -> Iterator:
        """The points of b within reach of a's box."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            low, high = (np.stack([batch.column(c).to_numpy() for c in names], 1) for names in (lo, hi))
            reach = batch.column("_reach").to_numpy()[:, None]
            low, high = low - reach, high + reach
            kept, points, weights = [], [], []
            for i, (p, w) in enumerate(zip(batch.column("_points"), batch.column("_right"))):
                p, w = np.frombuffer(p.as_buffer()).reshape(-1, axes), np.frombuffer(w.as_buffer(), np.int64)
                close = (w > 0) & ((p >= low[i]) & (p <= high[i])).all(1)
                if close.any():
                    kept.append(i)
                    points.append(p[close].tobytes())
                    weights.append(w[close].tobytes())
            if kept:
                of = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [*[of.column(c) for c in keys], of.column("_a"), pa.array([1] * len(kept), pa.int32()), pa.array(points, pa.binary()),
                     pa.nulls(len(kept), pa.binary()), pa.array(weights, pa.binary()), pa.nulls(len(kept), pa.binary())],
                    names=[*keys, "_node", "_part", *PACKED])

    def meet(batches) -> Iterator:
        """Rows sorted by leaf, its own row first and then what travelled to it."""
        import numpy as np
        import pyarrow as pa

        state, out, size = None, [], 0

        def finish():
            nonlocal size
            current, key, *marks = state
            found = current.result()
            if found is None:
                return
            rows, values = measure(current.points, *found)
            if len(rows):
                p = current.points[rows]
                out.append([*[pa.repeat(v, len(rows)) for v in key], *[pa.array(p[:, c]) for c in range(axes)], *[pa.array(m[rows]) for m in marks], *[pa.array(v) for v in values]])
                size += len(rows)

        def handed():
            nonlocal size
            size = 0
            arrays = [pa.concat_arrays(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, *coords, *carried, *columns])

        for batch in batches:
            parts, lefts, rights, tags = (batch.column(c) for c in PACKED)
            own = batch.column("_part").to_numpy() == 0
            for i in range(batch.num_rows):
                p = np.frombuffer(parts[i].as_buffer()).reshape(-1, axes)
                w = np.frombuffer(rights[i].as_buffer(), np.int64)
                if own[i]:
                    if state is not None:
                        finish()
                    mine = np.frombuffer(lefts[i].as_buffer(), np.int64)
                    marks = [mine] * bool(copies) + ([np.frombuffer(tags[i].as_buffer(), np.int64)] if tag else [])
                    state = _Leaf(p[mine > 0], k, limit, p[w > 0], w[w > 0]), [batch.column(c)[i] for c in keys], *[m[mine > 0] for m in marks]
                else:
                    state[0].add(p, w)
                if size >= ROWS:
                    yield handed()
        if state is not None:
            finish()
        if out:
            yield handed()

    coming = pairs.select(*keys, "_a", "_b", "_reach", *lo, *hi).join(
        theirs.items.where("_rweight > 0").select(*keys, F.col("_node").alias("_b"), "_points", "_right"), [*keys, "_b"])
    coming = coming.mapInArrow(travel, f"{named}{comma}_node bigint, _part int, " + ", ".join(f"{c} binary" for c in PACKED))
    own = mine.items.where("_lcount > 0").select(*keys, "_node", F.lit(0).alias("_part"), *PACKED)
    rows = own.unionByName(coming).repartition(_tasks(own), *keys, "_node").sortWithinPartitions(*keys, "_node", "_part")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"{c} double" for c in coords] + [f"`{c}` bigint" for c in carried] + [f"{c} {t}" for c, t in columns.items()])
    found = rows.mapInArrow(meet, schema)
    tagged = [F.nullif(F.col(tag), F.lit(NO_TAG)).cast(given[tag]).alias(tag)] if tag else []
    return found.select(*keys, *[F.col(c).cast(given[c]).alias(c) for c in coords], *[c for c in carried if c != tag], *tagged, *columns)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], k: int = 1, limit: float | None = None,
            leaf: int = LEAF, copies: str | None = None) -> DataFrame:
    """For every distinct left point the k nearest right points (by number of copies) as rows n_<coord>, d, _take.

    With a limit, neighbours beyond it do not count and left points without one have no row; without one only keys
    without right points have no rows. Points with a null or NaN coordinate have none. Of equally near points those with
    the smaller coordinates are taken."""
    def rows(p, q, d, take):
        import numpy as np

        at, rank = np.nonzero(take)
        return at, [*q[at, rank].T, d[at, rank], take[at, rank]]

    names = [f"n_{c}" for c in coords]
    found = measured(left, right, keys, coords, k, limit, rows, {**{c: "double" for c in names}, "d": "double", "_take": "bigint"}, leaf, copies=copies)
    given = dict(right.dtypes)
    return found.withColumns({f"n_{c}": F.col(f"n_{c}").cast(given[c]) for c in coords})


def _least(p, q, d, take):
    import numpy as np

    at = np.flatnonzero(take[:, 0])
    return at, [d[at, 0]]


def distances(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], copies: str, leaf: int = LEAF) -> DataFrame:
    """The distinct left points with the distance d to the nearest right point and their copies: each left row with a whole
    position and a right point under its keys counts in one of them."""
    return measured(left, right, keys, coords, 1, None, _least, {"d": "double"}, leaf, copies=copies)


def mutual_distances(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], copies: str,
                     leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """distances from left to right and from right to left: both sides are packed once."""
    blocks, count = _leaves(left, right, keys, coords, leaf, 1, both_ways=True)
    boxed = cut_lineage(blocks.drop(*PACKED))
    there = _sides(blocks, count, keys, len(coords), leaf, boxed)
    back = _sides(_turned(blocks), count, keys, len(coords), leaf, _turned(boxed))
    return tuple(_met(sides, dict(given.dtypes), keys, coords, 1, None, _least, {"d": "double"}, copies)
                 for sides, given in ((there, left), (back, right)))


def exists(left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], radius: float, k: int = 1,
           leaf: int = LEAF, copies: str | None = None, tag: str | None = None) -> DataFrame:
    """The distinct left points with at least k right points (copies counted) within radius. Many find them in their own
    leaf; only the others look further. copies and tag as in measured."""
    def enough(p, q, d, take):
        import numpy as np

        return np.flatnonzero(take.sum(1) >= k), []

    return measured(left, right, keys, coords, k, radius, enough, {}, leaf, radius, copies, tag)
