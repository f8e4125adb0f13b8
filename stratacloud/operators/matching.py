"""Points packed once for a loop that matches them anew in every iteration: no iteration moves a point.

A row holds points of one group as arrays, and either the target points they can reach too, or the tasks share one small
target. Groups are numbered and few enough for the driver to hold their poses: an iteration sends these
to the rows and gets one row of sums back per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions import blocks, near
from stratacloud.functions.geometry import apply_pose
from stratacloud.functions.matrices import motion_matrix, nearest_rotation
from stratacloud.session import cut_lineage

XYZ = ["x", "y", "z"]
PACKED = 1 << 12        # points of a group in a row where the tasks share the target
EDGES = (8, 4)          # edge of a block in matching distances
CROWD = 1 << 22         # rows of one block that meet in a task
FEW_POSES = 1 << 17     # groups whose poses the driver holds and sends to every task
UPPER = [(i, j) for i in range(6) for j in range(i, 6)]


def by_group(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one group's points each, in any number of rows: _points and their _copies."""
    kinds = dict(points.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["_points binary", "_copies binary"])

    def pack(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in XYZ], 1)
            group = batch.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(p), int)
            order = np.argsort(group, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
            starts = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(start, np.r_[start[1:], len(p)])])
            pieces = [blocks.merged(p[rows], np.ones(len(rows), np.int64)) for rows in np.split(order, starts[1:])]
            first = batch.take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays(
                [*[first.column(k) for k in keys], pa.array([q.tobytes() for q, _ in pieces], pa.binary()), pa.array([w.tobytes() for _, w in pieces], pa.binary())],
                names=[*keys, "_points", "_copies"])

    rows = points.where(blocks.finite(points, keys, XYZ)).select(*keys, *[F.col(a).cast("double").alias(a) for a in XYZ])
    ordered = rows.repartitionByRange(near._tasks(rows), *keys, *XYZ).sortWithinPartitions(*keys, *XYZ)
    return cut_lineage(ordered.mapInArrow(pack, schema))


def edge_for(source: DataFrame, target: DataFrame, keys: list[str], distance: float) -> float | None:
    """The edge of blocks that a task can hold; None if there is none."""
    for factor in EDGES:
        if all(blocks.crowd(side.where(blocks.finite(side, keys, XYZ)), keys, XYZ, factor * distance) <= CROWD for side in (source, target)):
            return factor * distance
    return None


def by_block(source: DataFrame, poses: DataFrame, target: DataFrame, keys: list[str], facing: list[str], edge: float, reach: float) -> DataFrame:
    """Rows of one block's source points under their group's pose, held as they were before it, with all target points
    within reach of the block: _points, _copies, _target."""
    given = [f"_o{a}" for a in XYZ]
    rows = source.where(blocks.finite(source, keys, XYZ)).select(*keys, *[F.col(a).cast("double").alias(o) for a, o in zip(XYZ, given)])
    rows = rows.join(F.broadcast(poses), keys)
    rows = rows.select(*keys, *[c.alias(a) for a, c in zip(XYZ, apply_pose("T", [F.col(o) for o in given]))], *given)
    places = target.where(blocks.finite(target, keys, XYZ)).select(*keys, *XYZ, *facing)

    def solve(mine, theirs, block):
        if not len(mine[0]) or not len(theirs[0]):
            return None
        return [mine[0][:, 3:].tobytes(), mine[1].tobytes(), theirs[0].tobytes()]

    dealt = [blocks.deal(rows, keys, XYZ, edge, 0.0, tuple(given)), blocks.deal(places, keys, XYZ, edge, reach, tuple(facing))]
    columns = dict.fromkeys(("_points", "_copies", "_target"), "binary")
    return cut_lineage(blocks.solved(dealt, keys, XYZ, solve, columns, (tuple(given), tuple(facing))))


def sums(packed: DataFrame, poses: np.ndarray, origins: np.ndarray, distance: float, plane: bool, robust: float | None, shared=None) -> np.ndarray:
    """Per group (numbered _g) the sums of its matches within distance under its pose, in one pass: copies matched, their
    squared distances, and the normal equations of a small motion (Tukey weights at robust) or, to points, the sums and
    products about the group's origin. shared is a target of near.few_places."""
    width = 6 if plane else 3
    columns = [f"_s{k}" for k in range(2 + (len(UPPER) + 6 if plane else 15))]
    state = packed.sparkSession.sparkContext.broadcast((poses, origins))

    def meet(batches) -> Iterator:
        import pyarrow as pa

        poses, origins = state.value
        grid, places = None, None
        if shared is not None:
            places = shared.value
            grid = near._Grid(places[:, :3], distance)
        for batch in batches:
            group = batch.column("_g").to_numpy()
            out = {}
            for i in range(batch.num_rows):
                p = np.frombuffer(batch.column("_points")[i].as_buffer()).reshape(-1, 3)
                w = np.frombuffer(batch.column("_copies")[i].as_buffer(), np.int64)
                if shared is None:
                    places = np.frombuffer(batch.column("_target")[i].as_buffer()).reshape(-1, width)
                    places = places[np.r_[True, (places[1:, :3] != places[:-1, :3]).any(1)]]
                    grid = near._Grid(places[:, :3], distance)
                t = poses[group[i]]
                moved = np.stack([t[4 * k] * p[:, 0] + t[4 * k + 1] * p[:, 1] + t[4 * k + 2] * p[:, 2] + t[4 * k + 3] for k in range(3)], 1)
                best, d = grid.nearest(moved)
                found = np.isfinite(d)
                if found.any():
                    mine = np.array(_sums(moved[found], places[best[found]], d[found], w[found].astype(float), origins[group[i]], plane, robust))
                    out[group[i]] = out.get(group[i], 0) + mine
            if out:
                numbers = np.array(list(out.values()))
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *[pa.array(numbers[:, k]) for k in range(len(columns))]], names=["_g", *columns])

    schema = ", ".join(["_g bigint"] + [f"{c} double" for c in columns])
    found = packed.mapInArrow(meet, schema).groupBy("_g").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    state.destroy()
    whole = np.zeros((len(poses), len(columns)))
    whole[found["_g"].to_numpy(int)] = found[columns].to_numpy(float)
    return whole


def _sums(p, places, d, w, origin, plane: bool, robust: float | None) -> list:
    q, head = places[:, :3], [w.sum(), (w * d * d).sum()]
    if plane:
        n = places[:, 3:]
        r = ((p - q) * n).sum(1)
        f = np.c_[np.cross(p, n), n]
        if robust is not None:
            u = r / robust
            w = w * np.where(np.abs(u) < 1, (1 - u * u) * (1 - u * u), 0.0)
        a, b = f.T @ (f * w[:, None]), f.T @ (w * -r)
        return [*head, *[a[i, j] for i, j in UPPER], *b]
    s, t = p - origin, q - origin
    return [*head, *(w @ s), *(w @ t), *((t * w[:, None]).T @ s).ravel()]


def plane_steps(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups with at least six matches, and the small motion of each (least-norm where the sums leave it open)."""
    which = np.flatnonzero(sums[:, 0] >= 6)
    a = np.zeros((len(which), 6, 6))
    for k, (i, j) in enumerate(UPPER):
        a[:, i, j] = a[:, j, i] = sums[which, 2 + k]
    b = sums[which, 2 + len(UPPER):]
    sound = np.linalg.cond(a) < 1e10 if len(which) else np.zeros(0, bool)
    step = np.zeros((len(which), 6))
    step[sound] = np.linalg.solve(a[sound], b[sound][..., None])[..., 0]
    for k in np.flatnonzero(~sound):
        step[k] = np.linalg.lstsq(a[k], b[k], rcond=None)[0]
    return which, np.array([motion_matrix(s) for s in step]).reshape(-1, 4, 4)


def point_steps(sums: np.ndarray, origins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups with matches, and the rigid motion that takes each one's points onto their matches."""
    which = np.flatnonzero(sums[:, 0] > 0)
    n, o = sums[which, 0][:, None], origins[which]
    s, t, h = sums[which, 2:5], sums[which, 5:8], sums[which, 8:].reshape(-1, 3, 3)
    turn = nearest_rotation(h - t[:, :, None] * s[:, None, :] / n[..., None])[0]
    out = np.zeros((len(which), 4, 4))
    out[:, 3, 3] = 1
    out[:, :3, :3], out[:, :3, 3] = turn, o + t / n - (turn @ (o + s / n)[..., None])[..., 0]
    return which, out
