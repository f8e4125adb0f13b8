"""View selection: source views and best view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.geometry import project_normalised
from stratacloud.functions.near import _tasks
from stratacloud.operators.fit import join_keys
from stratacloud.operators.sync import SOURCE_ANGLE_RANGE, SOURCE_MAX_OFF_AXIS, SOURCE_TARGET_ANGLE
from stratacloud.session import cut_lineage

BLOCKS = 64                                 # blocks of views aimed at, so that few views still spread over the tasks
LEAST_BLOCK, MOST_BLOCK = 256, 4096         # views in a block
TOGETHER = 32                               # references that meet a block in one step
FRAMES = 64                                 # frames that meet the sample of best_view in one step
HELD = 1 << 18                              # pairs a block of references holds before it keeps the best only

def ranked_sources(views: DataFrame, n: int, depth: float, keys: list[str]) -> DataFrame:
    """See sync.source_views. Views lie in blocks of arrays dealt by name; every block of references meets every block of
    its key as matrices, one after the other, and keeps the n best of each reference, so no row per pair is made."""
    count = views.count()
    size = min(max(count // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    places = ["cx", "cy", "cz", "ax", "ay", "az"]
    dealt = F.pmod(F.xxhash64("name"), F.greatest(F.ceil(F.col("_n") / size), F.lit(1)))
    counts = views.groupBy(*keys).agg(F.count("*").alias("_n"))
    mate = F.coalesce("partner", "name").alias("partner")       # a view does not pair up with itself
    placed = join_keys(views.where(F.col("name").isNotNull()).select(
        *keys, "name", mate, *[F.col(c).cast("double").alias(c) for c in places]), counts, keys)
    blocks = cut_lineage(placed.withColumn("_block", dealt).groupBy(*keys, "_block").agg(
        F.collect_list(F.struct("name", "partner", *places)).alias("_views")))
    coming = join_keys(blocks.select(*keys, F.col("_block").alias("_part"), "_views"), blocks.select(*keys, "_block"), keys)
    own = blocks.select(*keys, "_block", F.lit(-1).cast("long").alias("_part"), "_views")
    rows = own.unionByName(coming.select(*own.columns)).repartition(_tasks(own), *keys, "_block").sortWithinPartitions(*keys, "_block", "_part")
    kinds = dict(views.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"name {kinds['name']}", "rank bigint", f"other {kinds['name']}", "angle double"])

    def meet(batches):
        """Rows sorted by block, its own row first and then all blocks of its key."""
        import pyarrow as pa

        def unpacked(row):
            column = row.values.flatten()
            names = [column[k].to_numpy(zero_copy_only=False) for k in (0, 1)]
            return names, [column[k + 2].to_numpy(zero_copy_only=False) for k in range(6)]

        state = None

        def finish():
            at, rank, other, angle = state[0].result()
            return pa.RecordBatch.from_arrays([*[pa.repeat(k, len(at)) for k in state[1]], *[
                pa.array(v, t) for v, t in zip((state[0].names[at], rank, other, angle), (state[2], pa.int64(), state[2], pa.float64()))]],
                names=[*keys, "name", "rank", "other", "angle"])

        for batch in batches:
            part, packed = batch.column("_part").to_numpy(), batch.column("_views")
            for i in range(batch.num_rows):
                names, values = unpacked(packed[i])
                if part[i] < 0:
                    if state is not None:
                        yield finish()
                    state = _Sources(names, values, n, depth), [batch.column(k)[i] for k in keys], packed.type.value_type.field(0).type
                else:
                    state[0].add(names[0], values)
        if state is not None:
            yield finish()

    return rows.mapInArrow(meet, schema)


class _Sources:
    """The references of one block and their best sources met so far. Two views form a pair by plain steps on their own
    numbers, so copies of a view come out equal to the last digit and the name decides."""

    def __init__(self, names, values, n: int, depth: float):
        import numpy as np

        self.names, self.partners = names
        self.n = n
        self.target = [c + depth * a for c, a in zip(values[:3], values[3:])]
        self.back = [c - t for c, t in zip(values[:3], self.target)]
        self.length = np.sqrt(self.back[0] * self.back[0] + self.back[1] * self.back[1] + self.back[2] * self.back[2])
        self.bound = np.full(len(self.names), np.inf)       # a source that turns further off than this is not among the n
        self.kept, self.met, self.held = None, [], 0

    def _pairs(self, left, right):
        import pandas as pd

        found = pd.DataFrame({"v": left, "i": range(len(left))}).merge(pd.DataFrame({"v": right, "j": range(len(right))}), on="v")
        return found["i"].to_numpy(), found["j"].to_numpy()

    def add(self, others, values) -> None:
        import numpy as np

        low, high = SOURCE_ANGLE_RANGE
        mate = self._pairs(self.partners, others)
        same = self._pairs(self.names, others)
        with np.errstate(all="ignore"):
            for start in range(0, len(self.names), TOGETHER):
                rows = slice(start, start + TOGETHER)
                o = [v[None, :] - t[rows, None] for v, t in zip(values[:3], self.target)]
                far = np.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])
                cosine = (self.back[0][rows, None] * o[0] + self.back[1][rows, None] * o[1] + self.back[2][rows, None] * o[2]) \
                    / self.length[rows, None] / far
                wide = np.minimum(self.bound[rows], high - low)
                near = np.cos(np.radians(np.maximum(SOURCE_TARGET_ANGLE - wide, low))) + 1e-9
                rim = np.cos(np.radians(np.minimum(SOURCE_TARGET_ANGLE + wide, high))) - 1e-9
                open_ = (cosine <= near[:, None]) & (cosine >= rim[:, None])
                mated = (mate[0] >= start) & (mate[0] < start + TOGETHER)
                open_[mate[0][mated] - start, mate[1][mated]] = True
                alike = (same[0] >= start) & (same[0] < start + TOGETHER)
                open_[same[0][alike] - start, same[1][alike]] = False
                at, j = np.nonzero(open_)
                angle = np.degrees(np.arccos(np.clip(cosine[at, j], -1, 1)))
                facing = -(o[0][at, j] * values[3][j] + o[1][at, j] * values[4][j] + o[2][at, j] * values[5][j]) / far[at, j]
                off_axis = np.degrees(np.arccos(np.clip(facing, -1, 1)))
                turn = np.abs(angle - SOURCE_TARGET_ANGLE)
                paired = self.partners[at + start] == others[j]
                good = (angle >= low) & (angle <= high) & (off_axis <= SOURCE_MAX_OFF_AXIS) & (paired | (turn <= self.bound[at + start]))
                if good.any():
                    self.met.append((at[good] + start, ~paired[good], turn[good], others[j[good]], angle[good]))
                    self.held += int(good.sum())
                if self.held > HELD:
                    self.settle()

    def settle(self) -> None:
        import numpy as np

        met = ([] if self.kept is None else [self.kept]) + self.met
        if not met:
            return
        at, apart, turn, other, angle = (np.concatenate([m[k] for m in met]) for k in range(5))
        place = np.unique(other, return_inverse=True)[1]
        order = np.lexsort((place, turn, apart, at))
        at, apart, turn, other, angle = (v[order] for v in (at, apart, turn, other, angle))
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        best = rank < self.n
        last = rank == self.n - 1
        self.bound[at[last]] = turn[last]
        self.kept, self.rank, self.met, self.held = tuple(v[best] for v in (at, apart, turn, other, angle)), rank[best], [], 0

    def result(self):
        """Position of the reference, rank from 1, source and angle."""
        self.settle()
        if self.kept is None:
            return [], [], [], []
        at, _, _, other, angle = self.kept
        return at, self.rank + 1, other, angle


def best_view(points: DataFrame, poses: DataFrame, k: tuple, d: tuple, size: tuple, samples: int) -> DataFrame:
    """The posed frame that sees a fixed-size sample of the points best: frames with any sampled point behind them are
    out; then the largest share inside the image, then the median pixel nearest the image centre.

    The sample (the operator's own feature) is the `samples` rows with the smallest coordinate hash, so it is bounded
    by a parameter and travels with the tasks; a batch of frames meets it as matrices, so no row per frame and sample is
    made. Poses with a null or NaN entry see nothing and are out."""
    sample = points.select("x", "y", "z").withColumn("_h", F.xxhash64("x", "y", "z")).orderBy("_h", "x", "y", "z").limit(samples)
    taken = [(r["x"], r["y"], r["z"]) for r in sample.collect()]

    def see(batches):
        import numpy as np

        nothing = float("nan")
        x, y, z = (np.array([nothing if p[a] is None else p[a] for p in taken], float)[None, :] for a in range(3))
        asked = ~(np.isnan(x) | np.isnan(y) | np.isnan(z))[0]
        x, y, z = x[:, asked], y[:, asked], z[:, asked]
        for batch in batches:
            batch = batch[[t is not None and len(t) >= 12 for t in batch["T"]]]
            for start in range(0, len(batch), FRAMES):
                part = batch.iloc[start:start + FRAMES]
                t = np.stack([np.asarray(m, float)[:12] for m in part["T"]])[:, :, None]
                depth = t[:, 8] * x + t[:, 9] * y + t[:, 10] * z + t[:, 11]
                front = (depth > 0).all(1) if x.size else np.zeros(len(part), bool)
                if not front.any():
                    continue
                t, depth = t[front], depth[front]
                a = (t[:, 0] * x + t[:, 1] * y + t[:, 2] * z + t[:, 3]) / depth
                b = (t[:, 4] * x + t[:, 5] * y + t[:, 6] * z + t[:, 7]) / depth
                u, v = project_normalised(a, b, k, d)
                inside = ((u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1])).mean(1)
                off = np.hypot(np.median(u, 1) - size[0] / 2, np.median(v, 1) - size[1] / 2)
                yield part[["frame"]][front].assign(inside=inside, off_centre=off)

    seen = poses.select("frame", "T").mapInPandas(see, f"frame {dict(poses.dtypes)['frame']}, inside double, off_centre double")
    return seen.orderBy(F.desc("inside"), "off_centre", "frame").limit(1)
