"""Whitening of embedding vectors by Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

X holds the distinct vectors, centred. From a start v1 the steps a_k u_k = X v_k - b_(k-1) u_(k-1) and
b_k v_(k+1) = X' u_k - a_k v_k give a bidiagonal matrix whose singular values and vectors tend to those of X. A vector
u has one entry per row, so it is never kept: u_k = X w_k for a w_k as wide as a row, and every pass over the rows
computes X v_k and all earlier u at once. One pass per step gives X'X v_k, its products with the earlier u for full
reorthogonalisation, and so the next w and v; v are reorthogonalised on the driver, where they are as wide as a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import written

GRID = 256          # entries are counted in steps of 1 / GRID
BLOCK_BYTES = 4 << 20
_MOST = float(1 << 52)  # entries of larger size lose their fraction as doubles


@dataclass
class Whitening:
    """n fitted vectors, their per-dimension sums (exact), components as columns, eigenvalues, shares of the variance
    and the largest absolute entry of the whitened vectors' covariance minus the identity."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of lists hold finite numbers only, and those rows as whole numbers of 1 / GRID.

    Rows of another length than the first such row are an error: vectors of one table have one width."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
    lengths = np.maximum(sizes, 0)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[ends] == bad[ends - lengths])
    if not good.any():
        return good, np.zeros((0, 0), np.int64)
    widths = np.unique(sizes[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths[:5].tolist()}")
    inside = np.repeat(good, lengths)
    scaled = np.floor(values[inside].reshape(-1, widths[0]) * GRID)
    if np.abs(scaled).max() >= _MOST:
        raise ValueError(f"vector entries of {_MOST / GRID:g} or more in size")
    return good, scaled.astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest of three widths that holds it: equal rows give equal bytes."""
    most = np.abs(x).max(axis=1)
    out = np.empty(len(x), object)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 62)):
        rows = np.flatnonzero((most >= low) & (most < high))
        raw, wide = x[rows].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for k, row in enumerate(rows):
            out[row] = raw[k * wide:(k + 1) * wide]
    return out.tolist()


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    sizes = np.array([len(r) for r in rows]) // width
    out = np.empty((len(rows), width), np.int64)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        out[which] = np.frombuffer(b"".join(rows[k] for k in which), f"<i{size}").reshape(-1, width)
    return out


def distinct_vectors(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The distinct vectors of a column (array of float or double) as whole numbers, many packed into a row, and their
    width (0 if there are none). Vectors that are null, empty or hold null or non-finite entries are left out. Copies
    merge before they move; only packed vectors do."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, x = _matrix(batch.column(0))
                yield pa.record_batch([pa.array(_packed(x) if x.size else [], pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32))],
                                      names=["x", "width"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, width = [], 0, 0
        for batch in batches:
            for row, wide in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if width not in (0, wide):
                    raise ValueError(f"vectors of different widths: {width}, {wide}")
                rows.append(row)
                held, width = held + 8 * wide, wide
                if held >= BLOCK_BYTES:
                    yield _block(rows, width)
                    rows, held = [], 0
        if rows:
            yield _block(rows, width)

    one = vectors.select(column).filter(F.col(column).isNotNull()).mapInArrow(pack, "x binary, width int").distinct()
    blocks = written(one.mapInArrow(gather, "x binary, width int, size int"), "vectors")
    widths = blocks.agg(F.min("width").alias("least"), F.max("width").alias("most")).first()
    if widths.least != widths.most:
        raise ValueError(f"vectors of different widths: {widths.least}, {widths.most}")
    return blocks, widths.most or 0


def _block(rows: list[bytes], width: int) -> pa.RecordBatch:
    x = _unpacked(rows, width)
    most = int(np.abs(x).max(initial=0))
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return pa.record_batch([pa.array([x.astype(f"<i{size}").tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([size], pa.int32())],
                           names=["x", "width", "size"])


def _sum_over(blocks: DataFrame, width: int, count: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of of(rows), an array of count doubles: in each task first, then by entry."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count)
        for batch in batches:
            for raw, size in zip(batch.column("x"), batch.column("size").to_pylist(), strict=True):
                total += of(np.frombuffer(raw.as_buffer(), f"<i{size}").reshape(-1, width))
        yield pa.record_batch([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], names=["entry", "part"])

    parts = blocks.select("x", "size").mapInArrow(partial, "entry int, part double")
    total = np.zeros(count)
    for row in parts.groupBy("entry").agg(F.sum("part").alias("total")).collect():
        total[row.entry] = row.total
    return total


def _exact_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums per dimension, exact: high and low halves are summed apart."""
    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0, dtype=np.int64), (x & ((1 << 26) - 1)).sum(axis=0, dtype=np.int64)]).astype(float)

    total = _sum_over(blocks, width, 1 + 2 * width, halves)
    return int(total[0]), [(int(h) << 26) + int(lo) for h, lo in zip(total[1:width + 1], total[width + 1:], strict=True)]


def fit(vectors: DataFrame, column: str = "embedding", components: int = 4, seed: int = 11) -> Whitening:
    """The whitening of the distinct vectors of a column: each once, however often it occurs.

    Components are the unit eigenvectors of the covariance (divisor n, centred) by falling eigenvalue, at most components
    of them and none of eigenvalue 0 (below 1e-12 of the trace). Steps go on until their singular triples stand to double precision or
    the space is used up; where it falls apart (equal eigenvalues, few vectors) a new start orthogonal to all before
    goes on. Without vectors there are no components. The driver holds matrices as wide as a vector, nothing by row."""
    blocks, width = distinct_vectors(vectors, column)
    n, sums = _exact_sums(blocks, width) if width else (0, [])
    if not n:
        return Whitening(0, [], np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)
    mean = np.array([s / n for s in sums])
    left, alphas, betas, right, trace = _bidiagonalise(blocks, mean, n, components, seed)
    small = np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)
    _, singular, turned = np.linalg.svd(small)
    keep = [k for k in range(min(components, len(singular))) if singular[k] ** 2 > 1e-12 * trace]
    found = right[:, :len(alphas)] @ turned[keep].T
    found /= np.linalg.norm(found, axis=0)
    eigen = singular[keep] ** 2
    error = _identity_error(blocks, mean, n, found / np.sqrt(eigen)) if keep else 0.0
    return Whitening(n, sums, found, eigen, eigen / trace if keep else np.zeros(0), error)


def _bidiagonalise(blocks: DataFrame, mean: np.ndarray, n: int, wanted: int, seed: int) -> tuple:
    """w, the diagonal and the superdiagonal, v, and the trace of the covariance; rows count as divided by sqrt(n)."""
    width = len(mean)
    random = np.random.default_rng(seed)
    v = [_fresh(random, np.zeros((width, 0)))]
    w, back = np.zeros((width, 0)), np.zeros((width, 0))     # u_k = X w_k, and X' u_k
    alphas, betas, trace = [], [], None
    while True:
        k = len(alphas)
        ahead = np.column_stack([v[k], w])

        def products(x: np.ndarray, ahead: np.ndarray = ahead, k: int = k) -> np.ndarray:
            centred = x - mean
            y = centred @ ahead
            return np.concatenate([centred.T @ y[:, 0], y.T @ y[:, 0], [np.vdot(centred, centred) if k == 0 else 0.0]]) / n

        total = _sum_over(blocks, width, width + k + 2, products)
        pulled, square, along = total[:width], total[width], total[width + 1:width + 1 + k]
        if trace is None:
            trace = total[-1]
            if trace <= 0:
                return w, np.zeros(1), np.zeros(1), v[0][:, None], trace
        # u_k = (X v_k - sum of its parts along earlier u) / alpha
        alpha = np.sqrt(max(square - along @ along, 0.0))
        if alpha ** 2 <= 1e-26 * trace:
            alpha = 0.0
        u = (v[k] - w @ along) / alpha if alpha else np.zeros(width)
        pull = (pulled - back @ along) / alpha if alpha else np.zeros(width)
        alphas.append(alpha)
        w, back = np.column_stack([w, u]), np.column_stack([back, pull])
        basis = np.column_stack(v)
        if len(v) == width:
            betas.append(0.0)
            break
        rest = pull - basis @ (basis.T @ pull)
        rest -= basis @ (basis.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-14 * np.sqrt(trace):
            beta, rest = 0.0, _fresh(random, basis)
        betas.append(beta)
        if beta and _settled(np.array(alphas), np.array(betas), wanted):
            break
        v.append(rest / np.linalg.norm(rest))
    return w, np.array(alphas), np.array(betas), np.column_stack(v), trace


def _fresh(random: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    start = random.normal(size=len(basis))
    for _ in range(2):
        start -= basis @ (basis.T @ start)
    return start / np.linalg.norm(start)


def _settled(alphas: np.ndarray, betas: np.ndarray, wanted: int) -> bool:
    """Whether the wanted triples' residuals, the last beta times the last entry of their left vectors, lie within
    rounding, and one triple more exists to tell them from the rest."""
    if len(alphas) <= wanted + 1:
        return False
    left, singular, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1))
    return bool((betas[-1] * np.abs(left[-1, :wanted]) <= 1e-15 * singular[0]).all())


def _identity_error(blocks: DataFrame, mean: np.ndarray, n: int, map_: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, centred, minus the identity."""
    c = map_.shape[1]
    middle = _sum_over(blocks, len(mean), c, lambda x: ((x - mean) @ map_).sum(axis=0)) / n

    def squares(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ map_ - middle
        return (z.T @ z).ravel() / n

    return float(np.abs(_sum_over(blocks, len(mean), c * c, squares).reshape(c, c) - np.eye(c)).max())


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows of vectors whose column holds finite numbers only, once per component: component (from 1), n, deviation
    (sum over dimensions of (n x - S)^2, exact; null beyond a long), whitened, explained and identity_error are added,
    column goes. Other columns of the added names are replaced; repeated rows stay. No rows move."""
    added = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(),
             "identity_error": pa.float64()}
    columns = [c for c in vectors.columns if c not in {*added, column}]
    schema = vectors.select(columns).schema
    for name, kind in added.items():
        schema = schema.add(name, {"int32": "integer", "int64": "long", "double": "double"}[str(kind)])
    count = model.components.shape[1]
    map_ = model.components / np.sqrt(model.eigenvalues) if count else model.components
    sums = np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            good, x = _matrix(batch.column(column))
            rows = np.flatnonzero(good)
            if not len(rows):
                continue
            if x.shape[1] != len(sums):
                raise ValueError(f"vectors of {x.shape[1]} entries, fitted on {len(sums)}")
            z = (x - np.array([s / model.n for s in model.sums])) @ map_
            kept = batch.select(columns).take(pa.array(np.repeat(rows, count)))
            m = len(rows)
            new = [pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, model.n)),
                   pa.array(_deviations(x, model.n, sums)).take(pa.array(np.repeat(np.arange(m), count))), pa.array(z.ravel()),
                   pa.array(np.tile(model.explained, m)), pa.array(np.full(m * count, model.identity_error))]
            yield pa.record_batch([*kept.columns, *new], names=[*columns, *added])

    return vectors.select(*columns, column).filter(F.col(column).isNotNull()).mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    most = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        return pa.array(((n * x - sums.astype(np.int64)) ** 2).sum(axis=1))
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())
