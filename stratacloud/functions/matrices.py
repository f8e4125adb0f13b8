"""Small-matrix work on rows that built-in aggregates have already reduced: one 3x3 or 6x6 problem per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def _stack(series: pd.Series, *shape: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in series], dtype=float).reshape(-1, *shape)


def _rows(a: np.ndarray) -> pd.Series:
    return pd.Series(list(a.reshape(len(a), -1)))


def nearest_rotation(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation R maximising trace(R H) for a stack of H = sum(target source^T), and the signed singular values."""
    u, s, vt = np.linalg.svd(cross)
    sign = np.sign(np.linalg.det(u @ vt))
    sign[sign == 0] = 1.0
    fix = np.ones((len(cross), 3))
    fix[:, 2] = sign
    return (u * fix[:, None, :]) @ vt, s * fix


@F.pandas_udf(DOUBLES)
def rotation_from_cross(cross: pd.Series) -> pd.Series:
    """Nine cross-covariance sums (target x source, row-major) to nine rotation entries plus the signed trace."""
    if len(cross) == 0:
        return pd.Series([], dtype=object)
    rotation, s = nearest_rotation(_stack(cross, 3, 3))
    return _rows(np.concatenate([rotation.reshape(-1, 9), s.sum(1)[:, None]], axis=1))


@F.pandas_udf(DOUBLES)
def symmetric_eigen(sums: pd.Series) -> pd.Series:
    """Six entries (xx, xy, xz, yy, yz, zz) to three ascending eigenvalues and the three eigenvectors, each in turn.
    Every vector's largest component is positive, so the sign does not depend on the solver."""
    if len(sums) == 0:
        return pd.Series([], dtype=object)
    s = _stack(sums, 6)
    m = s[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(m)
    axes = np.swapaxes(vectors, 1, 2)
    lead = np.take_along_axis(axes, np.abs(axes).argmax(2)[:, :, None], axis=2)
    axes = axes * np.where(lead < 0, -1.0, 1.0)
    return _rows(np.concatenate([values, axes.reshape(-1, 9)], axis=1))


@F.pandas_udf(DOUBLES)
def solve_normal(matrix: pd.Series, right: pd.Series) -> pd.Series:
    """Solution of A x = b for A (m x m, row-major) and b; the least-norm one where A is singular."""
    out = []
    for a, b in zip(matrix, right):
        b = np.asarray(b, dtype=float)
        a = np.asarray(a, dtype=float).reshape(len(b), len(b))
        out.append(np.linalg.lstsq(a, b, rcond=None)[0])
    return pd.Series(out)


def rotation_vector_matrix(r: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector (axis times angle)."""
    angle = np.linalg.norm(r)
    if angle < 1e-15:
        return np.eye(3)
    k = r / angle
    skew = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * skew + (1 - np.cos(angle)) * skew @ skew


def motion_matrix(step: np.ndarray) -> np.ndarray:
    """4x4 rigid motion of (rx, ry, rz, tx, ty, tz)."""
    out = np.eye(4)
    out[:3, :3] = rotation_vector_matrix(np.asarray(step[:3], dtype=float))
    out[:3, 3] = step[3:]
    return out


@F.pandas_udf(DOUBLES)
def motion_pose(step: pd.Series) -> pd.Series:
    """Small motions (rx, ry, rz, tx, ty, tz) to row-major 4x4 poses."""
    return pd.Series([motion_matrix(np.asarray(s, dtype=float)).ravel() for s in step])


@F.pandas_udf(DOUBLES)
def schur_term(pp: pd.Series, pq: pd.Series, qq: pd.Series) -> pd.Series:
    """Pp - Pq Qq^-1 Pq^T of one frame: the parameter block with the frame's pose block eliminated."""
    out = []
    for p, c, q in zip(pp, pq, qq):
        q = np.asarray(q, dtype=float).reshape(6, 6)
        p = np.asarray(p, dtype=float)
        m = int(round(len(p) ** 0.5))
        c = np.asarray(c, dtype=float).reshape(m, 6)
        out.append((p.reshape(m, m) - c @ np.linalg.solve(q, c.T)).ravel())
    return pd.Series(out)


@F.pandas_udf(DOUBLES)
def inverse_matrix(matrix: pd.Series) -> pd.Series:
    out = []
    for a in matrix:
        a = np.asarray(a, dtype=float)
        m = int(round(len(a) ** 0.5))
        out.append(np.linalg.inv(a.reshape(m, m)).ravel())
    return pd.Series(out)
