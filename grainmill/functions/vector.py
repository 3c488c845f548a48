"""Vectors as lists of three columns: rigid transforms, projections, bearings. All but the canonical frame are plain expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def rigid(pose: list[list[float]], p: list[Column]) -> list[Column]:
    """A 3 x 4 pose applied to a point: rotation, then translation."""
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + r[3] for r in pose]


def inverse(pose: list[list[float]]) -> list[list[float]]:
    """The pose that undoes a rigid one: transposed rotation, translation turned back."""
    turn = [[pose[j][i] for j in range(3)] for i in range(3)]
    return [[*row, -sum(row[j] * pose[j][3] for j in range(3))] for row in turn]


def pinhole(p: list[Column], focal: float, centre: tuple[float, float]) -> tuple[Column, Column]:
    """Pixel of a point in camera axes; null at depth 0."""
    depth = F.nullif(p[2], F.lit(0.0))
    return centre[0] + focal * p[0] / depth, centre[1] + focal * p[1] / depth


def polar(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Distance, bearing and elevation in degrees."""
    flat = x * x + y * y
    return F.sqrt(flat + z * z), F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(flat)))


def quadrant(x: Column, y: Column, margin: float) -> Column:
    """front/back-left/right, null within `margin` degrees of an axis."""
    off = F.degrees(F.atan2(F.abs(y), F.abs(x)))
    name = F.concat(F.when(y > 0, "front").otherwise("back"), F.lit("-"), F.when(x > 0, "right").otherwise("left"))
    return F.when(F.least(off, 90 - off) > margin, name)


def _unit(v: list[Column]) -> list[Column]:
    size = F.nullif(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(0.0))
    return [x / size for x in v]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def rotation(r: list[Column]) -> list[list[Column]]:
    """The rotation of an axis-angle vector, the identity for a vector of length 0."""
    angle = F.sqrt(_dot(r, r))
    k = [F.coalesce(x, F.lit(0.0)) for x in _unit(r)]
    c, s = F.cos(angle), F.sin(angle)
    skew = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    return [[(c if i == j else F.lit(0.0)) + (1 - c) * k[i] * k[j] + s * skew[i][j] for j in range(3)] for i in range(3)]


def camera_to_world(r: list[Column], t: list[Column]) -> list[list[Column]]:
    """The 3 x 4 pose that undoes a world-to-camera axis-angle and translation."""
    m = rotation(r)
    return [[m[0][i], m[1][i], m[2][i], -(m[0][i] * t[0] + m[1][i] * t[1] + m[2][i] * t[2])] for i in range(3)]


@F.pandas_udf(ArrayType(DoubleType()))
def canonical_frame(pose: pd.Series, up: pd.Series) -> pd.Series:
    """The 3 x 4 transform, row by row, to axes with the camera of a 3 x 4 pose (row by row) at the origin, +Z up and +Y its heading; a
    camera that looks along the vertical gives its heading by its right axis. Null where neither axis has a horizontal part, or the
    pose or up is null, not finite or of another length. numpy, since one nested expression would repeat its parts thousands of times."""
    sound = [p is not None and u is not None and len(p) == 12 and len(u) == 3 for p, u in zip(pose, up, strict=True)]
    out = pd.Series([None] * len(pose), dtype=object)
    if any(sound):
        told, usable = _frames(np.array([list(p) for p, ok in zip(pose, sound, strict=True) if ok], float).reshape(-1, 3, 4), np.array([list(u) for u, ok in zip(up, sound, strict=True) if ok], float))
        for i, rows, ok in zip(np.flatnonzero(sound), told, usable, strict=True):
            out.iloc[i] = rows.ravel().tolist() if ok else None
    return out


def _frames(poses: np.ndarray, ups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3 x 4 transforms, whether each is defined) of a batch. The heading is the view's shadow on the horizontal plane; where it has none,
    the heading to which the right axis' shadow is perpendicular."""
    finite = np.isfinite(poses).all((1, 2)) & np.isfinite(ups).all(1)
    poses, ups = (np.where(finite.reshape(-1, *(1,) * (x.ndim - 1)), x, 1.0) for x in (poses, ups))
    length = np.linalg.norm(ups, axis=1, keepdims=True)
    z = ups / np.maximum(length, 1e-300)
    onto_plane = np.eye(3) - z[:, :, None] * z[:, None, :]
    shadows = np.einsum("nij,njk->nik", onto_plane, poses[:, :, :3])
    view, side = shadows[:, :, 2], np.cross(z, shadows[:, :, 0])
    heading = np.where(np.linalg.norm(view, axis=1, keepdims=True) > 1e-6, view, side)
    size = np.linalg.norm(heading, axis=1, keepdims=True)
    y = heading / np.maximum(size, 1e-300)
    turn = np.stack([np.cross(y, z), y, z], axis=1)
    moved = -np.einsum("nij,nj->ni", turn, poses[:, :, 3])
    return np.concatenate([turn, moved[:, :, None]], axis=2), finite & (length[:, 0] >= 1e-8) & (size[:, 0] > 1e-6)
