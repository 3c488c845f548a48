"""Distances between triangle sets: pairs of triangles in numpy, bounding boxes in a tree, branch and bound over pairs of boxes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points to segments, row by row."""
    d = b - a
    long = _dot(d, d)
    t = np.clip(np.divide(_dot(p - a, d), long, out=np.zeros_like(long), where=long > 0), 0, 1)
    gap = p - a - t[..., None] * d
    return _dot(gap, gap)


def segment_segment(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances of segments: the common perpendicular where its feet lie on both, else the nearest of four ends."""
    out = np.minimum.reduce([point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b)])
    u, v, w = b - a, d - c, a - c
    uu, uv, vv, uw, vw = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w)
    area = uu * vv - uv * uv
    skew = area > 1e-12 * np.maximum(uu * vv, 1e-300)
    s = np.divide(uv * vw - vv * uw, area, out=np.full_like(area, -1.0), where=skew)
    t = np.divide(uu * vw - uv * uw, area, out=np.full_like(area, -1.0), where=skew)
    gap = w + s[..., None] * u - t[..., None] * v
    return np.where((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), np.minimum(out, _dot(gap, gap)), out)


def point_triangle(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of points to triangles (.., 3, 3): the plane where the foot lies inside, else the nearest edge."""
    a, b, c = t[..., 0, :], t[..., 1, :], t[..., 2, :]
    edges = np.minimum.reduce([point_segment(p, a, b), point_segment(p, b, c), point_segment(p, c, a)])
    n = np.cross(b - a, c - a)
    size = _dot(n, n)
    inside = np.logical_and.reduce([_dot(np.cross(y - x, p - x), n) >= 0 for x, y in ((a, b), (b, c), (c, a))]) & (size > 0)
    height = np.divide(_dot(p - a, n) ** 2, size, out=np.zeros_like(size), where=size > 0)
    return np.where(inside, height, edges)


def _crosses(p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether segments go through triangles."""
    a, b, c = t[..., 0, :], t[..., 1, :], t[..., 2, :]
    n = np.cross(b - a, c - a)
    over, under = _dot(p - a, n), _dot(q - a, n)
    opposite = (over * under <= 0) & (over != under)
    k = np.divide(over, over - under, out=np.zeros_like(over), where=opposite)
    x = p + k[..., None] * (q - p)
    inside = np.logical_and.reduce([_dot(np.cross(j - i, x - i), n) >= 0 for i, j in ((a, b), (b, c), (c, a))])
    return opposite & inside & (_dot(n, n) > 0)


def triangle_triangle(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of triangles (.., 3, 3), row by row; 0 where they meet."""
    turns = ((0, 1), (1, 2), (2, 0))
    parts = [segment_segment(s[..., i, :], s[..., j, :], t[..., k, :], t[..., m, :]) for i, j in turns for k, m in turns]
    parts += [point_triangle(s[..., i, :], t) for i in range(3)] + [point_triangle(t[..., i, :], s) for i in range(3)]
    meets = np.logical_or.reduce([_crosses(s[..., i, :], s[..., j, :], t) | _crosses(t[..., i, :], t[..., j, :], s) for i, j in turns])
    return np.where(meets, 0.0, np.minimum.reduce(parts))


class Boxes:
    """A tree of bounding boxes: halves by the median of the centres along the longest side, leaves of up to LEAF triangles."""

    def __init__(self, triangles: np.ndarray):
        self.triangles, self.nodes = triangles, []
        self._grow(np.arange(len(triangles)))

    def _grow(self, rows: np.ndarray) -> int:
        corners = self.triangles[rows]
        low, high = corners.min((0, 1)), corners.max((0, 1))
        at = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= LEAF:
            self.nodes[at] = (low, high, rows, ())
            return at
        centres = corners.mean(1)
        order = np.argsort(centres[:, int((high - low).argmax())], kind="stable")
        half = len(rows) // 2
        self.nodes[at] = (low, high, rows, (self._grow(rows[order[:half]]), self._grow(rows[order[half:]])))
        return at


def closest(s: Boxes, t: Boxes) -> float:
    """Squared distance of two triangle sets: pairs of boxes in order of their least distance, until none can be nearer than what is found."""
    def apart(i: int, j: int) -> float:
        (a, b, *_), (c, d, *_) = s.nodes[i], t.nodes[j]
        gap = np.maximum(np.maximum(a - d, c - b), 0)
        return float(gap @ gap)

    best, heap = np.inf, [(apart(0, 0), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound >= best:
            break
        mine, theirs = s.nodes[i], t.nodes[j]
        if not mine[3] and not theirs[3]:
            x, y = np.repeat(mine[2], len(theirs[2])), np.tile(theirs[2], len(mine[2]))
            best = min(best, float(triangle_triangle(s.triangles[x], t.triangles[y]).min()))
            continue
        parts = [(k, j) for k in mine[3]] if mine[3] and (not theirs[3] or len(mine[2]) >= len(theirs[2])) else [(i, k) for k in theirs[3]]
        for k, m in parts:
            if (d := apart(k, m)) < best:
                heapq.heappush(heap, (d, k, m))
    return best


def mesh_distances(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """faces(scene, object, corners of nine doubles) and pairs(scene, a, b) -> scene, a, b, distance. Each pair's two meshes meet in one task;
    an object without faces gives no row."""
    sides = pairs.select("scene", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("object"), F.lit(0).alias("side")), F.struct(F.col("b").alias("object"), F.lit(1).alias("side")))).alias("x")).select("scene", "a", "b", "x.*")
    rows = sides.join(faces, ["scene", "object"]).select("scene", "a", "b", "side", "corners")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if frame.side.nunique() < 2:
            return pd.DataFrame({"scene": [], "a": [], "b": [], "distance": []})
        s, t = (Boxes(np.stack(frame.corners[frame.side == k].to_numpy()).astype(float).reshape(-1, 3, 3)) for k in (0, 1))
        return frame.iloc[:1][["scene", "a", "b"]].assign(distance=closest(s, t) ** 0.5)

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("scene", "a", "b")) + ", distance double"
    return rows.groupBy("scene", "a", "b").applyInPandas(one, schema)


def camera_distances(faces: DataFrame, cameras: DataFrame) -> DataFrame:
    """faces(scene, object, corners) and cameras(scene, frame, x, y, z) -> scene, frame, object, distance of the nearest surface point."""
    def nearest(batches):
        for b in batches:
            t = np.stack(b.corners.to_numpy()).astype(float).reshape(-1, 3, 3) if len(b) else np.zeros((0, 3, 3))
            yield b[["scene", "frame", "object"]].assign(d=point_triangle(b[["x", "y", "z"]].to_numpy(float), t))

    met = faces.join(cameras, "scene")
    names = ("scene", "frame", "object")
    schema = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in names) + ", d double"
    return met.select(*names, "corners", "x", "y", "z").mapInPandas(nearest, schema).groupBy(*names).agg(F.sqrt(F.min("d")).alias("distance"))


def cloud_distances(points: DataFrame, share: float = 0.05) -> DataFrame:
    """points(scene, side 0 or 1, x, y, z) -> scene, distance: the quantile `share` of the distances of side 0's points to side 1's nearest."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame.loc[frame.side == k, ["x", "y", "z"]].to_numpy(float) for k in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame({"scene": [], "distance": []})
        b = b[np.argsort(b[:, 0])]
        best = np.full(len(a), np.inf)
        for i, p in enumerate(a):  # outward from the point's place in order of x, until x alone is further than the nearest
            at, reach = int(np.searchsorted(b[:, 0], p[0])), 64
            while True:
                lo, hi = max(0, at - reach), min(len(b), at + reach)
                gap = b[lo:hi] - p
                best[i] = min(best[i], float((gap * gap).sum(1).min()))
                left = lo == 0 or (p[0] - b[lo, 0]) ** 2 >= best[i]
                right = hi == len(b) or (b[hi - 1, 0] - p[0]) ** 2 >= best[i]
                if left and right:
                    break
                reach *= 2
        return pd.DataFrame({"scene": [frame.scene.iloc[0]], "distance": [float(np.quantile(best, share)) ** 0.5]})

    return points.groupBy("scene").applyInPandas(one, f"scene {points.schema['scene'].dataType.simpleString()}, distance double")
