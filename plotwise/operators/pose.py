"""The pose of a second view: matches filtered by epipolar consensus, a camera from points and pixels, else from pairs of points.

A group is the matches of one pair of photos, bounded by what a matcher gives for two images; pairs of photos are
spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .room import align_points
from .staging import staged

#: Gates (fixed values): pairs to filter, pairs to keep, pairs in space, camera inliers; pixels off an epipolar line and off a projection; metres; depths.
LEAST_TO_FILTER, LEAST_KEPT, LEAST_PAIRS, LEAST_INLIERS, LINE_PX, POINT_PX, WITHIN, NEAR, FAR = 40, 80, 40, 12, 3.0, 8.0, 0.12, 0.10, 40.0
_PIXELS, _SPACE, _CAMERA = ["u0", "v0", "u1", "v1"], ["ax", "ay", "az", "bx", "by", "bz"], ["fx", "fy", "cx", "cy"]


def _flat(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((*x.shape[:-1], 1))], -1)


def _scaling(x: np.ndarray) -> np.ndarray:
    """The map that takes points of the plane to mean 0 and mean distance sqrt 2."""
    mean = x.mean(0)
    s = np.sqrt(2) / max(float(np.linalg.norm(x - mean, axis=1).mean()), 1e-12)
    return np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrices of rank two with b' m a = 0 for eight or more matches, by stacks (..., n, 3)."""
    rows = (b[..., :, None] * a[..., None, :]).reshape(*a.shape[:-1], 9)
    m = np.linalg.svd(rows, full_matrices=rows.shape[-2] < rows.shape[-1])[2][..., -1, :].reshape(*a.shape[:-2], 3, 3)
    u, d, vt = np.linalg.svd(m)
    d[..., 2] = 0
    return (u * d[..., None, :]) @ vt


def line_distances(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far each match is from its epipolar lines (to first order), for a stack of matrices."""
    right, left = a @ np.swapaxes(m, -1, -2), b @ m
    scale = (right[..., :2] ** 2).sum(-1) + (left[..., :2] ** 2).sum(-1)
    return np.abs((right * b).sum(-1)) / np.sqrt(np.maximum(scale, 1e-18))


def epipolar_inliers(u0: np.ndarray, u1: np.ndarray, within: float = LINE_PX, rounds: int = 512, seed: int = 123) -> np.ndarray:
    """Which matches the geometry of two views that most agree with explains: eight matches a round, all are counted, the winner is fitted again."""
    rng = np.random.default_rng(seed)
    s, t = _scaling(u0), _scaling(u1)
    a, b = _flat(u0), _flat(u1)
    na, nb = a @ s.T, b @ t.T
    best = np.zeros(len(a), bool)
    for _ in range(rounds // 32):
        pick = rng.random((32, len(a))).argpartition(7, axis=1)[:, :8]
        ok = line_distances(t.T @ fundamental(na[pick], nb[pick]) @ s, a, b) < within
        k = int(ok.sum(1).argmax())
        best = ok[k] if ok[k].sum() > best.sum() else best
    if best.sum() >= 8:
        again = line_distances(t.T @ fundamental(na[best], nb[best]) @ s, a, b) < within
        best = again if again.sum() >= best.sum() else best
    return best


def _nearest_turn(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations nearest to matrices, and the scale between."""
    u, d, vt = np.linalg.svd(m)
    sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    u = u * np.stack([np.ones_like(sign), np.ones_like(sign), sign], -1)[..., None, :]
    return u @ vt, d.mean(-1)


def cameras_of(p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns and shifts that take points (..., n, 3) to directions (x, y, 1), from six or more, linear."""
    one, zero = _flat(p), np.zeros((*p.shape[:-1], 4))
    rows = np.concatenate([np.concatenate([one, zero, -x[..., :1] * one], -1), np.concatenate([zero, one, -x[..., 1:] * one], -1)], -2)
    m = np.linalg.svd(rows, full_matrices=rows.shape[-2] < rows.shape[-1])[2][..., -1, :].reshape(*p.shape[:-2], 3, 4)
    depth = (one @ m[..., 2, :, None])[..., 0]
    m = m * np.where(depth.sum(-1) < 0, -1.0, 1.0)[..., None, None]  # points are before the camera
    turn, scale = _nearest_turn(m[..., :3])
    return turn, m[..., 3] / np.maximum(scale, 1e-12)[..., None]


def _projected(p: np.ndarray, turn: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = p @ np.swapaxes(turn, -1, -2) + shift[..., None, :]
    return y[..., :2] / np.where(np.abs(y[..., 2:]) < 1e-9, 1e-9, y[..., 2:]), y


def refined(p: np.ndarray, x: np.ndarray, turn: np.ndarray, shift: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """A camera after some Gauss-Newton steps on the squared errors of its projections."""
    for _ in range(steps):
        at, y = _projected(p, turn, shift)
        z, q = y[:, 2], y - shift
        along = np.zeros((len(p), 2, 3))
        along[:, 0, 0] = along[:, 1, 1] = 1 / z
        along[:, :, 2] = -at / z[:, None]
        cross = np.zeros((len(p), 3, 3))  # how a small turn moves the turned point
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 2] = q[:, 2], -q[:, 1], q[:, 0]
        cross -= np.swapaxes(cross, 1, 2)
        by = np.concatenate([along @ cross, along], 2).reshape(-1, 6)
        w = np.linalg.lstsq(by, (x - at).ravel(), rcond=None)[0]
        size = np.linalg.norm(w[:3])
        k = np.cross(np.eye(3), w[:3] / size if size > 0 else w[:3])
        turn, shift = _nearest_turn((np.eye(3) + np.sin(size) * k + (1 - np.cos(size)) * k @ k) @ turn)[0], shift + w[3:]
    return turn, shift


def camera_by_consensus(p: np.ndarray, pixels: np.ndarray, focal: np.ndarray, centre: np.ndarray, within: float = POINT_PX, rounds: int = 1024, seed: int = 123):
    """Turn, shift and inliers of the camera that sees most points within some pixels of their places; None below LEAST_INLIERS."""
    rng, x = np.random.default_rng(seed), (pixels - centre) / focal

    def seen(turn, shift) -> np.ndarray:
        at, y = _projected(p, turn, shift)
        return (np.linalg.norm((at - x) * focal, axis=-1) < within) & (y[..., 2] > 0)

    best, ok = None, np.zeros(len(p), bool)
    for _ in range(rounds // 32):
        pick = rng.random((32, len(p))).argpartition(5, axis=1)[:, :6]
        turns, shifts = cameras_of(p[pick], x[pick])
        hits = seen(turns, shifts)
        k = int(hits.sum(1).argmax())
        if hits[k].sum() > ok.sum():
            best, ok = (turns[k], shifts[k]), hits[k]
    for _ in range(3):  # fitted to its inliers until these stay
        if ok.sum() < LEAST_INLIERS:
            return None
        best = refined(p[ok], x[ok], *best)
        ok = seen(*best)
    return (*best, ok) if ok.sum() >= LEAST_INLIERS else None


def two_view_pose(matches: DataFrame, key: str) -> DataFrame:
    """Where the second view of each pair of photos stands in the first one's frame: key, method, n_pairs, n_inliers, r, t, rmse.

    A match has pixels u0, v0, u1, v1, the points there in each view's own frame (ax, ay, az and bx, by, bz) and the second
    view's fx, fy, cx, cy. Of 40 or more matches those that epipolar consensus keeps go on, if they are 80 or more. Points must
    be finite and their depths strictly within 0.10 and 40 m; with fewer than 40 left a pair has no row. `camera` is a
    pose from the first view's points and the second's pixels (8 px, 12 inliers); where there is none, `points` is the
    rigid motion between both views' points (0.12 m). r and t take the second view's points to the first's; rmse is in metres
    over the inliers. A null key is a group of its own; matches with a null pixel are left out.
    """
    kind = dict(matches.dtypes)[key]
    columns = [key, *_PIXELS, *_SPACE, *_CAMERA]
    rows = matches.select(key, *[F.col(c).cast("double").alias(c) for c in columns[1:]]).dropna(subset=_PIXELS)

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values([*_PIXELS, *_SPACE], kind="stable")  # the same draws in whatever order matches come
        if len(rows) < LEAST_TO_FILTER:
            return rows
        ok = epipolar_inliers(rows[["u0", "v0"]].to_numpy(), rows[["u1", "v1"]].to_numpy())
        return rows[ok] if ok.sum() >= LEAST_KEPT else rows

    good = F.lit(True)
    for c in _SPACE:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    for c in ("az", "bz"):
        good = good & (F.col(c) > NEAR) & (F.col(c) < FAR)
    pairs = rows.groupBy(key).applyInPandas(kept, ", ".join([f"{key} {kind}", *[f"{c} double" for c in columns[1:]]])).where(good)
    n = pairs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= LEAST_PAIRS)
    pairs = staged(pairs.join(n, F.col(key).eqNullSafe(F.col("_key"))).drop("_key"), "matches")
    found = [key, "method", "n_pairs", "n_inliers", "r", "t", "rmse"]
    schema = f"{key} {kind}, method string, n_pairs long, n_inliers long, r array<double>, t array<double>, rmse double"

    def pose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values([*_PIXELS, *_SPACE], kind="stable")
        a, b = rows[_SPACE[:3]].to_numpy(), rows[_SPACE[3:]].to_numpy()
        focal, centre = rows[["fx", "fy"]].to_numpy()[0], rows[["cx", "cy"]].to_numpy()[0]
        got = camera_by_consensus(a, rows[["u1", "v1"]].to_numpy(), focal, centre) if np.isfinite([*focal, *centre]).all() else None
        if got is None:
            return pd.DataFrame(columns=found)
        turn, shift, ok = got
        r, t = turn.T, -turn.T @ shift
        rmse = float(np.sqrt((((b[ok] @ r.T + t) - a[ok]) ** 2).sum(1).mean()))
        return pd.DataFrame([[group[key].iloc[0], "camera", len(rows), int(ok.sum()), r.ravel().tolist(), t.tolist(), rmse]], columns=found)

    cameras = staged(pairs.groupBy(key).applyInPandas(pose, schema), "cameras")
    rest = pairs.join(cameras.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    back = rest.select(key, *[F.col(c).alias(d) for c, d in zip(_SPACE, [*_SPACE[3:], *_SPACE[:3]])])
    sizes = rest.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n_pairs"))
    points = align_points(back, key, within=WITHIN, rounds=2200, scaled=False).join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    return cameras.unionByName(points.withColumn("method", F.lit("points")).select(*found))
