"""Two-view poses: known cameras, wrong matches, flat scenes, gates and odd rows."""

import numpy as np
import pytest

from plotwise.operators import pose

NAMES = "k long, u0 double, v0 double, u1 double, v1 double, ax double, ay double, az double, bx double, by double, bz double, fx double, fy double, cx double, cy double"
ANGLE = 0.3
TURN = np.array([[np.cos(ANGLE), 0.0, np.sin(ANGLE)], [0.0, 1.0, 0.0], [-np.sin(ANGLE), 0.0, np.cos(ANGLE)]])
SHIFT = np.array([0.4, -0.1, 0.2])


def matches(n: int, wrong: float, key=1, flat: bool = False, noise: float = 0.0, seed: int = 2):
    """Matches of a camera whose points go to the first view by TURN and SHIFT; the first ones are wrong in pixels and in space."""
    rng = np.random.default_rng(seed)
    b = rng.uniform((-2, -1.5, 3), (2, 1.5, 7), (n, 3))
    if flat:
        b[:, 2] = 5.0
    a = b @ TURN.T + SHIFT
    u0, u1 = (500 * p[:, :2] / p[:, 2:] + 400 + rng.normal(0, noise, (n, 2)) for p in (a, b))
    bad = int(n * wrong)
    u1[:bad] += rng.uniform(40, 300, (bad, 2))
    b[:bad] += rng.uniform(0.5, 2, (bad, 3))
    return [(key, *map(float, (*u0[i], *u1[i], *a[i], *b[i], 500, 500, 400, 400))) for i in range(n)]


def test_known_cameras_with_two_wrong_matches_in_five(spark):
    rows = matches(200, 0.4) + matches(150, 0.4, key=2, noise=0.5, seed=3) + matches(120, 0.0, key=None, seed=4) + matches(39, 0.0, key=5)
    got = {r.k: r for r in pose.two_view_pose(spark.createDataFrame(rows, NAMES).repartition(5), "k").collect()}
    assert set(got) == {1, 2, None} and all(r.method == "camera" for r in got.values())  # 39 matches are too few
    assert (got[1].n_inliers, got[None].n_inliers, got[None].n_pairs) == (120, 120, 120) and got[2].n_inliers >= 85
    for k, within in ((1, 1e-6), (None, 1e-6), (2, 0.02)):
        assert np.allclose(np.reshape(got[k].r, (3, 3)), TURN, atol=within) and np.allclose(got[k].t, SHIFT, atol=within)
    assert got[1].rmse < 1e-6


def test_without_a_camera_the_points_decide(spark):
    rows = [(*r[:11], None, None, None, None) for r in matches(100, 0.3)] + [(2, *r[1:]) for r in matches(60, 0.0, flat=True)]
    got = {r.k: r for r in pose.two_view_pose(spark.createDataFrame(rows, NAMES), "k").collect()}
    assert got[1].method == "points" and got[1].n_inliers == 70
    for r in got.values():  # a plane leaves the linear camera open, points do not
        assert np.allclose(np.reshape(r.r, (3, 3)), TURN, atol=1e-4) and np.allclose(r.t, SHIFT, atol=1e-3)


def test_odd_rows(spark):
    good = matches(60, 0.0)
    odd = [(1, None, *good[0][2:]), (1, *good[1][1:5], float("nan"), *good[1][6:]), (1, *good[2][1:7], 40.0, *good[2][8:]), (1, *good[3][1:10], 0.05, *good[3][11:])]
    got = pose.two_view_pose(spark.createDataFrame(good + odd + good[:2], NAMES), "k").collect()
    assert [(r.n_pairs, r.n_inliers) for r in got] == [(62, 62)]
    assert pose.two_view_pose(spark.createDataFrame([], NAMES), "k").collect() == []


def test_epipolar_lines_tell_wrong_matches():
    rows = np.array([r[1:5] for r in matches(300, 0.4)])
    ok = pose.epipolar_inliers(rows[:, :2], rows[:, 2:])
    assert ok[120:].all() and ok[:120].mean() < 0.2


@pytest.mark.parametrize("size", [0.0, 1e-9, 0.4])
def test_refinement_ends_at_the_camera(size):
    rows = np.array([r[1:12] for r in matches(50, 0.0)])
    x = (rows[:, 2:4] - 400) / 500
    turn, shift = pose.refined(rows[:, 4:7], x, TURN.T, -TURN.T @ SHIFT + size * 0.5)
    assert np.allclose(turn, TURN.T, atol=1e-8) and np.allclose(shift, -TURN.T @ SHIFT, atol=1e-8)
