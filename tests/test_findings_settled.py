"""The third round's finding on floors of scenes: a consensus plane as far off as its points allow is settled on them."""

import numpy as np
import pytest

from plotwise.operators import room
from plotwise.plans import catalogue


def test_floors_of_rooms_whose_consensus_plane_was_ten_centimetres_off(spark, tmp_path):
    keys = [7220, 29_931, 54_696]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["scene_floor"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, True, True) for k in keys]


def test_settling_lowers_the_distances_and_keeps_the_side():
    rng = np.random.default_rng(4)
    p = np.concatenate([np.stack([rng.random(500) * 4, rng.normal(0, 0.005, 500), rng.random(500) * 4], 1), rng.uniform(-2, 2, (200, 3)), [[np.nan, 0.0, 0.0], [np.inf, 0.0, 0.0]]])
    cost = lambda n, d: np.nansum(np.minimum((p[:-1] @ n + d) ** 2, 0.06**2))
    for side in (1.0, -1.0):
        start = side * np.array([0.02, 1.0, 0.0]) / np.hypot(0.02, 1.0), side * -0.04
        with np.errstate(invalid="ignore"):
            n, d = room.settled_plane(*start, p, 0.06)
        assert side * n[1] > 0.99999 and abs(d) < 0.005 and np.linalg.norm(n) == pytest.approx(1.0) and cost(n, d) < cost(*start)
    line = np.stack([np.arange(10.0), np.zeros(10), np.zeros(10)], 1)
    n, d = room.settled_plane(np.array([0.0, 1.0, 0.0]), 0.01, line, 0.06)
    assert n.tolist() == [0.0, 1.0, 0.0] and d == 0.01
