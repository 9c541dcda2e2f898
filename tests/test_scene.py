import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import matching, scene


def test_known_transform_comes_back(spark):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rot = q * np.sign(np.linalg.det(q))
    a = rng.normal(size=(40, 3))
    b = 1.7 * a @ rot.T + [1.0, -2.0, 0.5]
    rows = [(k, *map(float, x), *map(float, y)) for k in (1, 2) for x, y in zip(a, b)] + [(3, *[0.0] * 6)] * 2
    df = spark.createDataFrame(rows, "k int, ax double, ay double, az double, bx double, by double, bz double")
    got = scene.similarity_transforms(df, "k").collect()
    assert {r.k for r in got} == {1, 2}
    for r in got:
        assert r.scale == pytest.approx(1.7) and r.rmse < 1e-6
        assert np.allclose(np.array(r.r).reshape(3, 3), rot) and np.allclose(r.t, [1.0, -2.0, 0.5])
    flipped = df.withColumn("bx", -F.col("bx"))  # a mirror image has no rotation onto it
    assert all(np.linalg.det(np.array(r.r).reshape(3, 3)) > 0.99 and r.rmse > 0.1 for r in scene.similarity_transforms(flipped, "k").collect())


def test_cells_count_a_view_once(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.1, 0.1, 5.0), (1, 0, 2, 0.2, 0.3, 7.0), (1, 1, 1, 0.4, 0.4, 9.0)], "g int, view int, o int, x double, y double, v double")
    assert [tuple(r) for r in scene.cell_means(df, ["g"], "view", "o", "x", "y", 1.0, ["v"]).collect()] == [(1, 0, 0, 8.0, 2)]


def test_nearest_goes_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 7)
    rng = np.random.default_rng(3)
    bits = [int(x) for x in rng.integers(-(2**62), 2**62, 60)]
    df = spark.createDataFrame([(i % 2, i, b) for i, b in enumerate(bits)], "k int, id long, bits long")
    left, right = df.where("id < 30"), df.where("id >= 30")
    got = {(r.k, r.id): (r.other, r.distance) for r in matching.nearest(left, right, 1, ["k"]).collect()}
    for i in range(30):
        best = min(((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() * 1000 + j for j in range(30, 60) if j % 2 == i % 2)
        assert got[(i % 2, i)] == (best % 1000, best // 1000)
    assert matching.mutual_nearest(left, right.where("false"), ["k"]).count() == 0
