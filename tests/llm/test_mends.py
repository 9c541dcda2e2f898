"""Repeated ids in training, the vote of two views, numbers of sequences over many partitions."""

import numpy as np
from pyspark.sql import functions as F

from plotwise.llm import packing, quality

SF = "/root/testdata/sf0.001"


def test_training_takes_the_same_row_of_a_repeated_id(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumn("text", F.concat(F.lit("another text of this id "), F.reverse("text"))).withColumn("source", F.lit("elsewhere"))
    twice = docs.unionByName(other)
    one, two = (quality.train(t, labels) for t in (twice.repartition(3, "source"), twice.orderBy(F.desc("doc_id")).coalesce(1)))
    assert np.allclose(one.text, two.text, atol=1e-6) and np.allclose(one.meta, two.meta, atol=1e-6) and np.allclose(one.vote, two.vote, atol=1e-6)


def test_ids_beyond_the_doubles_are_told_apart(spark):
    big = 2**53
    rows = [(big + i, bytearray(np.full(quality.TEXT_SIZE, i, np.float16).tobytes()), bytearray(np.zeros(quality.META_SIZE, np.float16).tobytes())) for i in range(4)]
    pool = quality.TablePool(spark.createDataFrame(rows + [(None, rows[0][1], rows[0][2])], quality._ROW), np.array([big + 1]))
    assert pool.counts([np.zeros(quality.TEXT_SIZE + 1), np.zeros(quality.META_SIZE + 1)]).sum() == 2 * 4


def test_a_view_that_would_be_turned_round_has_no_weight():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    good, wrong, noise = 4 * y - 2 + rng.normal(size=400), 2 - 4 * y + rng.normal(size=400), rng.normal(size=400)
    w = quality.calibrated_vote(np.stack([good, wrong], 1), y)
    assert w[0] > 0 and w[1] == 0
    w = quality.calibrated_vote(np.stack([good, good + noise], 1), y)
    assert (w[:2] >= 0).all() and w[0] > 0
    w = quality.calibrated_vote(np.stack([wrong, wrong], 1), y)
    assert (w[:2] == 0).all() and abs(1 / (1 + np.exp(-w[2])) - y.mean()) < 0.01


def test_sequences_are_numbered_over_stretches_of_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(1 << int(k), int(p), int(rng.integers(1, 9))) for k in (0, 3, 5) for p in rng.choice(3000, 700, replace=False)]
    got = {(r.length, r.part): r.base for r in packing._bases(spark.createDataFrame(rows, "length long, part int, n long"), stretch=64).collect()}
    at = 0
    for length, part, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        assert got[length, part] == at
        at += n
    assert packing._bases(spark.createDataFrame([], "length long, part int, n long")).collect() == []
