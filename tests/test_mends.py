"""Null keys, repeated keys, unlike lengths and names with any sign."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import lookup, matching, robust, store


@pytest.fixture(params=["small", "sketched"])
def accuracy(request, monkeypatch):
    """Groups that are all small, and the way for groups of any size with the same rows."""
    if request.param == "sketched":
        monkeypatch.setattr(robust, "_all_small", lambda rows, keys: False)


def test_quantiles_keep_null_groups(spark, accuracy):
    rows = [(None, "b", float(v)) for v in range(5)] + [("a", "b", 1.0), ("a", "b", None), ("c", None, None), (None, None, 7.0)]
    got = {(r.k, r.m): (r.q25, r.q50) for r in robust.quantiles(spark.createDataFrame(rows, "k string, m string, v double"), ["k", "m"], "v", [0.25, 0.5]).collect()}
    assert got == {(None, "b"): (1.0, 2.0), ("a", "b"): (1.0, 1.0), ("c", None): (None, None), (None, None): (7.0, 7.0)}


def test_quantiles_of_a_large_group_are_exact(spark):
    v = np.random.default_rng(1).permutation(60_000)
    table = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double").alias("v"))
    got = {r.k: (r.q02, r.q50, r.q98) for r in robust.quantiles(table, ["k"], "v", [0.02, 0.5, 0.98]).collect()}
    rows = table.toPandas()
    for k, own in (("hot", rows[rows.k == "hot"]), (None, rows[rows.k.isna()])):
        assert got[k] == pytest.approx(tuple(np.quantile(own.v, [0.02, 0.5, 0.98])), abs=1e-9)
    assert len(v) == 60_000


def test_mad_keeps_null_groups(spark, accuracy):
    rows = [(None, "b", float(v)) for v in (1, 2, 3, 4, 900)] + [("a", None, 5.0), ("a", None, 5.0), ("few", "b", 1.0)]
    got = sorted((r.k or "", r.v) for r in robust.mad_inliers(spark.createDataFrame(rows, "k string, m string, v double"), ["k", "m"], "v", least=2).collect())
    assert got == [("", 1.0), ("", 2.0), ("", 3.0), ("", 4.0), ("a", 5.0), ("a", 5.0)]


def test_one_row_a_key(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    table = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, None)], "k int, seq int, v string")
    assert sorted(tuple(r) for r in lookup.keyed_value(keys, table, "k", {"v": "none"}, "seq").collect()) == [(1, "new"), (2, "none"), (3, "none")]
    assert lookup.keyed_value(keys, table, "k", {"v": "none"}).count() == 3
    base = spark.createDataFrame([(1, "a", "x")], "k int, v string, w string")
    changes = spark.createDataFrame([(1, 1, "b", "y"), (1, 2, "c", None), (4, 1, "d", "z")], "k int, seq int, v string, w string")
    assert [tuple(r) for r in store.partial_update(base, changes, ["k"], ["v", "w"], "seq").collect()] == [(1, "c", "y")]
    assert sorted(tuple(r) for r in store.upsert(base, changes, ["k"], ["v", "w"], "seq").collect()) == [(1, "c", "y"), (4, "d", "z")]


def test_comparisons_of_any_name_come_back(spark):
    rows = [("6m", "city", None, "m|1", 1.5), ("6m", "borough", "A|B", "m1", 2.0), ("6m", "borough", 'q"[', "m1", 3.0)]
    stats = spark.createDataFrame([("6m", 1, "m1", 3, 1.0, 1, 2, 50.0)], "window string, area_id long, metric string, count long, rate double, rank long, total long, percentile double")
    document = lookup.whole_document(stats, spark.createDataFrame(rows, "window string, level string, grp string, metric string, rate double"), spark.createDataFrame([(datetime.date(2024, 1, 1),)], "data_through date"))
    assert sorted(map(str, (tuple(r) for r in lookup.document_comparisons(document).collect()))) == sorted(map(str, rows))
    areas = spark.createDataFrame([(1, "A|B")], "area_id long, borough string")
    twice = spark.createDataFrame([*rows, ("6m", "city", None, "m1", 4.0), ("6m", "city", None, "m1", 3.0)], "window string, level string, grp string, metric string, rate double")
    assert [(r.metric, r.city_rate, r.borough_rate) for r in lookup.area_comparisons(areas, twice, "6m").where("metric = 'm1'").collect()] == [("m1", 4.0, 2.0)]


def test_descriptors_of_unlike_length_are_not_compared(spark):
    left = spark.createDataFrame([("g", 1, [1, 2]), ("g", 2, [7])], "g string, id long, bits array<long>")
    right = spark.createDataFrame([("g", 5, [1, 3]), ("g", 6, [7]), ("g", 7, [6]), ("g", 8, None)], "g string, id long, bits array<long>")
    assert sorted((r.id, r.other, r.distance) for r in matching.nearest(left, right, 2, ["g"]).collect()) == [(1, 5, 1), (2, 6, 0), (2, 7, 1)]
    assert sorted((r.id, r.other) for r in matching.mutual_nearest(left, right, ["g"]).collect()) == [(1, 5), (2, 6)]


def test_bursts_exactly_the_gap_apart_are_one(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 21)], "k int, ts timestamp")
    assert sorted(r.n for r in store.debounce(rows, "k", "ts", "10 seconds").collect()) == [1, 2]
