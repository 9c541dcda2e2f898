import math

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plotwise.operators import photo, robust, spatial, stats, store
from plotwise.plans import rooms
from plotwise.plans import catalogue
from plotwise.sources import tables


def test_categories_match_case_blind_and_the_last_wins(spark):
    cats = spark.createDataFrame([("a", "X", 0), ("b", "x", 1)], "metric string, offence string, ord int")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, offence string")
    assert [tuple(r) for r in stats.categorize(rows, cats).select("id", "metric").collect()] == [(1, "b")]


def test_merge_skips_missing_keys_and_prefers_the_first_source(spark):
    a = spark.createDataFrame([("1", 1), (None, 2), ("", 3)], "id string, v int")
    b = spark.createDataFrame([("1", 9), ("2", 8)], "id string, v int")
    got = {r.id: (r.v, r.source) for r in stats.merge_first({"a": a, "b": b}, "id", ["v"]).collect()}
    assert got == {"1": (1, "a"), "2": (8, "b")}


def test_dense_counts_and_nested_windows(spark):
    counts = catalogue._counts(spark, SF).groupBy("area_id", "metric").pivot("window", ["3m", "6m", "12m", "24m"]).agg(F.first("count")).collect()
    assert len(counts) == 75 and all(r["3m"] <= r["6m"] <= r["12m"] <= r["24m"] for r in counts)


def test_ranks_are_a_permutation(spark):
    rows = catalogue.area_stats_windows(spark, SF).groupBy("window", "metric").agg(F.array_sort(F.collect_list("rank")).alias("r")).collect()
    assert all(r.r == list(range(1, 26)) for r in rows)


def test_completeness_names_what_is_missing(spark):
    rows = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "area_id int, population int")
    with pytest.raises(ValueError, match="2 areas without population: 2, 3"):
        stats.require_complete(rows)
    with pytest.raises(ValueError, match="nothing"):
        stats.require_rows(rows.where("false"), "nothing")


def test_first_match_and_missing_coordinates(spark):
    box = lambda x: [[[{"x": x, "y": 0.0}, {"x": x + 2, "y": 0.0}, {"x": x + 2, "y": 2.0}, {"x": x, "y": 2.0}]]]
    areas = spark.createDataFrame([(7, 1, box(0.0)), (8, 0, box(1.0)), (9, 2, [])], "area_id long, ord long, geometry array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 0.5, 1.0), (3, 9.0, 9.0), (4, None, 1.0)], "id int, lon double, lat double")
    for most in (1000, 0):
        got = {r.id: r.area_id for r in spatial.assign_areas(points, areas, max_points=most, cell=0.5).collect()}
        assert got == {1: 8, 2: 7, 3: None, 4: None}


def test_weighted_median_and_mad(spark):
    rows = spark.createDataFrame([(1, float(v), w) for v, w in ((1, 1), (2, 1), (3, 5), (100, 1))], "k int, v double, w int")
    assert robust.weighted_median(rows, ["k"], "v", "w").first().weighted_median == 3.0
    assert sorted(r.v for r in robust.mad_inliers(rows, ["k"], "v").collect()) == [1.0, 2.0, 3.0]
    assert robust.weighted_median(rows.where("false"), ["k"], "v", "w").count() == 0


def test_store_fold(spark):
    log = spark.createDataFrame([(1, 1, "write", "a"), (1, 2, "delete", None), (1, 3, "write", None), (1, 4, "write", "b"), (2, 5, "delete", None)], "k int, seq int, op string, label string")
    assert [tuple(r) for r in store.fold_log(log, "k", "seq").collect()] == [(1, 3, 4, 2, "b")]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    change = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in store.upsert(base, change, ["k"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in store.partial_update(base, change, ["k"], ["v"]).collect()} == {(1, "a"), (2, "b")}


def test_triangulated_area_of_known_shapes():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 1, (1200, 2)) * [3, 2]
    alpha, convex = photo.alpha_area(p)
    assert convex == pytest.approx(6, rel=0.03) and alpha == pytest.approx(6, rel=0.06) and alpha <= convex
    ell = p[~((p[:, 0] > 1) & (p[:, 1] > 1))]
    assert photo.alpha_area(ell)[0] == pytest.approx(4, rel=0.08) and photo.alpha_area(ell)[1] > 4.5
    grid = np.stack(np.meshgrid(np.arange(20.0), np.arange(10.0)), -1).reshape(-1, 2)
    assert photo.alpha_area(grid)[1] == pytest.approx(19 * 9, rel=1e-6)
    assert photo.alpha_area(np.zeros((2, 2))) == (0.0, 0.0) and photo.alpha_area(np.zeros((50, 2)))[0] < 1e-9


def test_every_point_counts_in_areas_and_planes(spark):
    rng = np.random.default_rng(3)
    grid = np.stack(np.meshgrid(np.arange(100) / 20, np.arange(100) / 20), -1).reshape(-1, 2)
    hole = (np.abs(grid - [2.5, 2.5]) < 0.5).all(1)  # a metre wide, as under furniture
    alpha, convex = photo.alpha_area(grid[~hole])
    assert convex == pytest.approx(4.95**2, rel=1e-6) and alpha == pytest.approx(4.95**2 - 1.0, abs=0.15)
    p = rng.uniform(0, 1, (300, 2))
    tri = photo.triangulate(p)
    centre, radius = photo._circles(p, tri)
    assert (((p[None] - centre[:, None]) ** 2).sum(2) < radius[:, None] * (1 - 1e-4)).sum() == 0
    gap = np.sqrt(np.where(np.eye(300, dtype=bool), np.inf, ((p[:, None] - p[None]) ** 2).sum(2)).min(1))
    u, v = p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]
    want = (np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2)[radius <= (5 * np.median(gap)) ** 2].sum()
    assert photo.alpha_area(p)[0] == pytest.approx(want, rel=1e-9)
    # of two planes the one with more points wins, although each second point in order lies on the other
    rows = [(1, float(x), float(i % 2 == 0 and i < 8000), i * 1e-4) for i, x in enumerate(rng.uniform(0, 1, 8100))]
    got = photo.fit_planes(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g").first()
    assert abs(got.py) > 0.99 and abs(got.d) < 0.1 and got.n_points == 8100


def test_planes_of_made_rooms(spark):
    photos = spark.createDataFrame([(1, 12), (2, 14)], "photo_id long, p_size int")
    pixels = rooms.made_rooms(photos).cache()
    planes = photo.fit_planes(photo.floor_candidates(pixels), "photo_id").collect()
    assert all(abs(abs(r.py) - 1) < 0.01 and abs(r.d - 1.5) < 0.05 for r in planes)
    area = {r.photo_id: r for r in photo.visible_area(pixels).collect()}
    assert all(r.ok and r.residual_m < 0.03 and 5 < r.area_m2 < 60 for r in area.values())
    none = photo.visible_area(pixels.where("cls = 0")).collect()
    assert all(not r.ok and r.area_m2 == 0 for r in none)


def test_ring_simplification_keeps_ends_and_corners(spark):
    ring = [{"x": i / 10, "y": 0.0} for i in range(11)] + [{"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    df = spark.createDataFrame([(ring,)], "r array<struct<x:double,y:double>>")
    got = [(p.x, p.y) for p in df.select(photo.simplify_ring(F.col("r"))).first()[0]]
    assert got == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def test_documents_and_point_clouds(spark, tmp_path):
    doc = tables.stats_document(catalogue.area_stats_windows(spark, SF))
    import json

    body = json.loads(doc.where(F.col("window") == "12m").first().document)
    assert len(body) == 25 and set(body["0"]) == {"m1", "m2", "m3"} and set(body["0"]["m1"]) == {"count", "rate", "rank", "total", "percentile"}
    tables.write_point_cloud(spark.createDataFrame([(1.0, 2.0, 3.0), (math.nan, 0.0, 0.0)], "x double, y double, z double"), str(tmp_path / "ply"))
    text = [r.value for r in spark.read.text(str(tmp_path / "ply/0-header")).collect()]
    assert "element vertex 1" in text and spark.read.text(str(tmp_path / "ply/1-points")).first().value == "1.00000 2.00000 3.00000 180 180 180"


def test_boundaries_from_json(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"nta2020":"","ntacode":"A1","ntaname":"n","boroname":"b","ntatype":null,"the_geom":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}\n{"nta2020":"B","ntatype":"9","the_geom":null}\n')
    rows = tables.read_boundaries(spark, str(tmp_path / "b.json")).collect()
    assert [(r.area_id, [(p.x, p.y) for p in r.geometry[0][0]]) for r in rows] == [("A1", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in got.description]
    want = sorted(got.fetchall(), key=_order)
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    have = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_order)
    assert len(have) == len(want)
    for x, y in zip(have, want):
        assert all(_alike(p, q) for p, q in zip(x, y)), (x, y)


def _order(row):
    """Numbers by five digits, so that the last ones do not decide which rows are compared; exact columns come first."""
    return tuple(_plain(v) for v in row if not isinstance(v, float)), tuple(f"{v:.5g}" for v in row if isinstance(v, float))


def _alike(x, y):
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else _plain(x) == _plain(y)


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
