"""Reports, messages, estimates, rooms and readers on small tables."""

import json
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from plotwise.functions import dates, numeric, text
from plotwise.operators import estimates, lookup, matching, robust, room, scene, stats, store
from plotwise.plans import catalogue
from plotwise.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- readers and writers


def test_keyed_csv_and_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ntacode,population\n0071,5\n,6\n")
    rows = tables.read_keyed_csv(spark, str(tmp_path / "a.csv"), "ntacode string, population long")
    assert [tuple(r) for r in rows.dropna("any").collect()] == [("0071", 5)]
    spark.range(3).selectExpr("id", "id * 2 as b", "id * 3 as c").write.parquet(str(tmp_path / "p"))
    got = tables.read_columns(spark, str(tmp_path / "p"), ["c"])
    assert got.columns == ["c"] and "ReadSchema: struct<c:bigint>" in got._jdf.queryExecution().toString()


def test_incidents_are_filtered_by_offence_days_and_place(spark, tmp_path):
    rows = [("1", "2024-01-01T10:00", "rape ", "1", "2"), ("2", "2024-01-31", "Assault", "1", "2"), ("3", "2024-02-01", "ASSAULT", "1", "2"), ("4", "2024-01-02", "assault", None, "2"), (None, "2024-01-02", "assault", "1", "2")]
    (tmp_path / "i.json").write_text("\n".join(json.dumps(dict(zip(("id", "date", "offence", "latitude", "longitude"), r))) for r in rows))
    assert [r.id for r in tables.read_incidents(spark, str(tmp_path / "i.json"), ["assault"], "2024-01-01", "2024-01-31").collect()] == ["2"]


def test_images_reports_and_boundary_limit(spark, tmp_path):
    for name in ("b.JPG", "a.png", ".hidden.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in tables.list_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    rows = spark.createDataFrame([("B", 2), ("A", 1)], "area string, jobs long")
    tables.write_pretty_json(rows, "area", str(tmp_path / "report"), {"year": 2020})
    body = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert json.loads(body) == {"year": 2020, "areas": {"A": {"jobs": 1}, "B": {"jobs": 2}}} and body.index('"A"') < body.index('"B"')
    (tmp_path / "b.json").write_text('{"nta2020":"A"}\n{"nta2020":"B"}\n')
    assert tables.read_boundaries(spark, str(tmp_path / "b.json"), limit=2).count() == 2
    with pytest.raises(ValueError):
        tables.read_boundaries(spark, str(tmp_path / "b.json"), limit=1)


# ---- columns


def test_small_columns(spark):
    r = one(
        spark, text.is_listing_photo(F.lit("https://a.Photos.net/x"), ("photos.net",)).alias("a"), text.is_listing_photo(F.lit("https://myphotos.net/x"), ("photos.net",)).alias("b"),
        text.large_enough(F.lit(100), F.lit(100)).alias("c"), text.large_enough(F.lit(100), F.lit(0)).alias("d"),
        numeric.angle_difference(F.lit(0.1), F.lit(math.pi - 0.1)).alias("e"), dates.display_date(F.lit("2026-03-31")).alias("f"),
    )
    assert (r.a, r.b, r.c, r.d, round(r.e, 9)) == (True, False, False, True, 0.2) and "Mar 31, 2026" in r.f


@pytest.mark.parametrize(
    "document,want",
    [
        ('{"geo": {"latitude": 40.7, "longitude": -74}}', (40.7, -74.0)),
        ('[{"a": 1}, {"b": [{"c": {"geo": {"latitude": "40.7", "longitude": "-74"}}}]}]', (40.7, -74.0)),
        ('{"latitude": 1, "longitude": 1, "x": {"latitude": 40.8, "longitude": -73.9}}', (40.8, -73.9)),
        ('{"@graph": [1, 2, {"geo": {"latitude": 40.7, "longitude": -74}}]}', (40.7, -74.0)),
        ('{"a":' * 8 + '{"latitude": 40.7, "longitude": -74}' + "}" * 8, None),
        ("{broken", None), ("", None), (None, None), ("[]", None), ('"text"', None),
    ],
)
def test_json_ld_is_searched_six_levels_deep(spark, document, want):
    got = spark.createDataFrame([(document,)], "d string").select(text.json_ld_coordinates(F.col("d")).alias("c")).first().c
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "link,want",
    [("https://m.net/maps/place/40.7,-74.0/x", (40.7, -74.0)), ("https://m.net/maps/x/40.7,-74.0,15z", (40.7, -74.0)), ("https://m.net/maps/@40.7,-74.0,17z", (40.7, -74.0)), ("https://m.net/?z=1&center=40.7%2C-74.0#x", (40.7, -74.0)), ("https://m.net/?q=1,2&ll=40.7,%20-74", (40.7, -74.0)), ("https://m.net/?q=here", None), ("no link", None)],
)
def test_map_links(spark, link, want):
    got = one(spark, text.map_link_coordinates(F.lit(link)).alias("c")).c
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "title,address,hood",
    [("Flat at 12 East Street in Old Hill | Rooms", "12 East Street", "Old Hill"), ("12 Main Road IN Soho: sale", "12 Main Road", "Soho"), ("Flat at 1 | x in Soho", "Flat at 1| x", "Soho"), ("Home", None, None), (None, None, None)],
)
def test_titles(spark, title, address, hood):
    r = spark.createDataFrame([(title,)], "t string").select(text.title_address(F.col("t")).alias("a"), text.title_neighbourhood(F.col("t")).alias("h")).first()
    assert (r.a, r.h) == (address, hood)


def test_breadcrumbs_stand_in_for_the_title(spark):
    crumbs = F.array(F.lit("City"), F.lit("Soho"))
    assert one(spark, text.title_neighbourhood(F.lit("Home"), crumbs), text.title_neighbourhood(F.lit("Home"), F.slice(crumbs, 1, 1)))[:] == ("Soho", None)


# ---- reports and messages


def test_guards_name_what_is_missing(spark):
    areas = spark.createDataFrame([(i, None if i % 2 else 5) for i in range(30)], "area_id long, population long")
    with pytest.raises(ValueError, match="15 areas without population: 1, 3"):
        stats.require_complete(areas)
    assert stats.require_complete(areas.where("population > 0")).count() == 15


def test_documents_of_odd_values(spark):
    rows = spark.createDataFrame([("3m", 1, "m1", 0, 0.1 + 0.2, 1, 2, None), ("3m", 2, 'm"2', 5, 1e-9, 2, 2, 50.0)], "window string, area_id long, metric string, count long, rate double, rank long, total long, percentile double")
    rates = spark.createDataFrame([("3m", "borough", "St. Mary's", "m1", 1.25), ("3m", "city", "ALL", "m1", None)], "window string, level string, grp string, metric string, rate double")
    doc = lookup.whole_document(rows, rates, spark.createDataFrame([(None,)], "data_through date"))
    assert doc.first().through and sorted(map(tuple, lookup.document_statistics(doc).collect())) == sorted(map(tuple, rows.collect()))
    assert (lookup.document_comparisons(doc).where("grp <> 'ALL'").first())[:] == ("3m", "borough", "St. Mary's", "m1", 1.25)


def test_messages_and_estimates(spark):
    rows = spark.createDataFrame([(1, "save", "u"), (2, "save", None), (3, "other", None), (4, None, None)], "seq long, type string, url string")
    got = {r.seq: (r.handled, r.success, r.error) for r in lookup.dispatch(rows, "type", {"save": ["url"]}).collect()}
    assert got == {1: (True, True, None), 2: (True, False, "save needs url"), 3: (False, None, None), 4: (False, None, None)}
    photos = spark.createDataFrame([("a", None, None), ("b", 7, "x")], "id string, sqft long, pipeline string")
    sent = spark.createDataFrame([("a", "12.5", "", 1), ("a", "-3", "v2", 2), ("z", "9", "v2", 3)], "id string, sqft string, pipeline string, seq long")
    assert {tuple(r) for r in lookup.write_estimates(photos, sent, ["id"]).collect()} == {("a", 0, "v2"), ("b", 7, "x")}
    words = spark.createDataFrame([("a", "x y"), ("b", "nan")], "id string, sqft string").selectExpr("*", "'p' pipeline", "1L seq")
    assert {tuple(r) for r in lookup.write_estimates(photos, words, ["id"]).collect()} == {("a", 0, "p"), ("b", 0, "p")}


def test_positions_and_annotations(spark):
    photos = spark.createDataFrame([("https://p.net/fp/a-se_large_8.webp",), ("https://p.net/fp/b.jpg",), ("no link",)], "photo_url string")
    thumbs = spark.createDataFrame([("https://p.net/fp/a.jpg?x", 4), ("https://p.net/fp/a-se_small_1.jpg", 2)], "thumb string, position int")
    assert {r.photo_url[-9:]: r.position for r in store.positions_by_hash(photos, thumbs, "photo_url", "thumb").collect()} == {"ge_8.webp": 2, "t/fp/b.jpg"[-9:]: None, "no link"[-9:]: None}
    placed = store.annotate(spark.createDataFrame([("a",), ("b",), ("c",)], "photo_url string"), spark.createDataFrame([("a", 0), ("b", 3)], "photo_url string, position int"))
    assert [r.photo_url for r in placed.collect()] == ["b", "a", "c"]


# ---- estimates


def test_quantiles_of_large_groups_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = {0: rng.normal(size=60_000), 1: np.repeat([1.0, 2.0, 3.0], 20_000), 2: rng.normal(size=3), 3: np.array([5.0])}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [(0, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(8)
    qs = [0.0, 0.02, 0.5, 0.75, 0.99, 1.0]
    got = {r.k: [r[f"q{round(q * 100):02d}"] for q in qs] for r in robust.quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {*values, 4} and got[4] == [None] * len(qs)  # a group of nulls alone has a row, as a grouping gives it
    for k, own in values.items():
        assert np.allclose(got[k], np.quantile(own, qs), rtol=1e-12)


def test_listing_estimates(spark):
    images = spark.createDataFrame([("a", 10.0, 0.01), ("a", 20.0, 0.5), ("b", 0.0, 0.0), ("c", 5.0, 0.9), ("c", 6.0, 0.9), ("c", 7.0, 0.9), ("d", 9.0, 0.01), ("d", 8.0, 0.01)], "k string, area double, residual double")
    scenes = spark.createDataFrame([("d", 12.0, 15.0, None), ("c", 30.0, 40.0, "no_plane")], "k string, visible_m2 double, completed_m2 double, reason string")
    got = {r.k: (r.method, round(r.area_m2, 6), round(r.lo_m2, 6), round(r.hi_m2, 6)) for r in estimates.listing_estimates(images, scenes, "k", "area", "residual").collect()}
    assert got == {"a": ("fallback", 10.0, 9.0, 11.0), "b": ("single-image", 0.0, 0.0, 0.0), "c": ("fallback", 6.5, 4.5, 7.7), "d": ("multi-view", 12.0, 8.0, 12.0)}
    filled = {r.k: r.area_m2 for r in estimates.listing_estimates(images, scenes, "k", "area", "residual", impute=True).collect()}
    assert filled["d"] == 15.0


def test_confidences(spark):
    r = one(
        spark, estimates.wall_confidence(F.lit(450), F.lit(2.5), F.lit(0.9), F.lit(0.0), 150, 0.08).alias("best"), estimates.seam_confidence(F.lit(400), F.lit(2.5), F.lit(0.0)).alias("seam"),
        estimates.layout_confidence(F.lit(0.7), F.lit(0.98), F.lit(4), F.lit(2), F.lit(1.0), F.lit(0)).alias("whole"), estimates.layout_confidence(F.lit(0.7), F.lit(0.98), F.lit(3), F.lit(2), F.lit(1.0), F.lit(1)).alias("capped"),
    )
    assert [round(x, 9) for x in r] == [1.0, 0.88, 1.0, 0.58]


# ---- rooms


def _wall(rng, start, end, n, spread=0.01):
    t = rng.random((n, 1))
    p = np.array(start) * (1 - t) + np.array(end) * t + rng.normal(size=(n, 2)) * spread
    d = np.subtract(end, start) / np.hypot(*np.subtract(end, start))
    return p, np.repeat([[-d[1], d[0]]], n, 0), rng.random(n) * 2


def test_wall_lines_of_a_box(spark):
    rng = np.random.default_rng(3)
    corners = [(0, 0), (4, 0), (4, 3), (0, 3)]
    parts = [_wall(rng, a, b, 400) for a, b in zip(corners, corners[1:] + corners[:1])]
    q, n, h = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rows = spark.createDataFrame([(1, *map(float, (*a, *b, c))) for a, b, c in zip(q, n, h)] + [(2, 0.0, 0.0, 1.0, 0.0, 1.0)], "photo int, a double, b double, na double, nb double, height double")
    got = room.wall_lines(rows, "photo", rounds=300).collect()
    assert len(got) == 4 and {r.photo for r in got} == {1}
    flat = sorted((round(abs(math.cos(r.theta))), round(abs(r.offset), 1)) for r in got)
    assert flat == [(0, 0.0), (0, 4.0), (1, 0.0), (1, 3.0)]
    assert all(r.span > 2.5 and r.agreement > 0.9 and r.residual < 0.03 for r in got)


def test_lines_of_one_wall_are_one():
    rng = np.random.default_rng(4)
    q, n, h = _wall(rng, (0, 1), (4, 1), 500, 0.05)
    lines = [{**room._measured(t, o, q, n, h, 0.08), "score": s} for t, o, s in ((0.0, 1.0, 5.0), (np.pi - 0.02, -0.95, 1.0), (np.pi / 2, -2.0, 1.0))]
    got = room.merge_lines(lines, q, n, h)
    assert len(got) == 2 and got[0]["score"] == 6.0 and abs(abs(got[0]["offset"]) - 1.0) < 0.06


def test_scene_floor_is_not_the_largest_wall(spark):
    rng = np.random.default_rng(5)
    floor = np.stack([rng.random(400) * 4, np.full(400, 1.5) + rng.normal(size=400) * 0.01, rng.random(400) * 4], 1)
    wall = np.stack([rng.random(900) * 4, rng.random(900) * 3 - 1.5, np.full(900, 4.0)], 1)
    points = spark.createDataFrame([(1, *map(float, p)) for p in np.concatenate([floor, wall])] + [(2, 0.0, 0.0, 0.0)], "scene int, x double, y double, z double")
    eyes = spark.createDataFrame([(s, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0) for s in (1, 2)], "scene int, cx double, cy double, cz double, ux double, uy double, uz double")
    got = room.scene_floor(points, eyes, "scene", stop=100).collect()
    assert len(got) == 1 and got[0].py < -0.99 and abs(got[0].d - 1.5) < 0.05 and got[0].n_points == 1300 and got[0].n_inliers >= 380


def test_outlines_and_rectangles():
    grid = np.array([(x / 10, y / 10) for x in range(31) for y in range(21)])
    ring = room.outline(grid)
    assert abs(abs(room.ring_area(ring)) - 6.0) < 0.02
    two = np.concatenate([grid, grid[:30] * 0.3 + 20])  # a small part far away goes
    assert abs(abs(room.ring_area(room.outline(two))) - 6.0) < 0.02
    turned = grid @ np.array([[math.cos(0.3), math.sin(0.3)], [-math.sin(0.3), math.cos(0.3)]])
    theta, width, depth = room.least_rectangle(turned)
    assert sorted((round(width, 6), round(depth, 6))) == [2.0, 3.0] and round(theta % (math.pi / 2), 6) == 0.3
    assert len(room.hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]]))) == 4
    assert room.least_rectangle(np.array([[0.0, 0.0], [2.0, 0.0]])) == (0.0, 2.0, 0.0)
    box = np.array([[0, 0], [3, 0], [3, 2], [0, 2]], float)
    assert np.allclose(room.anchored_extent(box, 0.0), (3.0, 2.0))


def test_alignment_of_pairs_with_outliers(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 3))
    b = 2 * a @ np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1]]).T + [1, 2, 3]
    b[:10] += 30
    rows = [(1, *map(float, (*x, *y))) for x, y in zip(a, b)] + [(2, *map(float, (*x, *y))) for x, y in zip(a[:5], b[10:15])]
    got = room.align_points(spark.createDataFrame(rows, "k int, ax double, ay double, az double, bx double, by double, bz double"), "k").collect()
    assert [(r.k, r.n_inliers, round(r.scale, 6), round(r.rmse, 6)) for r in got] == [(1, 30, 2.0, 0.0)] and np.allclose(got[0].t, [1, 2, 3])


def test_poses_and_descriptors(spark):
    points = spark.createDataFrame([(1, 7, 1.0, 2.0, 3.0)], "view int, id int, x double, y double, z double")
    cams = spark.createDataFrame([(1, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [10.0, 0.0, 0.0])], "view int, r array<double>, t array<double>")
    assert scene.apply_pose(points, cams, ["view"]).first()[:] == (1, 7, 8.0, 1.0, 3.0)
    vectors = [(i, [1.0 if (i >> k % 3) & 1 else -1.0 for k in range(100)]) for i in range(8)]
    df = spark.createDataFrame(vectors, "id long, v array<double>").select("id", F.lit(0).alias("k"), matching.sign_bits(F.col("v")).alias("bits"))
    assert df.first().bits.__len__() == 2
    near = matching.nearest(df, df, 1, ["k"]).collect()
    assert {(r.id, r.other, r.distance) for r in near} == {(i, i, 0) for i in range(8)}
    assert matching.mutual_nearest(df, df, ["k"], most=3).count() == 3
    assert matching.nearest(df.where("id < 0"), df, 1, ["k"]).count() == 0


def test_every_query_has_a_column_list(spark):
    assert all(catalogue.QUERIES[n](spark, SF).columns for n in ("point_statistics", "wall_lines", "layout_reasons"))
