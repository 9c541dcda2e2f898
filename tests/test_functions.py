import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotwise.functions import dates, geo, numeric, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_is_on_the_binary_product(spark):
    r = one(spark, *[numeric.half_up(F.lit(x), 2).alias(f"c{i}") for i, x in enumerate((1.005, 2.675, -1.5, 0.125))])
    assert list(r) == [1.0, 2.68, -1.5, 0.13]


def test_rate_without_population_is_zero(spark):
    r = one(spark, numeric.safe_rate(F.lit(5), F.lit(0)), numeric.safe_rate(F.lit(5), F.lit(200)), numeric.falsy_default(F.lit(0).cast("long"), 40000), numeric.ambient_population(F.lit(24), F.lit(None).cast("long")))
    assert list(r) == [0.0, 2500.0, 40000, 16.0]


@pytest.mark.parametrize("day,months,rolled,clipped", [("2026-05-31", 3, "2026-03-03", "2026-02-28"), ("2024-05-31", 3, "2024-03-02", "2024-02-29"), ("2024-02-29", 12, "2023-03-01", "2023-02-28"), ("2026-07-15", 6, "2026-01-15", "2026-01-15")])
def test_months_back(spark, day, months, rolled, clipped):
    d = F.lit(day).cast("date")
    r = one(spark, dates.months_back(d, months).cast("string"), dates.months_back(d, months, overflow=False).cast("string"))
    assert list(r) == [rolled, clipped]


def test_windows_and_parsing(spark):
    r = one(spark, dates.window_start("ytd", F.lit("2026-05-31").cast("date")).alias("a"), dates.window_start("other", F.lit("2026-05-31").cast("date")).alias("b"), dates.to_iso_date(F.lit("2026-03-31T12:00:00")).alias("c"), dates.to_iso_date(F.lit("soon")).alias("d"))
    assert list(r) == [dt.date(2026, 1, 1), dt.date(2025, 5, 31), dt.date(2026, 3, 31), None]


@pytest.mark.parametrize("value,shown", [(247.3, "247.3"), (1352.2, "1,352"), (1.6, "1.6"), (None, "—")])
def test_format_rate(spark, value, shown):
    assert one(spark, text.format_rate(F.lit(value).cast("double")))[0] == shown


@pytest.mark.parametrize("value,reference,shown", [(2.0, 1.6, "1.3×"), (24.0, 2.0, "12×"), (1.0, 0.0, None), (None, 1.0, None)])
def test_city_multiple(spark, value, reference, shown):
    assert one(spark, text.city_multiple(F.lit(value).cast("double"), F.lit(reference).cast("double")))[0] == shown


@pytest.mark.parametrize("url,pair", [
    ("https://m.example/maps/place/40.7,-73.9", (40.7, -73.9)), ("https://m.example/maps/x/40.7, -73.9,15z", (40.7, -73.9)), ("https://m.example/a/@40.71,-73.99,17z", (40.71, -73.99)),
    ("https://m.example/maps?ll=10,10&center=40.6,-74.0", (40.6, -74.0)), ("https://m.example/maps/place/10,10", None), ("not a url", None), (None, None),
])
def test_map_links(spark, url, pair):
    r = one(spark, text.map_link_coordinates(F.lit(url).cast("string")))[0]
    assert (tuple(r) if r else None) == pair


def test_text_edges(spark):
    r = one(spark, text.parse_number(F.lit("40.7abc")), text.parse_number(F.lit("x")), text.photo_base_hash(F.lit("nope")), text.photo_base_hash(F.lit("https://h.example/fp/AB-se_large_800_400.webp?x")), text.listing_id(F.lit("/building/a/b/")), text.normalize_url(F.lit("https://h.example/a#b")), text.html_escape(F.lit("<a href='x'>&</a>")))
    assert list(r) == [40.7, None, None, "h.example/fp/AB", "building:a:b", "https://h.example/a", "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"]


SQUARE = [[[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}], [{"x": 0.5, "y": 0.5}, {"x": 1.0, "y": 0.5}, {"x": 1.0, "y": 1.0}, {"x": 0.5, "y": 1.0}]]]


@pytest.mark.parametrize("x,y,inside", [(1.5, 1.5, True), (0.7, 0.7, False), (3.0, 1.0, False), (0.0, 1.5, True), (2.0, 1.5, False), (1.5, 0.0, True), (1.5, 2.0, False)])
def test_point_in_polygon_edges(spark, x, y, inside):
    df = spark.createDataFrame([(SQUARE,)], f"g {geo.GEOMETRY}")
    assert df.select(geo.in_geometry(F.lit(x), F.lit(y), F.col("g"))).first()[0] is inside


def test_area_and_box(spark):
    df = spark.createDataFrame([(SQUARE,), ([],)], f"g {geo.GEOMETRY}")
    rows = df.select(geo.geometry_area_m2(F.col("g")).alias("a"), geo.bbox(F.col("g")).alias("b")).collect()
    assert rows[0].a == pytest.approx(4 * 111319.49**2 * 0.9375, rel=0.01) and tuple(rows[0].b) == (0.0, 0.0, 2.0, 2.0)
    assert rows[1].a == 0.0 and rows[1].b is None
