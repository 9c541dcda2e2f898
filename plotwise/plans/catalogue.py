"""Registered queries over the driver's tables, and the SQL that checks each.

Stand-ins: a nation is an area (ordinal: its key), a region a borough, an order an incident whose priority
is the offence and whose customer's nation is where it happened; customers count as residents, suppliers
as jobs. The SQL states each result independently where there is another way to say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, numeric, text
from ..operators import estimates, matching, photo, robust, scene, spatial, stats, store
from . import rooms

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_CATEGORIES = [("m1", "1-urgent", 0), ("m2", "2-HIGH", 1), ("m3", "3-medium", 2), ("m3", "4-NOT SPECIFIED", 3)]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _half_up(x: str, n: int) -> str:
    return f"(floor(({x}) * CAST({10**n} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**n} AS DOUBLE))"


# ---- areas, incidents and windows -------------------------------------------------------------------------


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id, ord, borough, population (1,000 a customer; the first area has none on record), jobs."""
    people = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count("*") * 1000).alias("population"))
    jobs = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") * 500).alias("jobs"))
    area = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = area.join(people, F.col("n_nationkey") == people["k"], "left").join(jobs, F.col("n_nationkey") == jobs["k"], "left")
    key = F.col("n_nationkey").cast("long")
    return out.select(key.alias("area_id"), key.alias("ord"), F.col("r_name").alias("borough"), F.when(key != 0, F.coalesce("population", F.lit(0)).cast("long")).alias("population"), F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"))


def _categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CATEGORIES, "metric string, offence string, ord int")


def _metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m1",), ("m2",), ("m3",)], "metric string")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("offence"), dates.to_iso_date(F.col("o_orderdate")).alias("date"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("area_id"))
    return stats.categorize(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), _categories(spark)).select("area_id", "metric", "date")


def _ranges(spark: SparkSession, sf_dir: str, overflow: bool = True) -> DataFrame:
    return dates.window_ranges(_t(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("end")), overflow)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.window_counts(_events(spark, sf_dir), _areas(spark, sf_dir), _metrics(spark), _ranges(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.area_stats(_counts(spark, sf_dir), _areas(spark, sf_dir))


def _land(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("area_id"), (F.col("n_nationkey") % 7).cast("double").alias("area_sq_mi"))


_AREAS_SQL = """areas AS (
  SELECT CAST(n_nationkey AS BIGINT) AS area_id, r_name AS borough,
    CASE WHEN n_nationkey <> 0 THEN coalesce((SELECT count(*) * 1000 FROM customer WHERE c_nationkey = n_nationkey), 0) END AS population,
    coalesce((SELECT count(*) * 500 FROM supplier WHERE s_nationkey = n_nationkey), 0) AS jobs,
    CAST(n_nationkey % 7 AS DOUBLE) AS area_sq_mi
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_EVENTS_SQL = """events_ AS (
  SELECT CAST(c_nationkey AS BIGINT) AS area_id, CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'm1' WHEN '2-HIGH' THEN 'm2' WHEN '3-MEDIUM' THEN 'm3' WHEN '4-NOT SPECIFIED' THEN 'm3' END AS metric
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_ROLL = "CAST(date_trunc('month', e) - INTERVAL {m} MONTH AS DATE) + CAST(day(e) - 1 AS INTEGER)"
_CLIP = "CAST(e - INTERVAL {m} MONTH AS DATE)"


def _ranges_sql(form: str = _ROLL) -> str:
    rows = [f"SELECT '{w}' AS \"window\", {form.format(m=m) if m else 'CAST(date_trunc(' + chr(39) + 'year' + chr(39) + ', e) AS DATE)'} AS \"start\", e AS \"end\" FROM anchor" for w, m in dates.WINDOWS.items()]
    return "anchor AS (SELECT CAST(max(o_orderdate) AS DATE) AS e FROM orders), ranges AS (" + " UNION ALL ".join(rows) + ")"


_COUNTS_SQL = f"""{_AREAS_SQL}, {_EVENTS_SQL}, {_ranges_sql()}, counts AS (
  SELECT r."window", a.area_id, m.metric,
    (SELECT count(*) FROM events_ e WHERE e.area_id = a.area_id AND e.metric = m.metric AND e.date >= r."start" AND e.date <= r."end") AS count
  FROM ranges r, areas a, (VALUES ('m1'), ('m2'), ('m3')) AS m(metric))"""
_STATS_SQL = f"""{_COUNTS_SQL}, rated AS (
  SELECT c.*, CAST(count AS DOUBLE) / CAST(coalesce(nullif(population, 0), 40000) AS DOUBLE) * CAST(100000 AS DOUBLE) AS raw FROM counts c JOIN areas USING (area_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "window", metric ORDER BY raw, area_id) AS rank, count(*) OVER (PARTITION BY "window", metric) AS total FROM rated),
stats AS (SELECT "window", area_id, metric, count, {_half_up("raw", 2)} AS rate, rank, total, {_half_up("CAST(total - rank AS DOUBLE) / total * 100", 1)} AS percentile FROM ranked)"""
_MEASURES_SQL = f"""{_STATS_SQL}, amb AS (SELECT *, (coalesce(population, 0) * CAST(16 AS DOUBLE) + jobs * CAST(8 AS DOUBLE)) / CAST(24 AS DOUBLE) AS ambient FROM areas),
measures AS (
  SELECT "window", metric, 'count' AS measure, area_id, CAST(count AS DOUBLE) AS value FROM stats
  UNION ALL SELECT "window", metric, 'per100k', area_id, rate FROM stats
  UNION ALL SELECT "window", metric, 'perSqMi', area_id, CASE WHEN area_sq_mi > 0 THEN CAST(count AS DOUBLE) / area_sq_mi END FROM stats JOIN amb USING (area_id)
  UNION ALL SELECT "window", metric, 'ambient', area_id, CASE WHEN ambient > 0 THEN CAST(count AS DOUBLE) / ambient * 100000 END FROM stats JOIN amb USING (area_id))"""


@_query(f'WITH {_STATS_SQL} SELECT * FROM stats')
def area_stats_windows(spark, sf_dir):
    """The flagship: counts, rates, ranks and percentiles of every area, category and trailing window."""
    return _stats(spark, sf_dir)


@_query(f'WITH {_COUNTS_SQL} SELECT area_id, metric, ' + ", ".join(f"CAST(max(count) FILTER (WHERE \"window\" = '{w}') AS BIGINT) AS n_{w}" for w in dates.WINDOWS) + ' FROM counts GROUP BY area_id, metric HAVING max(count) > 0')
def area_counts_pivot(spark, sf_dir):
    """The same counts as conditional aggregates in one pass over the events."""
    one = _ranges(spark, sf_dir).groupBy("end").pivot("window", list(dates.WINDOWS)).agg(F.first("start"))
    rows = _events(spark, sf_dir).join(F.broadcast(one))
    sums = rows.groupBy("area_id", "metric").agg(*[F.count_if(F.col("date").between(F.col(w), F.col("end"))).alias(f"n_{w}") for w in dates.WINDOWS])
    return sums.where(F.greatest(*[f"n_{w}" for w in dates.WINDOWS]) > 0)


@_query(f'WITH {_ranges_sql(_CLIP)} SELECT * FROM ranges')
def window_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir, overflow=False)


@_query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS e FROM orders) " + " UNION ALL ".join(f"SELECT '{w}' AS \"window\", {_ROLL.format(m=m)} AS \"start\", e AS \"end\" FROM d" for w, m in dates.WINDOWS.items() if m))
def window_ranges_overflow(spark, sf_dir):
    """Every order date as an end date: days beyond a month's end roll into the next."""
    ends = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("end")).distinct()
    return dates.window_ranges(ends, True, [w for w, m in dates.WINDOWS.items() if m])


@_query(f"""WITH {_COUNTS_SQL}, p AS (SELECT area_id, borough, coalesce(nullif(population, 0), 40000) AS pop FROM areas)
SELECT "window", 'city' AS level, 'ALL' AS grp, metric, {_half_up("CAST(sum(count) AS DOUBLE) / CAST(sum(pop) AS DOUBLE) * CAST(100000 AS DOUBLE)", 2)} AS rate FROM counts JOIN p USING (area_id) GROUP BY "window", metric
UNION ALL SELECT "window", 'borough', borough, metric, {_half_up("CAST(sum(count) AS DOUBLE) / CAST(sum(pop) AS DOUBLE) * CAST(100000 AS DOUBLE)", 2)} FROM counts JOIN p USING (area_id) GROUP BY "window", borough, metric""")
def comparisons_grouping_sets(spark, sf_dir):
    return stats.comparisons(_counts(spark, sf_dir), _areas(spark, sf_dir))


@_query(f"WITH {_MEASURES_SQL} SELECT * FROM measures")
def measures_unpivot(spark, sf_dir):
    return stats.area_measures(_stats(spark, sf_dir), _areas(spark, sf_dir), _land(spark, sf_dir))


@_query(f'WITH {_MEASURES_SQL} SELECT *, CAST(rank() OVER (PARTITION BY "window", metric, measure ORDER BY value) AS BIGINT) AS risk_rank, count(*) OVER (PARTITION BY "window", metric, measure) AS total FROM measures WHERE value IS NOT NULL')
def risk_rank(spark, sf_dir):
    return stats.risk_ranks(measures_unpivot(spark, sf_dir))


@_query(f'WITH {_MEASURES_SQL} SELECT "window", metric, measure, area_id, {_half_up("percent_rank() OVER (PARTITION BY " + chr(34) + "window" + chr(34) + ", metric, measure ORDER BY value) * 100", 6)} AS position FROM measures WHERE value IS NOT NULL')
def dot_position(spark, sf_dir):
    out = stats.dot_positions(risk_rank(spark, sf_dir))
    return out.select("window", "metric", "measure", "area_id", numeric.half_up(F.col("position"), 6).alias("position"))


_CITY_SQL = f"""{_STATS_SQL}, city AS (
  SELECT "window", metric, CAST(sum(count) AS DOUBLE) AS n, CAST(sum(coalesce(population, 0)) AS DOUBLE) AS p,
    CAST(sum(coalesce(population, 0) * 16 + jobs * 8) AS DOUBLE) / CAST(24 AS DOUBLE) AS amb, sum(CASE WHEN area_sq_mi > 0 THEN area_sq_mi END) AS land
  FROM stats JOIN areas USING (area_id) GROUP BY "window", metric),
city_values AS (
  SELECT "window", metric, 'per100k' AS measure, n / p * 100000 AS city_value FROM city
  UNION ALL SELECT "window", metric, 'ambient', n / amb * 100000 FROM city UNION ALL SELECT "window", metric, 'perSqMi', n / land FROM city)"""


@_query(f"WITH {_CITY_SQL} SELECT * FROM city_values")
def city_reference(spark, sf_dir):
    return stats.city_values(_stats(spark, sf_dir), _areas(spark, sf_dir), _land(spark, sf_dir))


@_query(f"""WITH {_MEASURES_SQL.replace(_STATS_SQL, _CITY_SQL)}, r AS (SELECT m.*, value / city_value AS x FROM measures m JOIN city_values USING ("window", metric, measure) WHERE city_value > 0 AND value IS NOT NULL)
SELECT "window", metric, measure, area_id, CASE WHEN x >= 10 THEN CAST(CAST({_half_up("x", 0)} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {_half_up("x", 1)}) END || '×' AS multiple FROM r""")
def city_multiple(spark, sf_dir):
    rows = measures_unpivot(spark, sf_dir).join(city_reference(spark, sf_dir), ["window", "metric", "measure"])
    out = rows.withColumn("multiple", text.city_multiple(F.col("value"), F.col("city_value")))
    return out.where("multiple is not null").select("window", "metric", "measure", "area_id", "multiple")


# ---- source hygiene ---------------------------------------------------------------------------------------


@_query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v, 'historic' AS source, 0 AS r FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, o_totalprice + 1, 'current', 1 FROM orders WHERE o_orderkey % 3 <> 1)
SELECT id, arg_min(v, r) AS v, arg_min(source, r) AS source FROM a GROUP BY id""")
def merge_dedupe_sources(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    old = rows.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = rows.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("v"))
    return stats.merge_first({"historic": old, "current": new}, "id", ["v"])


@_query("SELECT greatest((SELECT CAST(max(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) AS data_through")
def data_through(spark, sf_dir):
    top = [_t(spark, sf_dir, t).agg(F.max(dates.to_iso_date(F.col(c))).alias(a)) for t, c, a in (("orders", "o_orderdate", "a"), ("lineitem", "l_shipdate", "b"))]
    return top[0].join(F.broadcast(top[1])).select(F.coalesce(F.greatest("a", "b"), F.current_date()).alias("data_through"))


@_query("""WITH j AS (SELECT l_partkey AS tract, year(l_shipdate) AS y, CAST(l_quantity AS BIGINT) AS jobs FROM lineitem),
t AS (SELECT tract, sum(jobs) AS jobs FROM j WHERE y = (SELECT max(y) FROM j) GROUP BY tract)
SELECT p_brand AS area, CAST(sum(coalesce(jobs, 0)) AS BIGINT) AS jobs FROM part LEFT JOIN t ON p_partkey = tract GROUP BY p_brand""")
def latest_partition_rollup(spark, sf_dir):
    """Jobs of the latest year by tract, then by area: tracts without jobs count 0."""
    jobs = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tract"), F.year("l_shipdate").alias("y"), F.col("l_quantity").cast("long").alias("jobs"))
    by_tract = stats.latest_only(jobs, "y").groupBy("tract").agg(F.sum("jobs").alias("jobs"))
    area = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("tract"), F.col("p_brand").alias("area"))
    return area.join(by_tract, "tract", "left").groupBy("area").agg(F.sum(F.coalesce("jobs", F.lit(0))).alias("jobs"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS area_id FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) OR n_nationkey = 0")
def completeness_guard(spark, sf_dir):
    """The areas a completeness check would name: no supplier with a balance, or none on record."""
    have = _t(spark, sf_dir, "supplier").where("s_acctbal > 0 and s_nationkey <> 0").groupBy(F.col("s_nationkey").cast("long").alias("area_id")).agg(F.count("*").alias("population"))
    areas = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("area_id")).join(have, "area_id", "left")
    return stats.incomplete(areas).select("area_id")


@_query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS kind, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS code, p_type FROM part)
SELECT p_partkey, CASE WHEN code = '' THEN p_type ELSE code END AS area_code FROM p WHERE kind IS NULL OR kind IN ('', '0')""")
def nonresidential_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "").when(F.col("p_size") % 5 == 2, "0").otherwise(F.col("p_size").cast("string"))
    code = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    return spatial.residential(rows.withColumn("kind", kind), "kind").select("p_partkey", F.coalesce(F.nullif(code, F.lit("")), "p_type").alias("area_code"))


@_query("SELECT p_brand AS b, p_size AS s, count(*) AS n, count(DISTINCT p_type) AS types FROM part WHERE upper(p_brand) IN ('BRAND#12', 'BRAND#23', 'BRAND#34') AND p_size BETWEEN 5 AND 40 GROUP BY ALL")
def offence_filter(spark, sf_dir):
    """Case-blind IN list and inclusive range, both pushed to the scan where they can be."""
    rows = _t(spark, sf_dir, "part").where(text.compare_key(F.col("p_brand")).isin("BRAND#12", "BRAND#23", "BRAND#34") & F.col("p_size").between(5, 40))
    return rows.groupBy(F.col("p_brand").alias("b"), F.col("p_size").alias("s")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"))


# ---- points and polygons ----------------------------------------------------------------------------------


def _ring(*points) -> list:
    return [(float(x), float(y)) for x, y in points]


def _box(x0, y0, x1, y1) -> list:
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


#: Literal areas: a grid, a hole, two parts, an overlap, an L, and gaps between.
SHAPES: list[tuple[int, list]] = [
    *[(4 * r + c, [[_box(-74.30 + 0.14 * c, 40.45 + 0.11 * r, -74.30 + 0.14 * c + 0.125, 40.45 + 0.11 * r + 0.1)]]) for r in range(3) for c in range(4)],
    (12, [[_box(-74.30, 40.79, -74.10, 40.95), _box(-74.25, 40.83, -74.15, 40.90)]]),
    (13, [[_box(-74.05, 40.79, -73.95, 40.85)], [_box(-73.93, 40.88, -73.80, 40.97)]]),
    (14, [[_box(-74.20, 40.60, -73.90, 40.85)]]),
    (15, [[_ring((-73.78, 40.46), (-73.62, 40.46), (-73.62, 40.60), (-73.70, 40.60), (-73.70, 40.75), (-73.78, 40.75))]]),
]


def _shapes(spark: SparkSession) -> DataFrame:
    rows = [(i, i, [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in polygons]) for i, polygons in SHAPES]
    return spark.createDataFrame(rows, f"area_id long, ord long, geometry {geo.GEOMETRY}")


def _edges_sql() -> str:
    rows = []
    for area, polygons in SHAPES:
        for p, polygon in enumerate(polygons):
            for r, ring in enumerate(polygon):
                for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
                    rows.append(f"({area},{p},{r},{k},{a[0]!r}::DOUBLE,{a[1]!r}::DOUBLE,{b[0]!r}::DOUBLE,{b[1]!r}::DOUBLE)")
    return "edges(area_id, part, ring, k, ax, ay, bx, by_) AS (VALUES " + ", ".join(rows) + ")"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lon = F.lit(-74.30) + (key * 7919 % 7001).cast("double") / F.lit(10000.0)
    lat = F.lit(40.45) + (key * 104729 % 5501).cast("double") / F.lit(10000.0)
    return _t(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 97 != 0, lon).alias("lon"), lat.alias("lat"))


_POINTS_SQL = """points AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 <> 0 THEN CAST(-74.30 AS DOUBLE) + CAST(c_custkey * 7919 % 7001 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lon,
  CAST(40.45 AS DOUBLE) + CAST(c_custkey * 104729 % 5501 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat FROM customer)"""
_INSIDE_SQL = f"""{_edges_sql()}, {_POINTS_SQL}, crossed AS (
  SELECT id, area_id, part, ring, count(*) % 2 AS odd FROM points JOIN edges ON (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / nullif(by_ - ay, 0) + ax GROUP BY ALL),
inside AS (SELECT DISTINCT id, area_id FROM (SELECT id, area_id, part FROM crossed GROUP BY ALL HAVING sum(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0))"""


@_query(f"WITH {_INSIDE_SQL} SELECT id, (SELECT CAST(min(area_id) AS BIGINT) FROM inside i WHERE i.id = p.id) AS area_id FROM points p")
def pip_assign(spark, sf_dir):
    """The first area that holds each point; overlaps go to the lower ordinal."""
    return spatial.assign_areas(_points(spark, sf_dir), _shapes(spark)).select("id", "area_id")


@_query(f"WITH {_INSIDE_SQL} SELECT id, (SELECT CAST(min(area_id) AS BIGINT) FROM inside i WHERE i.id = p.id) AS area_id FROM points p")
def pip_assign_grid(spark, sf_dir):
    """The same by grid cells, the way for areas too many to broadcast."""
    return spatial.assign_areas(_points(spark, sf_dir), _shapes(spark), max_points=0).select("id", "area_id")


@_query(f"WITH {_INSIDE_SQL} SELECT id FROM inside WHERE area_id = 12")
def pip_holes(spark, sf_dir):
    """Points in an area with a hole."""
    return spatial.assign_areas(_points(spark, sf_dir), _shapes(spark).where("area_id = 12")).where("area_id is not null").select("id")


@_query(f"WITH {_INSIDE_SQL}, f AS (SELECT id, (SELECT min(area_id) FROM inside i WHERE i.id = p.id) AS area_id FROM points p) SELECT CAST(coalesce(area_id, -1) AS BIGINT) AS area_id, count(*) AS n FROM f GROUP BY 1")
def pip_counts(spark, sf_dir):
    return pip_assign(spark, sf_dir).groupBy(F.coalesce("area_id", F.lit(-1)).cast("long").alias("area_id")).agg(F.count("*").alias("n"))


@_query(f"WITH {_edges_sql()} SELECT CAST(area_id AS BIGINT) AS area_id, min(ax) AS min_x, min(ay) AS min_y, max(ax) AS max_x, max(ay) AS max_y FROM edges GROUP BY area_id")
def area_bbox(spark, sf_dir):
    return _shapes(spark).select("area_id", geo.bbox(F.col("geometry")).alias("b")).select("area_id", "b.*")


_RING_SQL = f"""{_edges_sql()}, lat AS (SELECT area_id, part, ring, cos(radians(avg(ay))) AS s FROM edges GROUP BY ALL),
rings AS (SELECT area_id, part, ring, abs(sum(radians(ax) * 6378137.0::DOUBLE * s * radians(by_) * 6378137.0::DOUBLE - radians(bx) * 6378137.0::DOUBLE * s * radians(ay) * 6378137.0::DOUBLE)) / 2 AS m2 FROM edges JOIN lat USING (area_id, part, ring) GROUP BY ALL),
land AS (SELECT area_id, sum(m2) AS m2 FROM (SELECT area_id, part, greatest(0, sum(CASE WHEN ring = 0 THEN m2 ELSE -m2 END)) AS m2 FROM rings GROUP BY ALL) GROUP BY area_id)"""


@_query(f"WITH {_RING_SQL} SELECT CAST(area_id AS BIGINT) AS area_id, {_half_up('m2 / 2589988.110336::DOUBLE', 4)} AS area_sq_mi FROM land")
def geometry_area(spark, sf_dir):
    return spatial.prepare_areas(_shapes(spark)).select("area_id", numeric.half_up(F.col("area_sq_mi"), 4).alias("area_sq_mi"))


@_query(f"""WITH {_RING_SQL}, {_INSIDE_SQL.replace(_edges_sql() + ', ', '')}, f AS (SELECT (SELECT min(area_id) FROM inside i WHERE i.id = p.id) AS area_id FROM points p)
SELECT CAST(area_id AS BIGINT) AS area_id, {_half_up('count(*) / (any_value(m2) / 2589988.110336::DOUBLE)', 3)} AS per_sq_mi FROM f JOIN land USING (area_id) GROUP BY area_id""")
def density(spark, sf_dir):
    land = spatial.prepare_areas(_shapes(spark)).select("area_id", "area_sq_mi")
    n = pip_assign(spark, sf_dir).where("area_id is not null").groupBy("area_id").agg(F.count("*").alias("n"))
    return n.join(land, "area_id").select("area_id", numeric.half_up(F.col("n") / F.col("area_sq_mi"), 3).alias("per_sq_mi"))


# ---- pages, urls and labels -------------------------------------------------------------------------------


def _map_urls(spark, sf_dir):
    key = F.col("page_id")
    lat, lon = F.format_string("%.4f", F.lit(40.4) + (key * 37 % 700).cast("double") / 1000), F.format_string("%.4f", F.lit(-74.35) + (key * 53 % 800).cast("double") / 1000)
    base = F.lit("https://maps.example.net")
    made = (
        F.when(key % 6 == 0, F.concat(base, F.lit("/maps/place/"), lat, F.lit(","), lon))
        .when(key % 6 == 1, F.concat(base, F.lit("/maps/x/"), lat, F.lit(","), lon, F.lit(",15z")))
        .when(key % 6 == 2, F.concat(base, F.lit("/maps/@"), lat, F.lit(","), lon, F.lit(",17z")))
        .when(key % 6 == 3, F.concat(base, F.lit("/maps?q="), lat, F.lit(","), lon))
        .when(key % 6 == 4, F.concat(base, F.lit("/maps?z=1&center="), lat, F.lit("%2C"), lon, F.lit("#x")))
        .otherwise(F.col("url"))
    )
    return _t(spark, sf_dir, "pages").select("page_id", made.alias("link"))


@_query("""WITH p AS (SELECT page_id, printf('%.4f', CAST(40.4 AS DOUBLE) + CAST(page_id * 37 % 700 AS DOUBLE) / 1000) AS lat, printf('%.4f', CAST(-74.35 AS DOUBLE) + CAST(page_id * 53 % 800 AS DOUBLE) / 1000) AS lon FROM pages WHERE page_id % 6 < 5)
SELECT page_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM p WHERE CAST(lat AS DOUBLE) BETWEEN 40.45 AND 41.0 AND CAST(lon AS DOUBLE) BETWEEN -74.3 AND -73.6""")
def coord_parse_url(spark, sf_dir):
    """Coordinates of map links in five shapes, within plausible bounds."""
    return _map_urls(spark, sf_dir).withColumn("c", text.map_link_coordinates(F.col("link"))).where("c is not null").select("page_id", "c.lat", "c.lon")


@_query("""WITH e AS (SELECT event_id, CAST(40.4 AS DOUBLE) + CAST(event_id * 31 % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat, CAST(-74.3 AS DOUBLE) + CAST(event_id * 17 % 700 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon FROM events WHERE event_id % 4 < 3)
SELECT event_id, lat, lon FROM e WHERE lat BETWEEN 40.45 AND 41.0 AND lon BETWEEN -74.3 AND -73.6""")
def jsonld_geo(spark, sf_dir):
    """Coordinates in nested JSON-LD; what is no JSON gives none."""
    key = F.col("event_id")
    lat, lon = F.lit(40.4) + (key * 31 % 700).cast("double") / 1000, F.lit(-74.3) + (key * 17 % 700).cast("double") / 1000
    pair = F.concat(F.lit('{"latitude": "'), lat.cast("string"), F.lit('", "longitude": '), lon.cast("string"), F.lit("}"))
    doc = F.when(key % 4 == 0, F.concat(F.lit('{"@type": "Residence", "geo": '), pair, F.lit("}"))).when(key % 4 == 1, pair).when(key % 4 == 2, F.concat(F.lit('{"@graph": [{"a": 1}, {"geo": '), pair, F.lit("}]}"))).otherwise(F.lit("{broken"))
    return _t(spark, sf_dir, "events").select("event_id", text.json_ld_coordinates(doc).alias("c")).where("c is not null").select("event_id", "c.lat", "c.lon")


@_query("SELECT page_id, regexp_replace(url || '?a=1#b', '[?#].*$', '') AS url, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages")
def url_normalize(spark, sf_dir):
    url = F.concat("url", F.lit("?a=1#b"))
    return _t(spark, sf_dir, "pages").select("page_id", text.normalize_url(url).alias("url"), text.url_host(url).alias("host"))


@_query("SELECT page_id, 'photos.example.net/fp/h' || page_id AS base_hash, 'rental:st-' || page_id || ':' || (page_id % 9) AS listing FROM pages WHERE page_id % 10 <> 0")
def photo_base_hash(spark, sf_dir):
    """Stable photo keys and listing ids from made-up links; what is none gives null and goes."""
    key = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 10 == 0, "not a link").when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://Photos.example.net/fp/h"), key, F.lit("-se_medium_500"))).otherwise(F.concat(F.lit("https://photos.example.net/fp/h"), key, F.lit("-se_large_800_400.webp?x=1")))
    path = F.concat(F.lit("/rental/st-"), key, F.lit("/"), (F.col("page_id") % 9).cast("string"), F.lit("/"))
    out = _t(spark, sf_dir, "pages").select("page_id", text.photo_base_hash(link).alias("base_hash"), text.listing_id(path).alias("listing"))
    return out.where("base_hash is not null")


@_query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, title, length(title) > 5 AND length(title) < 200 AND regexp_matches(title, '\d') AS addressy FROM p WHERE title <> ''""")
def title_extract(spark, sf_dir):
    title = text.page_title(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", title.alias("title")).where("title is not null").select("page_id", "title", text.looks_like_address(F.col("title")).alias("addressy"))


@_query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN (100 + page_id) || ' East Street' WHEN 1 THEN (7 + page_id) || ' West Road #2' END || ', New York, NY' AS address,
CASE page_id % 3 WHEN 0 THEN 'Old Hill' WHEN 1 THEN 'Mid Town' END AS hood FROM pages WHERE page_id % 3 < 2""")
def title_address(spark, sf_dir):
    key = F.col("page_id")
    title = F.when(key % 3 == 0, F.concat(F.lit("Flat  at "), (key + 100).cast("string"), F.lit(" East   Street in Old Hill | Rooms"))).when(key % 3 == 1, F.concat((key + 7).cast("string"), F.lit(" West Road #2 IN Mid Town: sale"))).otherwise(F.lit("Home page"))
    out = _t(spark, sf_dir, "pages").select("page_id", text.with_city(text.title_address(title)).alias("address"), text.title_neighbourhood(title).alias("hood"))
    return out.where("address is not null")


@_query("SELECT conv_id, turn, CAST(turn + 1 AS BIGINT) AS position, n AS total FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id)")
def position_labels(spark, sf_dir):
    """Positions read from labels such as `Image preview button, 3 of 11`."""
    total = F.count("*").over(Window.partitionBy("conv_id"))
    label = F.concat(F.lit("Image preview button, "), (F.col("turn") + 1).cast("string"), F.lit(" of "), total.cast("string"))
    return _t(spark, sf_dir, "conversations").withColumn("p", text.position_label(label)).select("conv_id", "turn", "p.position", "p.total")


@_query("SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id % 7 END NULLS LAST, page_id) AS place FROM pages")
def position_join(spark, sf_dir):
    """Photos in the carousel order of their listing: unplaced ones, position 0 among them, last."""
    pages = _t(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("listing"))
    positions = pages.where("page_id % 2 = 0 or page_id % 7 <> 0").select("page_id", (F.col("page_id") % 7).alias("position"))
    return store.carousel_places(pages, positions, "listing", "page_id").select("page_id", "place")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 1000 THEN regexp_replace(reverse(regexp_replace(reverse(CAST(CAST(floor(l_extendedprice + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)), '(\\d{3})(?=\\d)', '\\1,', 'g')), '^,', '') ELSE printf('%.1f', floor(l_extendedprice * 10::DOUBLE + 0.5::DOUBLE) / 10::DOUBLE) END AS shown FROM lineitem".replace("(\\d{3})(?=\\d)", "(\\d\\d\\d)"))
def format_rates(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_rate(F.col("l_extendedprice")).alias("shown"))


@_query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# ---- the store --------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 11 == 0, "delete").otherwise("write")
    return events.select("event_id", "user_id", op.alias("op"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("label"), "value")


@_query("""WITH l AS (SELECT *, max(CASE WHEN event_id % 11 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM events)
SELECT user_id, min(event_id) AS created, max(event_id) AS touched, count(*) AS writes, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS label FROM l WHERE cut IS NULL OR event_id > cut GROUP BY user_id""")
def upsert_log_fold(spark, sf_dir):
    """The store's state after a log of writes and deletes."""
    return store.fold_log(_log(spark, sf_dir), "user_id", "event_id")


@_query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    return store.latest(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id"], ["event_id"])


@_query("""SELECT c_custkey, CASE WHEN s.s_suppkey IS NOT NULL AND s_acctbal > 0 THEN s_name ELSE c_name END AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer LEFT JOIN supplier s ON c_custkey = s_suppkey""")
def partial_update(spark, sf_dir):
    """A change replaces only what it states, and only where the key is known."""
    base = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    change = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("balance"))
    return store.partial_update(base, change, ["c_custkey"], ["name", "balance"])


@_query("SELECT 'listing' AS kind, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 0 UNION ALL SELECT 'photo', count(*) FROM conversations WHERE conv_id % 5 <> 0")
def cascade_delete(spark, sf_dir):
    photos = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    listings = photos.select("conv_id").distinct()
    left, rest = store.cascade_delete(listings, photos, listings.where("conv_id % 5 = 0"), "conv_id")
    return left.agg(F.count("*").alias("n")).select(F.lit("listing").alias("kind"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("photo").alias("kind"), "n"))


@_query("""WITH x AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS merged FROM x GROUP BY user_id""")
def map_merge(spark, sf_dir):
    rows = store.map_merge(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "event_id")
    return rows.select("user_id", F.array_join(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("merged"))


@_query("""WITH p AS (SELECT conv_id, count(*) AS n_photos, count(CASE WHEN turn % 2 = 0 THEN 1 END) AS n_analyzed, max(turn) AS updated_at FROM conversations GROUP BY conv_id) SELECT * FROM p""")
def listing_history(spark, sf_dir):
    photos = _t(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, F.length("text")).alias("estimated_sqft"), "turn")
    listings = photos.groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    return store.history(listings, photos, "conv_id").select("conv_id", "n_photos", "n_analyzed", "updated_at")


@_query("SELECT conv_id, string_agg(DISTINCT trim(role), '|' ORDER BY trim(role)) AS labels FROM conversations WHERE trim(role) <> '' GROUP BY conv_id")
def labels_distinct(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("label", text.clean_label(F.col("role"))).where("label <> ''")
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


@_query("SELECT user_id, max(event_id) AS token, arg_max(event_type, event_id) AS result FROM events GROUP BY user_id")
def superseded_token(spark, sf_dir):
    return store.newest_run(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@_query("SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def nav_changes(spark, sf_dir):
    return store.changes_of(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "before")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return store.debounce(_t(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")


# ---- robust statistics ------------------------------------------------------------------------------------


@_query("SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.02) AS q02, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.98) AS q98 FROM lineitem GROUP BY ALL")
def quantiles(spark, sf_dir):
    return robust.quantiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.02, 0.5, 0.98])


_WMED_SQL = """SELECT {k}, min({v}) AS {a} FROM (SELECT *, sum({w}) OVER (PARTITION BY {k} ORDER BY {v}) AS run, sum({w}) OVER (PARTITION BY {k}) AS tot FROM {t}) WHERE run * 2 >= tot GROUP BY {k}"""


@_query("WITH l AS (SELECT l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT) AS q FROM lineitem) " + _WMED_SQL.format(k="l_suppkey", v="l_extendedprice", w="q", a="weighted_median", t="l"))
def weighted_median(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    return robust.weighted_median(rows, ["l_suppkey"], "l_extendedprice", "q")


_MAD_SQL = """mid AS (SELECT l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL), dev AS (SELECT l.*, abs(l_extendedprice - m) AS off FROM lineitem l JOIN mid USING (l_suppkey)),
mad AS (SELECT l_suppkey, median(off) * CAST(1.4826 AS DOUBLE) AS mad FROM dev GROUP BY ALL), kept AS (SELECT dev.* FROM dev JOIN mad USING (l_suppkey) WHERE mad <= 0 OR off / mad < {z})"""


@_query(f"WITH {_MAD_SQL.format(z='1.2')} SELECT l_orderkey, l_linenumber, l_suppkey FROM kept")
def mad_inliers(spark, sf_dir):
    return robust.mad_inliers(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", limit=1.2).select("l_orderkey", "l_linenumber", "l_suppkey")


@_query("""WITH r AS (SELECT l_suppkey % 10 AS scene, l_suppkey AS image, l_extendedprice AS ratio, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
mid AS (SELECT scene, image, median(ratio) AS m FROM r GROUP BY ALL), dev AS (SELECT r.*, abs(ratio - m) AS off FROM r JOIN mid USING (scene, image)),
mad AS (SELECT scene, image, median(off) * CAST(1.4826 AS DOUBLE) AS mad FROM dev GROUP BY ALL), kept AS (SELECT dev.* FROM dev JOIN mad USING (scene, image) WHERE mad <= 0 OR off / mad < 3.5),
im AS (SELECT scene, image, median(ratio) AS ratio, sum(w) AS weight FROM kept GROUP BY ALL), sc AS (""" + _WMED_SQL.format(k="scene", v="ratio", w="weight", a="scale", t="im") + """)
SELECT scene, scale, median(abs(ratio - scale)) / scale AS rel_mad, count(*) AS n_images FROM im JOIN sc USING (scene) GROUP BY scene, scale""")
def scene_scale(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("scene"), F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("ratio"), F.col("l_quantity").cast("long").alias("w"))
    return robust.scene_scale(rows, "scene", "image", "ratio", "w")


@_query(f"""WITH e AS (SELECT event_type, event_id % 360 * pi() / 180 AS a, CAST(1 + event_id % 3 AS BIGINT) AS w FROM events), s AS (SELECT event_type, sum(w * sin(a * 2)) AS s, sum(w * cos(a * 2)) AS c, sum(w) AS w FROM e GROUP BY event_type)
SELECT event_type, {_half_up("atan2(s, c) / 2", 6)} AS mean_angle, {_half_up("sqrt(s * s + c * c) / w", 6)} AS concentration FROM s""")
def circular_mean(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", F.radians((F.col("event_id") % 360).cast("double")).alias("a"), (1 + F.col("event_id") % 3).alias("w"))
    out = robust.circular_mean(rows, ["event_type"], "a", "w", 2)
    return out.select("event_type", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("mean_angle", "concentration")])


@_query("SELECT l_suppkey, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS violation FROM lineitem GROUP BY l_suppkey")
def fractions(spark, sf_dir):
    return estimates.fraction(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_discount") > 0.05, "violation")


@_query("SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_cont(l_extendedprice, 0.75) ELSE max(l_extendedprice) END AS estimate, min(l_extendedprice) * CAST(0.9 AS DOUBLE) AS lo, max(l_extendedprice) * CAST(1.1 AS DOUBLE) AS hi FROM lineitem GROUP BY l_orderkey")
def fuse_p75(spark, sf_dir):
    return robust.fuse_estimates(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice")


@_query(f"""WITH f AS (SELECT l_orderkey, CASE WHEN count(*) >= 3 THEN quantile_cont(l_extendedprice, 0.75) ELSE max(l_extendedprice) END AS e, min(l_extendedprice) * CAST(0.9 AS DOUBLE) AS lo, max(l_extendedprice) * CAST(1.1 AS DOUBLE) AS hi FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {_half_up("greatest(CAST(0.05 AS DOUBLE), least(CAST(0.99 AS DOUBLE), CAST(1 AS DOUBLE) - (hi - lo) / greatest(e, CAST(1 AS DOUBLE))))", 9)} AS confidence FROM f""")
def ci_confidence(spark, sf_dir):
    out = fuse_p75(spark, sf_dir)
    return out.select("l_orderkey", numeric.half_up(numeric.confidence_from_interval(F.col("estimate"), F.col("lo"), F.col("hi")), 9).alias("confidence"))


@_query("""WITH l AS (SELECT *, l_discount < 0.02 AS ok FROM lineitem) SELECT l_orderkey, l_linenumber FROM l WHERE ok OR l_orderkey NOT IN (SELECT l_orderkey FROM l WHERE ok)""")
def quality_fallback(spark, sf_dir):
    """Rows of good residual in each group, or all of it where none is good."""
    return robust.keep_or_all(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_discount") < 0.02).select("l_orderkey", "l_linenumber")


@_query("SELECT * FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500")
def deterministic_sample(spark, sf_dir):
    """A sampling operator: the limit is what it is for."""
    return robust.deterministic_sample(_t(spark, sf_dir, "events"), "event_id", 500)


@_query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE (n - 1) % 5 = 0")
def stride_sample(spark, sf_dir):
    return robust.stride_sample(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], 5).select("event_id", "user_id")


@_query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topn(spark, sf_dir):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return robust.top_per_group(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber")


# ---- planes, cameras and layouts --------------------------------------------------------------------------


@_query(f"""SELECT l_orderkey, l_linenumber, {_half_up("(l_quantity * CAST(0.6 AS DOUBLE) + l_discount * CAST(0.8 AS DOUBLE)) - CAST(3 AS DOUBLE)", 6)} AS distance, {_half_up("l_quantity * cos(CAST(0.3 AS DOUBLE)) + l_tax * sin(CAST(0.3 AS DOUBLE))", 6)} AS u,
{_half_up("l_tax * cos(CAST(0.3 AS DOUBLE)) - l_quantity * sin(CAST(0.3 AS DOUBLE))", 6)} AS v FROM lineitem""")
def plane_project(spark, sf_dir):
    rows, zero = _t(spark, sf_dir, "lineitem"), F.lit(0.0)
    d = geo.plane_distance(F.col("l_quantity"), F.col("l_discount"), zero, F.lit(0.6), F.lit(0.8), zero, F.lit(-3.0))
    u, v = geo.rotate(F.col("l_quantity"), F.col("l_tax"), F.lit(0.3))
    return rows.select("l_orderkey", "l_linenumber", *[numeric.half_up(x, 6).alias(n) for x, n in ((d, "distance"), (u, "u"), (v, "v"))])


@_query(f"""SELECT l_orderkey, l_linenumber, {_half_up("CAST(500 AS DOUBLE) * l_discount / l_tax + CAST(320 AS DOUBLE)", 6)} AS px, {_half_up("CAST(500 AS DOUBLE) * l_quantity / l_tax + CAST(240 AS DOUBLE)", 6)} AS py FROM lineitem WHERE l_tax > 0.00001""")
def project_camera(spark, sf_dir):
    px, py = geo.project_pinhole(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"), 500.0, 500.0, 320.0, 240.0)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.half_up(px, 6).alias("px"), numeric.half_up(py, 6).alias("py")).where("px is not null")


@_query("""WITH p AS (SELECT l_partkey AS photo, l_orderkey % 50 AS r, l_suppkey % 20 AS c, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS wall, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS floor FROM lineitem GROUP BY ALL),
s AS (SELECT *, max(floor) OVER (PARTITION BY photo, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS below FROM p)
SELECT photo, CAST(floor(c / 4.0) AS BIGINT) AS bin, max(r) AS seam_row FROM s WHERE wall = 1 AND below = 1 GROUP BY 1, 2""")
def seam_runs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("photo"), (F.col("l_orderkey") % 50).alias("r"), (F.col("l_suppkey") % 20).alias("c"))
    pixels = rows.agg(F.max(F.col("l_quantity") > 25).alias("wall"), F.max(F.col("l_discount") > 0.05).alias("floor"))
    return robust.seam_rows(pixels, "photo", "r", "c", "wall", "floor")


@_query("""WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 140 AS DOUBLE) / 10 AS w, CAST(o_custkey % 130 AS DOUBLE) / 10 AS h FROM orders)
SELECT o_orderkey, CASE WHEN least(w, h) < 1.2 THEN 'room_dimension_too_small' WHEN greatest(w, h) > 12 THEN 'room_dimension_too_large' WHEN w * h > 80 THEN 'room_area_too_large' WHEN greatest(w, h) / least(w, h) > 5 THEN 'room_aspect_ratio_too_large' ELSE 'ok' END AS gate FROM d""")
def dimension_gate(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 140).cast("double") / 10).alias("w"), ((F.col("o_custkey") % 130).cast("double") / 10).alias("h"))
    return rows.select("o_orderkey", photo.dimension_gate(F.col("w"), F.col("h")).alias("gate"))


@_query("""WITH d AS (SELECT o_orderkey, o_orderkey % 3 + 2 AS real, CAST(o_custkey % 101 AS DOUBLE) / 100 AS c, o_orderkey % 4 AS walls, o_custkey % 7 = 0 AS bad, CAST(o_custkey % 10 AS DOUBLE) / 10 AS frame FROM orders)
SELECT o_orderkey, CASE WHEN bad OR c < 0.5 THEN 'visible_only' WHEN c >= CAST(0.7 AS DOUBLE) AND real = 4 AND walls >= 2 AND frame >= CAST(0.55 AS DOUBLE) THEN 'completed' ELSE 'low_confidence_completed' END AS status FROM d""")
def status_machine(spark, sf_dir):
    """The status of a layout from its reason, confidence, sides and frame."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    conf = (c % 101).cast("double") / 100
    reason = F.when(c % 7 == 0, "support_violation_too_high").when(conf < 0.5, "confidence_too_low")
    status = estimates.layout_status(reason, conf, k % 3 + 2, F.lit(0), k % 4, F.lit(0.97), (c % 10).cast("double") / 10)
    return _t(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@_query("""WITH b AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
d AS (SELECT a.label, a.id, b.id AS other, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM b a JOIN b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS r1, row_number() OVER (PARTITION BY other ORDER BY distance, id) AS r2 FROM d)
SELECT label, id, other, distance FROM x WHERE r1 = 1 AND r2 = 1""")
def mutual_nn(spark, sf_dir):
    """Mutual nearest descriptors of two views (even and odd ids) of each label."""
    rows = _t(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), matching.sign_bits(F.col("embedding")).alias("bits"))
    return matching.mutual_nearest(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["label"])


@_query("""WITH b AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
d AS (SELECT a.label, a.id, b.id AS other, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM b a JOIN b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1),
x AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second FROM d WINDOW w AS (PARTITION BY id ORDER BY distance, other))
SELECT label, id, other, distance FROM x WHERE r = 1 AND distance < second * CAST(0.9 AS DOUBLE)""")
def ratio_test(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), matching.sign_bits(F.col("embedding")).alias("bits"))
    return matching.ratio_test(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["label"], 0.9)


def _rooms(spark, sf_dir):
    """A photo a supplier, of a room whose sides follow from the supplier's key."""
    photos = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("photo_id"), (10 + F.col("s_suppkey") % 5).cast("int").alias("p_size"))
    return rooms.made_rooms(photos, rows=24, cols=36)


@_query()
def photo_area(spark, sf_dir):
    """Visible floor area of a made-up photo of a box room for every supplier."""
    return photo.visible_area(_rooms(spark, sf_dir))


# ---- scenes -----------------------------------------------------------------------------------------------


@_query("SELECT CAST(a.n_regionkey AS BIGINT) AS scene, CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def view_pairs(spark, sf_dir):
    views = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("scene"), F.col("n_nationkey").cast("long").alias("view"))
    return scene.complete_pairs(views, "scene", "view")


@_query(f"""WITH c AS (SELECT l_suppkey AS view, floor(l_quantity / CAST(5 AS DOUBLE)) AS cx, floor(l_discount / CAST(0.02 AS DOUBLE) * CAST(5 AS DOUBLE) / CAST(5 AS DOUBLE)) AS cy, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY ALL)
SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, {_half_up("avg(v)", 4)} AS v, count(*) AS n_views FROM c GROUP BY ALL""")
def cell_means(spark, sf_dir):
    """Atlas cells: a view counts once in a cell, by its last point there."""
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_quantity", (F.col("l_discount") / 0.02 * 5.0).alias("y"), F.col("l_extendedprice").alias("v"), F.lit(1).alias("g"))
    out = scene.cell_means(rows, ["g"], "l_suppkey", "o", "l_quantity", "y", 5.0, ["v"])
    return out.select("cx", "cy", numeric.half_up(F.col("v"), 4).alias("v"), "n_views")


@_query(f"""WITH p AS (SELECT l_suppkey, l_quantity * cos(CAST(0.4 AS DOUBLE)) + l_tax * sin(CAST(0.4 AS DOUBLE)) AS u, l_tax * cos(CAST(0.4 AS DOUBLE)) - l_quantity * sin(CAST(0.4 AS DOUBLE)) AS v FROM lineitem)
SELECT l_suppkey, {_half_up("max(u) - min(u)", 6)} AS width, {_half_up("max(v) - min(v)", 6)} AS depth FROM p GROUP BY l_suppkey""")
def oriented_extent(spark, sf_dir):
    out = scene.oriented_extent(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_tax", F.lit(0.4))
    return out.select("l_suppkey", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("width", "depth")])


@_query("""WITH e AS (SELECT l_suppkey % 25 AS k, (l_orderkey % 180) * pi() / 180 AS a, CAST(l_linenumber AS DOUBLE) AS len FROM lineitem),
g AS (SELECT k, s, sum(len * exp(-0.5 * power(least((a - s * pi() / 180) - floor((a - s * pi() / 180) / pi()) * pi(), pi() - ((a - s * pi() / 180) - floor((a - s * pi() / 180) / pi()) * pi())) / radians(11), 2))) AS score FROM e, range(0, 181) t(s) GROUP BY ALL)
SELECT k, floor(max(score) * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS score, CAST(arg_max(s % 180, (round(score, 6), -s)) AS BIGINT) AS degrees FROM g GROUP BY k""")
def dominant_angle(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("k"), F.radians((F.col("l_orderkey") % 180).cast("double")).alias("a"), F.col("l_linenumber").cast("double").alias("len"))
    degrees = F.floor(F.degrees("angle") + 0.5) % 180
    return scene.dominant_angle(edges, "k", "a", "len").select("k", numeric.half_up(F.col("score"), 3).alias("score"), degrees.alias("degrees"))


@_query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) = 1")
def best_per_side(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return scene.best_per_side(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "o").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@_query("""SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) ELSE 'auto' END AS mode, CAST(greatest(20, least(600, event_id % 1000)) AS BIGINT) AS iterations FROM events""")
def settings_sanitize(spark, sf_dir):
    """Enumerated settings with a default, and a clamped count."""
    return _t(spark, sf_dir, "events").select("event_id", text.one_of(F.col("event_type"), ("click", "view"), "auto").alias("mode"), numeric.clamp(F.col("event_id") % 1000, 20, 600).cast("long").alias("iterations"))


@_query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def saved_semi(spark, sf_dir):
    """Rows whose successor is stored already."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi")


@_query(f"""WITH m AS (SELECT event_id, CAST(user_id % 20 AS BIGINT) AS photo, greatest(0, least(39, floor(value / CAST(3 AS DOUBLE) + CAST(0.5 AS DOUBLE)))) AS c FROM events),
p AS (SELECT l_suppkey % 20 AS photo, l_orderkey % 40 AS c, max(l_extendedprice) AS x FROM lineitem GROUP BY ALL) SELECT event_id, x FROM m JOIN p USING (photo, c)""")
def pixel_lookup(spark, sf_dir):
    """Matches looked up at the pixel they round to, clipped to the image."""
    matches = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("photo"), (F.col("value") / 3.0).alias("u"), F.lit(0.2).alias("v"))
    pixels = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("photo"), (F.col("l_orderkey") % 40).cast("int").alias("col")).agg(F.max("l_extendedprice").alias("x")).withColumn("row", F.lit(0))
    return scene.lookup_pixels(matches, pixels, ["photo"], "u", "v", 40, 1, ["x"]).select("event_id", "x")


@_query()
def similarity_transform(spark, sf_dir):
    """Similarity transforms between the embeddings' first and second triples, by label."""
    rows = _t(spark, sf_dir, "embeddings").select("label", *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(("ax", "ay", "az", "bx", "by", "bz"))])
    return scene.similarity_transforms(rows, "label")


@_query()
def stats_document(spark, sf_dir):
    """The statistics as one JSON text a window."""
    from ..sources.tables import stats_document as document

    return document(_stats(spark, sf_dir))


from . import further, layouts, poses  # noqa: E402,F401 - register their queries here
