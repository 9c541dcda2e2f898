"""Further registered queries: place reports, documents, messages, estimates of listings, layouts, lines and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..operators import estimates, lookup, photo, robust, room, scene, spatial, stats, store
from . import catalogue as base
from .catalogue import _AREAS_SQL, _CITY_SQL, _INSIDE_SQL, _MEASURES_SQL, _STATS_SQL, _half_up, _query, _ranges_sql, _t

# ---- place reports and documents --------------------------------------------------------------------------


@_query(f"""WITH {_INSIDE_SQL}, {_MEASURES_SQL.replace(_STATS_SQL, _CITY_SQL)}, own AS (SELECT * FROM measures WHERE "window" = '12m'),
r AS (SELECT metric, measure, area_id, CAST(rank() OVER (PARTITION BY metric, measure ORDER BY value) AS BIGINT) AS risk_rank, count(*) OVER (PARTITION BY metric, measure) AS total FROM own WHERE value IS NOT NULL),
f AS (SELECT id, min(area_id) AS area_id FROM inside GROUP BY id)
SELECT id, CAST(area_id AS BIGINT) AS area_id, metric, measure, value, risk_rank, total, city_value FROM f JOIN own USING (area_id) LEFT JOIN r USING (metric, measure, area_id)
LEFT JOIN (SELECT metric, measure, city_value FROM city_values WHERE "window" = '12m') USING (metric, measure)""")
def point_statistics(spark, sf_dir):
    """Every point's report: measures, ranks and city values of its area in one window."""
    return lookup.point_statistics(base._points(spark, sf_dir), base._shapes(spark), base._stats(spark, sf_dir), base._areas(spark, sf_dir), base._land(spark, sf_dir), "12m")


_RATES_SQL = base.ORACLES["comparisons_grouping_sets"]


@_query(f"""WITH c AS ({_RATES_SQL}), n AS (SELECT CAST(n_nationkey AS BIGINT) AS area_id, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT area_id, x.metric, x.rate AS city_rate, y.rate AS borough_rate FROM n JOIN c x ON x.level = 'city' AND x."window" = '6m' LEFT JOIN c y ON y.level = 'borough' AND y."window" = '6m' AND y.grp = borough AND y.metric = x.metric""")
def area_comparisons(spark, sf_dir):
    return lookup.area_comparisons(base._areas(spark, sf_dir), base.comparisons_grouping_sets(spark, sf_dir), "6m")


@_query("SELECT c_custkey, coalesce(s_name, 'none') AS s_name, coalesce(s_acctbal, CAST(-1 AS DOUBLE)) AS s_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def keyed_value(spark, sf_dir):
    """A keyed get with defaults, for every key at once."""
    table = _t(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "c_custkey")
    return lookup.keyed_value(_t(spark, sf_dir, "customer").select("c_custkey"), table, "c_custkey", {"s_name": "none", "s_acctbal": -1.0})


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'auto' END AS mode, '20' AS rounds FROM events")
def default_settings(spark, sf_dir):
    """Settings that are given over the defaults."""
    given = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("mode"), F.col("event_type")))
    both = lookup.with_defaults(given, {"mode": "auto", "rounds": "20"})
    return _t(spark, sf_dir, "events").select("event_id", both["mode"].alias("mode"), both["rounds"].alias("rounds"))


def _document(spark, sf_dir):
    return lookup.whole_document(base._stats(spark, sf_dir), base.comparisons_grouping_sets(spark, sf_dir), base.data_through(spark, sf_dir))


@_query(f"WITH {_STATS_SQL} SELECT * FROM stats")
def document_round_trip(spark, sf_dir):
    """The whole document written as JSON and its statistics read again."""
    return lookup.document_statistics(_document(spark, sf_dir))


@_query(_RATES_SQL)
def document_comparisons(spark, sf_dir):
    return lookup.document_comparisons(_document(spark, sf_dir))


@_query("SELECT w.w AS \"window\", strftime(greatest((SELECT CAST(max(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)), '%Y-%m-%d') AS through, '1.0.0' AS version FROM (VALUES " + ", ".join(f"('{w}')" for w in dates.WINDOWS) + ") w(w)")
def document_fields(spark, sf_dir):
    """Freshness and method version of the whole document."""
    return _document(spark, sf_dir).select("window", "through", "version")


@_query("""SELECT '{"count":' || count(*) || ',"regions":{' || string_agg('"' || k || '":"{\\"r_name\\":\\"' || r_name || '\\"}"', ',' ORDER BY k) || '}}' AS document FROM (SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name FROM region)""")
def compact_document(spark, sf_dir):
    rows = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return lookup.compact_document(rows, "r_regionkey", "regions")


@_query(f"SELECT l_orderkey, l_linenumber, {_half_up('l_extendedprice / 7', 1)} AS price, {_half_up('l_discount / 3', 3)} AS discount, l_returnflag FROM lineitem")
def rounded_result(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("price"), (F.col("l_discount") / 3).alias("discount"), "l_returnflag")
    return lookup.rounded(rows, {"price": 1, "discount": 3})


@_query(f"WITH {_ranges_sql()} SELECT min(\"start\") AS earliest FROM ranges")
def earliest_start(spark, sf_dir):
    """Where a fetch must begin to serve every window."""
    return base._ranges(spark, sf_dir).agg(F.min("start").alias("earliest"))


@_query("SELECT list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS ids FROM nation")
def sorted_ids(spark, sf_dir):
    return base._areas(spark, sf_dir).agg(F.sort_array(F.collect_list("area_id")).alias("ids"))


@_query(f'WITH {_MEASURES_SQL} SELECT "window", metric, measure, area_id, row_number() OVER (PARTITION BY "window", metric, measure ORDER BY value, area_id) AS place FROM measures WHERE value IS NOT NULL')
def measure_order(spark, sf_dir):
    """Values in order, ties by area."""
    from pyspark.sql import Window

    by = Window.partitionBy("window", "metric", "measure").orderBy("value", "area_id")
    rows = base.measures_unpivot(spark, sf_dir).where("value is not null")
    return rows.select("window", "metric", "measure", "area_id", F.row_number().over(by).cast("long").alias("place"))


@_query("SELECT event_id, coalesce(list_position(['purchase', 'view', 'click'], event_type), 4) AS place FROM events")
def display_order(spark, sf_dir):
    """A fixed order of display; what it does not name comes last."""
    rows = lookup.in_order(_t(spark, sf_dir, "events"), "event_type", ["purchase", "view", "click"])
    return rows.select("event_id", "place")


@_query("SELECT c_custkey AS id, c_acctbal AS v, 'residents' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'jobs' FROM supplier UNION ALL SELECT p_partkey, p_retailprice, 'parts' FROM part WHERE p_size > 25")
def tagged_union(spark, sf_dir):
    """Clouds of several sources under one another, with their source."""
    parts = _t(spark, sf_dir, "part").where("p_size > 25")
    rows = {"residents": ("customer", "c_custkey", "c_acctbal"), "jobs": ("supplier", "s_suppkey", "s_acctbal")}
    frames = {n: _t(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(v).alias("v")) for n, (t, k, v) in rows.items()}
    return lookup.tagged_union({**frames, "parts": parts.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))})


@_query("SELECT p_partkey, p_brand FROM part WHERE CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END IS NOT NULL")
def complete_rows(spark, sf_dir):
    """Rows without a null in any column."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("tract"))
    return rows.dropna("any").select("p_partkey", "p_brand")


# ---- messages and the store -------------------------------------------------------------------------------


@_query("""SELECT event_id, event_type IN ('click', 'view', 'purchase') AS handled,
CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NOT (event_type = 'click' AND user_id % 5 = 0 OR event_type IN ('click', 'view') AND event_id % 7 = 0) END AS success,
CASE WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'click needs listing' WHEN event_type IN ('click', 'view') AND event_id % 7 = 0 THEN event_type || ' needs photo' END AS error FROM events""")
def dispatch_messages(spark, sf_dir):
    """Typed messages: unknown types are ignored, incomplete ones answered with an error."""
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("listing"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("photo"))
    out = lookup.dispatch(rows, "event_type", {"click": ["listing", "photo"], "view": ["photo"], "purchase": []})
    return out.select("event_id", "handled", "success", "error")


@_query("""WITH e AS (SELECT user_id, event_id, CASE WHEN value > 90 THEN NULL ELSE value - 20 END AS v, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS p FROM events),
l AS (SELECT user_id, arg_max(coalesce(v, 0), event_id) AS v, arg_max(p, event_id) AS p FROM e GROUP BY user_id)
SELECT c_custkey, CASE WHEN l.user_id IS NULL THEN NULL ELSE CAST(greatest(0, floor(v + CAST(0.5 AS DOUBLE))) AS BIGINT) END AS sqft, CASE WHEN l.user_id IS NULL THEN NULL WHEN p = '' THEN 'inbrowser' ELSE p END AS pipeline, c_name FROM customer LEFT JOIN l ON c_custkey = l.user_id""")
def write_estimates(spark, sf_dir):
    """Estimates written to the photos that are there, the last of each."""
    photos = _t(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("long").alias("sqft"), F.lit(None).cast("string").alias("pipeline"), "c_name")
    sent = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("value") <= 90, F.col("value") - 20).alias("sqft"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("pipeline"), F.col("event_id").alias("seq"))
    return lookup.write_estimates(photos, sent, ["c_custkey"])


_LOG_SQL = "log AS (SELECT user_id AS listing, event_id AS seq, event_id % 6 AS photo, CASE event_type WHEN 'click' THEN 'save' WHEN 'purchase' THEN 'delete' WHEN 'view' THEN 'label' ELSE 'read' END AS op FROM events)"


@_query(f"""WITH {_LOG_SQL}, m AS (SELECT * FROM log WHERE op <> 'read'), t AS (SELECT listing, max(seq) AS changed_at, count(*) AS n_mutations FROM m WHERE seq > 500 GROUP BY listing),
s AS (SELECT listing, count(*) FILTER (WHERE op <> 'delete') AS n_children FROM (SELECT listing, photo, arg_max(op, seq) AS op FROM m GROUP BY ALL) GROUP BY listing)
SELECT listing, changed_at, n_children, n_mutations FROM t JOIN s USING (listing)""")
def change_feed(spark, sf_dir):
    """What a panel is told after mutations: the listings they touched and their state."""
    op = F.when(F.col("event_type") == "click", "save").when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "view", "label").otherwise("read")
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("listing"), F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("photo"), op.alias("op"))
    return lookup.change_feed(log, "listing", "seq", "photo", ["save", "delete", "label"], since=500)


@_query("SELECT page_id, CASE WHEN page_id % 10 < 5 THEN CAST(page_id % 9 AS BIGINT) END AS position FROM pages WHERE page_id % 10 <> 0")
def thumbnails_by_hash(spark, sf_dir):
    """Photos joined to carousel positions by what their links have in common."""
    key = F.col("page_id").cast("string")
    link = lambda size: F.concat(F.lit("https://photos.example.net/fp/h"), key, F.lit(size))
    pages = _t(spark, sf_dir, "pages").where("page_id % 10 <> 0")
    photos = pages.select("page_id", link("-se_large_800_400.webp?x=1").alias("photo_url"))
    thumbs = pages.where("page_id % 10 < 5").select(link("-se_small_100.jpg").alias("thumb_url"), (F.col("page_id") % 9).cast("long").alias("position"))
    return store.positions_by_hash(photos, thumbs, "photo_url", "thumb_url").select("page_id", "position")


# ---- estimates and layouts --------------------------------------------------------------------------------


def _images(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("listing"), F.when(F.col("l_linenumber") % 4 == 0, 0.0).otherwise(F.col("l_quantity")).alias("area"), F.col("l_tax").alias("residual"))


_FUSED_SQL = """im AS (SELECT l_orderkey AS listing, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity END AS area, l_tax AS residual FROM lineitem),
ok AS (SELECT * FROM im WHERE area > 0 AND (residual < CAST(0.03 AS DOUBLE) OR listing NOT IN (SELECT listing FROM im WHERE area > 0 AND residual < CAST(0.03 AS DOUBLE)))),
fu AS (SELECT listing, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_cont(area, 0.75) ELSE max(area) END AS estimate, min(area) * CAST(0.9 AS DOUBLE) AS lo, max(area) * CAST(1.1 AS DOUBLE) AS hi FROM ok GROUP BY listing),
fused AS (SELECT DISTINCT im.listing, coalesce(n, 0) AS n, coalesce(estimate, 0) AS estimate, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM im LEFT JOIN fu USING (listing))"""


@_query(f"WITH {_FUSED_SQL} SELECT listing, n, {_half_up('estimate', 6)} AS estimate, {_half_up('lo', 6)} AS lo, {_half_up('hi', 6)} AS hi FROM fused")
def fuse_areas(spark, sf_dir):
    """One area a listing from its images; zeros where no image has one."""
    out = estimates.fuse_areas(_images(spark, sf_dir), "listing", "area", "residual", within=0.03)
    return out.select("listing", "n", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("estimate", "lo", "hi")])


_SCENES_SQL = "sc AS (SELECT o_orderkey AS listing, CAST(o_orderkey % 31 + 4 AS DOUBLE) AS visible, CAST(o_orderkey % 31 + 4 AS DOUBLE) * CAST(1.25 AS DOUBLE) AS completed, CASE WHEN o_orderkey % 4 = 0 THEN 'too_few_views' END AS reason FROM orders)"


@_query(f"""WITH {_FUSED_SQL}, {_SCENES_SQL}, a AS (SELECT listing, count(*) AS n_images, min(area) FILTER (WHERE area > 0) AS lo_a, max(area) FILTER (WHERE area > 0) AS hi_a FROM im GROUP BY listing),
j AS (SELECT listing, n_images, estimate, lo, hi, visible, lo_a, hi_a, visible IS NOT NULL AND n_images >= 2 AS scene FROM a JOIN fused USING (listing) LEFT JOIN (SELECT * FROM sc WHERE reason IS NULL) USING (listing))
SELECT listing, n_images, CASE WHEN scene THEN 'multi-view' WHEN n_images = 1 THEN 'single-image' ELSE 'fallback' END AS method, {_half_up("CASE WHEN scene THEN visible ELSE estimate END", 6)} AS area_m2,
{_half_up("CASE WHEN scene THEN least(visible, coalesce(lo_a, visible)) ELSE lo END", 6)} AS lo_m2, {_half_up("CASE WHEN scene THEN greatest(visible, coalesce(hi_a, visible)) ELSE hi END", 6)} AS hi_m2 FROM j""")
def listing_estimates(spark, sf_dir):
    """The whole run of a listing: its scene where one was solved, else its images fused."""
    visible = (F.col("o_orderkey") % 31 + 4).cast("double")
    scenes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing"), visible.alias("visible_m2"), (visible * 1.25).alias("completed_m2"), F.when(F.col("o_orderkey") % 4 == 0, "too_few_views").alias("reason"))
    images = _images(spark, sf_dir).withColumn("residual", F.when(F.col("residual") < 0.03, 0.05).otherwise(0.2))
    out = estimates.listing_estimates(images, scenes, "listing", "area", "residual")
    return out.select("listing", "n_images", "method", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("area_m2", "lo_m2", "hi_m2")])


@_query(f"""WITH {_SCENES_SQL} SELECT listing, completed AS fused_m2, visible AS lo_m2, {_half_up("completed * CAST(1.5 AS DOUBLE)", 6)} AS hi_m2 FROM sc""")
def scene_bounds(spark, sf_dir):
    """Imputed rooms: the completed area between the visible floor and the upper rectangle."""
    visible = (F.col("o_orderkey") % 31 + 4).cast("double")
    scenes = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing"), visible.alias("visible_m2"), (visible * 1.25).alias("completed_m2"), (visible * 1.25 * 1.5).alias("rect_upper_m2"))
    out = estimates.scene_bounds(scenes, _images(spark, sf_dir), "listing", "area", impute=True)
    return out.withColumn("hi_m2", numeric.half_up(F.col("hi_m2"), 6))


@_query("""SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN 'single-image' WHEN event_type = 'click' THEN 'multi-view' WHEN event_type = 'view' THEN NULL WHEN user_id % 2 = 0 THEN 'single-image' ELSE 'multi-view' END AS method FROM events""")
def method_choice(spark, sf_dir):
    """One image is a single image; a request counts before the mode, and an unknown one is null."""
    asked = F.when(F.col("event_type") == "click", " Multi-View ").when(F.col("event_type") == "view", "other")
    mode = F.when(F.col("user_id") % 2 == 0, "single-image").otherwise("auto")
    return _t(spark, sf_dir, "events").select("event_id", estimates.choose_method(F.col("event_id") % 4, asked, mode).alias("method"))


@_query("""SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_quantity BETWEEN CAST(9.85 AS DOUBLE) AND CAST(40.15 AS DOUBLE) AND l_linenumber BETWEEN CAST(1.85 AS DOUBLE) AND CAST(5.15 AS DOUBLE)) AS DOUBLE) / count(*) AS contained,
CAST(count(*) FILTER (WHERE l_quantity < CAST(9.85 AS DOUBLE)) AS DOUBLE) / count(*) AS violation FROM lineitem GROUP BY l_suppkey""")
def support_fractions(spark, sf_dir):
    """Shares of support points inside a room's box and beyond one of its sides."""
    box = {"x_min": F.lit(10.0), "x_max": F.lit(40.0), "y_min": F.lit(2.0), "y_max": F.lit(5.0)}
    rows, x, y = _t(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_linenumber")
    inside = estimates.fraction(rows, ["l_suppkey"], estimates.containment(x, y, box, 0.15), "contained")
    return inside.join(estimates.fraction(rows, ["l_suppkey"], estimates.beyond_side(F.lit("x_min"), x, y, F.lit(10.0), 0.15), "violation"), "l_suppkey")


@_query(f"""WITH m AS (SELECT l_suppkey, avg(CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END * l_discount) AS x, avg(l_tax) AS y, avg(-l_discount) AS z FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, {_half_up("x / sqrt(x * x + y * y + z * z)", 6)} AS ux, {_half_up("y / sqrt(x * x + y * y + z * z)", 6)} AS uy, {_half_up("z / sqrt(x * x + y * y + z * z)", 6)} AS uz FROM m UNION ALL SELECT -1, 0, 0, 1""")
def mean_direction(spark, sf_dir):
    """Mean directions; one group's cancel out and it points straight up."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0)
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", (sign * F.col("l_discount")).alias("x"), F.col("l_tax").alias("y"), (-F.col("l_discount")).alias("z"))
    still = spark.createDataFrame([(-1, 1.0, 0.0, 0.5), (-1, -1.0, 0.0, -0.5)], rows.schema)
    out = estimates.mean_direction(rows.unionByName(still), ["l_suppkey"], ("x", "y", "z"))
    return out.select("l_suppkey", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("ux", "uy", "uz")])


@_query("SELECT l_suppkey % 10 AS scene, l_suppkey AS view, count(*) AS inliers FROM lineitem WHERE l_discount < 0.06 GROUP BY ALL")
def inliers_per_view(spark, sf_dir):
    """Points near the floor by the view they came from."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("scene"), F.col("l_suppkey").alias("view"), F.col("l_discount").alias("dist"))
    return rows.where("dist < 0.06").groupBy("scene", "view").agg(F.count("*").alias("inliers"))


@_query("SELECT conv_id, CAST(greatest(max(turn) + 1, count(*)) AS BIGINT) AS n_photos FROM conversations GROUP BY conv_id")
def carousel_size(spark, sf_dir):
    """The largest total that a carousel's labels name."""
    label = F.concat(F.lit("Image preview button, 1 of "), (F.greatest(F.max("turn") + 1, F.count("*"))).cast("string"))
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(label.alias("label"))
    return rows.withColumn("p", text.position_label(F.col("label"))).groupBy("conv_id").agg(F.max("p.total").cast("long").alias("n_photos"))


@_query(f"""SELECT l_suppkey, count(*) AS n, {_half_up("quantile_cont(l_extendedprice, 0.98) - quantile_cont(l_extendedprice, 0.02)", 6)} AS span, max(l_quantity) - min(l_quantity) AS height_span,
{_half_up("avg(l_discount * 10)", 9)} AS agreement, {_half_up("median(l_tax)", 9)} AS residual FROM lineitem GROUP BY l_suppkey""")
def line_statistics(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("along"), F.col("l_quantity").alias("height"), (F.col("l_discount") * 10).alias("agreement"), F.col("l_tax").alias("dist"))
    out = estimates.line_statistics(rows, "l_suppkey")
    return out.select("l_suppkey", "n", numeric.half_up(F.col("span"), 6).alias("span"), "height_span", *[numeric.half_up(F.col(c), 9).alias(c) for c in ("agreement", "residual")])


_UNIT = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {}))".format


@_query(f"""SELECT l_orderkey, l_linenumber, {_half_up(_UNIT("CAST(0.35 AS DOUBLE) * " + _UNIT("l_quantity * 20 / 450") + " + CAST(0.25 AS DOUBLE) * " + _UNIT("l_extendedprice / 40000 / CAST(2.5 AS DOUBLE)") + " + CAST(0.2 AS DOUBLE) * " + _UNIT("(l_discount * 10 - CAST(0.5 AS DOUBLE)) / CAST(0.4 AS DOUBLE)") + " + CAST(0.2 AS DOUBLE) * " + _UNIT("1 - l_tax / CAST(0.08 AS DOUBLE)")), 9)} AS confidence FROM lineitem""")
def wall_confidence(spark, sf_dir):
    value = estimates.wall_confidence(F.col("l_quantity") * 20, F.col("l_extendedprice") / 40000, F.col("l_discount") * 10, F.col("l_tax"), 150, 0.08)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.half_up(value, 9).alias("confidence"))


@_query(f"""WITH c AS (SELECT l_suppkey AS photo, l_returnflag AS side, l_orderkey * 10 + l_linenumber AS id, l_discount * 9 + CAST(0.35 AS DOUBLE) * {_UNIT("l_quantity * 5 / CAST(250 AS DOUBLE)")} + CAST(0.2 AS DOUBLE) * {_UNIT("l_extendedprice / 40000 / CAST(2.5 AS DOUBLE)")} - CAST(0.15 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), l_linenumber - CAST(1.5 AS DOUBLE)) - l_tax AS score FROM lineitem)
SELECT photo, side, id FROM c QUALIFY row_number() OVER (PARTITION BY photo, side ORDER BY score DESC, id) = 1""")
def select_sides(spark, sf_dir):
    """The best candidate of each side of each photo."""
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("photo"), F.col("l_returnflag").alias("side"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 9).alias("confidence"),
        (F.col("l_quantity") * 5).alias("seam_points"), (F.col("l_extendedprice") / 40000).alias("span"), F.col("l_linenumber").cast("double").alias("gap"), F.col("l_tax").alias("violation"),
    )
    return estimates.select_sides(rows, ["photo", "side"], "id").select("photo", "side", "id")


@_query("""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS photo, CASE WHEN k % 17 = 0 THEN 'floor_fit_failed' WHEN c % 13 = 0 THEN 'floor_plane_residual_too_high' WHEN k % 11 = 0 THEN 'camera_height_outside_gate' WHEN c % 11 = 0 THEN 'too_few_support_points'
WHEN k % 7 = 0 THEN 'fewer_than_two_reliable_wall_lines' WHEN c % 7 = 0 THEN 'weak_manhattan_frame' WHEN k % 5 = 0 THEN CASE WHEN c % 2 = 0 THEN 'more_than_one_missing_boundary' ELSE 'not_enough_boundaries' END
WHEN c % 5 = 0 THEN 'room_aspect_ratio_too_large' WHEN k % 3 = 0 THEN 'support_violation_too_high' WHEN c % 3 = 0 THEN 'support_containment_too_low' WHEN k % 8 = 1 THEN 'completed_area_smaller_than_visible_floor' WHEN c % 4 = 1 THEN 'fewer_than_three_real_boundaries' WHEN c % 4 = 2 THEN 'confidence_too_low' END AS reason FROM d""")
def layout_reasons(spark, sf_dir):
    """The first reason for which a layout stays with the visible floor."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    num = lambda test, yes, no: F.when(test, float(yes)).otherwise(float(no))
    columns = {
        "residual_median": F.when(k % 17 != 0, num(c % 13 == 0, 0.08, 0.01)), "residual_p95": F.lit(0.05), "camera_height": num(k % 11 == 0, 2.6, 1.5), "n_support": num(c % 11 == 0, 99, 100), "n_lines": num(k % 7 == 0, 1, 2),
        "concentration": num(c % 7 == 0, 0.39, 0.4), "n_missing": F.when(k % 5 == 0, num(c % 2 == 0, 2, 1)).otherwise(0.0), "violation": num(k % 3 == 0, 0.04, 0.03), "containment": num(c % 3 == 0, 0.96, 0.97),
        "area": num(k % 8 == 1, 9.4, 9.5), "visible": F.lit(10.0), "n_real": num(c % 4 == 1, 2, 3), "confidence": num(c % 4 == 2, 0.49, 0.5),
    }
    reason = estimates.layout_reason(columns, F.when(c % 5 == 0, "room_aspect_ratio_too_large").otherwise("ok"))
    return _t(spark, sf_dir, "orders").select(k.alias("photo"), reason.alias("reason"))


@_query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, CAST(1 + l_linenumber % 3 AS DOUBLE) AS a, CAST(l_linenumber % 2 AS DOUBLE) AS b, CAST(2 AS DOUBLE) AS d, CAST(l_linenumber % 4 AS DOUBLE) AS e, l_quantity AS x, l_discount AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, {_half_up("a * x + b * y + 3", 6)} AS u, {_half_up("d * x + e * y - 1", 6)} AS v, CASE WHEN abs(a * e - b * d) >= CAST(1e-8 AS DOUBLE) THEN {_half_up("x", 6)} END AS back_x, CASE WHEN abs(a * e - b * d) >= CAST(1e-8 AS DOUBLE) THEN {_half_up("y", 6)} END AS back_y FROM i""")
def affine_round_trip(spark, sf_dir):
    """Affine maps and their inverses; flat ones have none."""
    n = F.col("l_linenumber")
    m = [x.cast("double") for x in (1 + n % 3, n % 2, F.lit(3), F.lit(2), n % 4, F.lit(-1))]
    rows = _t(spark, sf_dir, "lineitem")
    u, v = estimates.affine(F.col("l_quantity"), F.col("l_discount"), m)
    x, y = estimates.affine(u, v, estimates.affine_inverse(m))
    return rows.select("l_orderkey", "l_linenumber", *[numeric.half_up(c, 6).alias(name) for c, name in ((u, "u"), (v, "v"), (x, "back_x"), (y, "back_y"))])


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN (l_tax + 1) * 640 ELSE l_quantity * 20 END AS fx, CASE WHEN l_linenumber % 2 = 0 THEN CAST(0.5 AS DOUBLE) * 480 ELSE 200 END AS cy FROM lineitem""")
def pixel_intrinsics(spark, sf_dir):
    """Focal lengths given as shares of the image become pixels; others stay."""
    share = F.col("l_linenumber") % 2 == 0
    fx, c = F.when(share, F.col("l_tax") + 1).otherwise(F.col("l_quantity") * 20), F.when(share, 0.5).otherwise(200.0)
    k = estimates.pixel_intrinsics(fx, F.when(share, fx).otherwise(F.lit(900.0)), c, c, F.lit(640), F.lit(480))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k["fx"].alias("fx"), k["cy"].alias("cy"))


@_query("SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 10 + l_linenumber AND l_quantity < 30 AND l_discount > CAST(0.015 AS DOUBLE) AND l_discount < CAST(0.075 AS DOUBLE)")
def inside_ring(spark, sf_dir):
    """Points inside the box of their own group, its left side included."""
    whole = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"), whole.alias("id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    edges = spark.createDataFrame([(k, *[float((10 + k, 30)[p[0]]) if i == 0 else (0.015, 0.075)[p[1]] for p in (a, b) for i in (0, 1)]) for k in range(1, 8) for a, b in zip(corners, corners[1:] + corners[:1])], "k int, ax double, ay double, bx double, by double")
    return estimates.inside_ring(rows, edges, "k", "id").select("id.*").distinct()


@_query("""WITH m AS (SELECT event_id, user_id % 20 AS photo, floor(value / 3 + CAST(0.5 AS DOUBLE)) AS c FROM events),
p AS (SELECT l_suppkey % 20 AS photo, l_orderkey % 40 AS c, max(l_extendedprice) AS x, max(l_quantity) AS z FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL) SELECT event_id, x AS a, z AS b FROM m JOIN p USING (photo, c) WHERE c BETWEEN 0 AND 39""")
def pixel_floor(spark, sf_dir):
    """Image points on the floor: the pixel they round to must lie in the image and be floor."""
    rows = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("photo"), (F.col("value") / 3).alias("u"), F.lit(0.2).alias("v"))
    pixels = _t(spark, sf_dir, "lineitem").where("l_discount > 0.02").groupBy((F.col("l_suppkey") % 20).alias("photo"), (F.col("l_orderkey") % 40).cast("int").alias("col")).agg(F.max("l_extendedprice").alias("a"), F.max("l_quantity").alias("b")).withColumn("row", F.lit(0))
    inside = rows.where((F.floor(F.col("u") + 0.5) >= 0) & (F.floor(F.col("u") + 0.5) < 40))
    return scene.lookup_pixels(inside, pixels, ["photo"], "u", "v", 40, 1, ["a", "b"]).select("event_id", "a", "b")


# ---- lines, floors and outlines of made-up rooms -----------------------------------------------------------


def _walls(spark, sf_dir):
    """Wall points of the made-up rooms in the floor plane, with a quarter metre of height to spare."""
    rows = base._rooms(spark, sf_dir).where(F.col("valid") & (F.col("cls") == photo.WALL) & (F.abs("ny") < 0.40))
    return rows.select("photo_id", F.col("x").alias("a"), F.col("z").alias("b"), F.col("nx").alias("na"), F.col("nz").alias("nb"), (1.5 - F.col("y")).alias("height"))


@_query("SELECT CAST(s_suppkey AS BIGINT) AS photo_id, CAST(floor((10 + s_suppkey % 5) / CAST(3 AS DOUBLE) * 4 + CAST(6.5 AS DOUBLE)) AS BIGINT) AS depth_quarters FROM supplier")
def wall_lines(spark, sf_dir):
    """The back wall of every made-up room, found among its lines to a quarter of a metre."""
    lines = room.wall_lines(_walls(spark, sf_dir), "photo_id", least=30, rounds=300)
    back = lines.where(F.abs(F.cos("theta")) > 0.9).groupBy("photo_id").agg(F.max(F.abs("offset")).alias("depth"))
    return back.select("photo_id", F.floor(F.col("depth") * 4 + 0.5).alias("depth_quarters"))


@_query("SELECT CAST(s_suppkey AS BIGINT) AS scene, true AS level, true AS at_height FROM supplier")
def scene_floor(spark, sf_dir):
    """The floor of every made-up room, told from its walls by level and by the camera above it."""
    rows = base._rooms(spark, sf_dir).where("valid").select(F.col("photo_id").alias("scene"), "x", "y", "z")
    eyes = rows.select("scene").distinct().select("scene", *[F.lit(0.0).alias(c) for c in ("cx", "cy", "cz", "ux")], F.lit(-1.0).alias("uy"), F.lit(0.0).alias("uz"))
    out = room.scene_floor(rows, eyes, "scene", stop=100)
    return out.select("scene", (F.abs("py") > 0.99).alias("level"), (F.abs(F.col("d") - 1.5) < 0.1).alias("at_height"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS view, CAST(5 + n_nationkey % 4 AS DOUBLE) * 4 - CAST(0.5 AS DOUBLE) AS area_m2, CAST(5 + n_nationkey % 4 AS DOUBLE) AS long_side, CAST(4 AS DOUBLE) AS short_side FROM nation")
def floor_outlines(spark, sf_dir):
    """Outlines of made-up floors, turned by the view's number, and the least rectangle around them; a missing metre of corner is cut along its diagonal."""
    k = F.col("n_nationkey")
    grid = _t(spark, sf_dir, "nation").select(k.cast("long").alias("view"), F.explode(F.sequence(F.lit(0), (5 + k % 4) * 5)).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(20))))
    flat = grid.select("view", (F.col("i") / 5.0).alias("u"), (F.col("j") / 5.0).alias("w")).where("u >= 1 or w >= 1")
    c, s = F.cos(F.col("view") * 0.1), F.sin(F.col("view") * 0.1)
    points = flat.select("view", (F.col("u") * c - F.col("w") * s).alias("a"), (F.col("u") * s + F.col("w") * c).alias("b"))
    out = room.floor_outlines(points, ["view"], least=100)
    near = lambda x: numeric.half_up(x, 1)
    return out.select("view", near(F.col("area_m2")).alias("area_m2"), near(F.greatest("width", "depth")).alias("long_side"), near(F.least("width", "depth")).alias("short_side"))


@_query("""SELECT label, count(*) AS n_inliers, CAST(2 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS rmse FROM embeddings WHERE vec_id % 5 > 0 GROUP BY label HAVING count(*) >= 6""")
def align_points(spark, sf_dir):
    """A turn, a scale of two and a shift found among pairs of which every fifth is wrong."""
    x, y, z = (F.get("embedding", F.lit(k)).cast("double") for k in range(3))
    off = F.when(F.col("vec_id") % 5 == 0, 50.0 + F.col("vec_id")).otherwise(0.0)
    pairs = _t(spark, sf_dir, "embeddings").select("label", x.alias("ax"), y.alias("ay"), z.alias("az"), (-2 * y + 1 + off).alias("bx"), (2 * x - 3).alias("by"), (2 * z + 0.5).alias("bz"))
    out = room.align_points(pairs, "label")
    return out.select("label", "n_inliers", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("scale", "rmse")])


# ---- roles, sides and saves -------------------------------------------------------------------------------


@_query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS up, l_quantity / 10 - CAST(0.5 AS DOUBLE) AS h FROM lineitem),
r AS (SELECT *, CASE WHEN l_linenumber = 3 AND abs(up) > CAST(0.7 AS DOUBLE) THEN 'floor' WHEN l_linenumber = 1 AND abs(up) < CAST(0.4 AS DOUBLE) THEN 'wall' WHEN l_linenumber IN (5, 7) THEN 'furniture' END AS role FROM p)
SELECT l_orderkey, l_linenumber, role FROM r WHERE role = 'floor' OR role = 'wall' AND h > CAST(0.25 AS DOUBLE) AND h < CAST(3.2 AS DOUBLE) OR role = 'furniture' AND h > CAST(-0.05 AS DOUBLE) AND h < CAST(2.2 AS DOUBLE)""")
def pixel_roles(spark, sf_dir):
    """Pixels by role, those at a height that suits it."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("role", estimates.pixel_role(F.col("l_linenumber"), F.col("l_discount") * 10, 3, 1, (5, 7)))
    return rows.where(estimates.in_height_band(F.col("role"), F.col("l_quantity") / 10 - 0.5)).select("l_orderkey", "l_linenumber", "role")


@_query("SELECT l_orderkey, l_linenumber, z FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity - 5 END AS z FROM lineitem) WHERE z > CAST(0.1 AS DOUBLE) AND z < CAST(40 AS DOUBLE) AND l_linenumber <> 4")
def depth_band(spark, sf_dir):
    """Finite points within matching depth; one line number has no depth, another no finite x."""
    z, x = F.when(F.col("l_linenumber") != 2, F.col("l_quantity") - 5), F.when(F.col("l_linenumber") == 4, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_discount").alias("y"), z.alias("z"))
    return estimates.finite_depth(rows, far=40.0).select("l_orderkey", "l_linenumber", "z")


@_query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_tax + 1 AS px, l_discount AS py, CAST(l_linenumber AS DOUBLE) AS pz, l_quantity - 25 AS d FROM lineitem), n AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS s FROM p)
SELECT l_orderkey, l_linenumber, {_half_up("CASE WHEN d < 0 THEN -px ELSE px END / s", 9)} AS px, {_half_up("abs(d) / s", 9)} AS camera_height FROM n""")
def camera_side(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") + 1).alias("px"), F.col("l_discount").alias("py"), F.col("l_linenumber").cast("double").alias("pz"), (F.col("l_quantity") - 25).alias("d"))
    return estimates.camera_side(rows).select("l_orderkey", "l_linenumber", *[numeric.half_up(F.col(c), 9).alias(c) for c in ("px", "camera_height")])


def _support(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("photo"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 30000).alias("y"))


_ENDS = "quantile_cont(x, 0.01) AS x_min, quantile_cont(x, 0.99) AS x_max, quantile_cont(y, 0.01) AS y_min, quantile_cont(y, 0.99) AS y_max"
_SEAM_SQL = f"""sup AS (SELECT l_suppkey % 20 AS photo, l_quantity / 10 AS x, l_extendedprice / 30000 AS y FROM lineitem), seam AS (SELECT * FROM sup WHERE x < CAST(0.45 AS DOUBLE) OR y > CAST(2.9 AS DOUBLE)),
se AS (SELECT photo, {_ENDS} FROM seam GROUP BY photo HAVING count(*) >= 20), su AS (SELECT photo, {_ENDS} FROM sup GROUP BY photo),
en AS (UNPIVOT se ON x_min, x_max, y_min, y_max INTO NAME side VALUE pos), ex AS (UNPIVOT su ON x_min, x_max, y_min, y_max INTO NAME side VALUE extent),
nr AS (SELECT photo, side, pos, CASE WHEN side LIKE 'x%' THEN y ELSE x END AS t FROM en JOIN seam USING (photo) WHERE abs(CASE WHEN side LIKE 'x%' THEN x ELSE y END - pos) < CAST(0.25 AS DOUBLE)),
sp AS (SELECT photo, side, pos, count(*) AS seam_points, quantile_cont(t, 0.95) - quantile_cont(t, 0.05) AS span FROM nr GROUP BY ALL HAVING count(*) >= 20),
vi AS (SELECT photo, side, CAST(count(*) FILTER (WHERE CASE side WHEN 'x_min' THEN x < pos - CAST(0.15 AS DOUBLE) WHEN 'x_max' THEN x > pos + CAST(0.15 AS DOUBLE) WHEN 'y_min' THEN y < pos - CAST(0.15 AS DOUBLE) ELSE y > pos + CAST(0.15 AS DOUBLE) END) AS DOUBLE) / count(*) AS violation FROM sp JOIN sup USING (photo) GROUP BY ALL)"""


@_query(f"""WITH {_SEAM_SQL} SELECT photo, side, seam_points, {_half_up("pos", 6)} AS at, {_half_up("span", 6)} AS span, {_half_up("violation", 6)} AS violation
FROM sp JOIN ex USING (photo, side) JOIN vi USING (photo, side) WHERE span >= CAST(0.25 AS DOUBLE) AND abs(pos - extent) <= CAST(0.6 AS DOUBLE) AND violation <= CAST(0.03 AS DOUBLE)""")
def seam_sides(spark, sf_dir):
    """Sides of rooms that only seams show."""
    support = _support(spark, sf_dir)
    out = estimates.seam_sides(support.where("x < 0.45d or y > 2.9d"), support, "photo")
    return out.select("photo", "side", "seam_points", *[numeric.half_up(F.col(c), 6).alias(c) for c in ("at", "span", "violation")])


@_query(f"""WITH sup AS (SELECT l_suppkey % 20 AS photo, l_quantity / 10 AS x, l_extendedprice / 30000 AS y FROM lineitem), su AS (SELECT photo, {_ENDS} FROM sup GROUP BY photo),
ex AS (UNPIVOT su ON x_min, x_max, y_min, y_max INTO NAME side VALUE extent)
SELECT photo, side, 1.0::DOUBLE AS at, false AS inferred FROM ex WHERE side <> CASE photo % 4 WHEN 0 THEN 'x_min' WHEN 1 THEN 'y_max' ELSE '' END AND NOT (photo % 4 = 3 AND side LIKE 'x%')
UNION ALL SELECT photo, side, {_half_up("extent", 6)}, true FROM ex WHERE side = CASE photo % 4 WHEN 0 THEN 'x_min' WHEN 1 THEN 'y_max' ELSE '' END""")
def inferred_sides(spark, sf_dir):
    """The fourth side of rooms with three: the end of their support."""
    support = _support(spark, sf_dir)
    every = estimates.support_extents(support, "photo").select("photo", "side", F.lit(1.0).alias("at"), F.lit(1.0).alias("span"), F.lit(0.9).alias("confidence"))
    left_out = F.when(F.col("photo") % 4 == 0, "x_min").when(F.col("photo") % 4 == 1, "y_max").otherwise("")
    known = every.where((F.col("side") != left_out) & ~((F.col("photo") % 4 == 3) & F.col("side").startswith("x")))
    out = estimates.infer_missing_side(known, support, "photo")
    return out.select("photo", "side", numeric.half_up(F.col("at"), 6).alias("at"), "inferred")


@_query("""WITH s AS (SELECT user_id AS c_custkey, arg_max(CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END, event_id) AS label FROM events GROUP BY user_id)
SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.label, c_mktsegment) AS label, c_acctbal FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN s ON c.c_custkey = s.c_custkey""")
def save_photos(spark, sf_dir):
    """Saves: labels of photos that are there change, others are added."""
    base_rows = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("label"), "c_acctbal")
    label = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(" "), "event_type", F.lit(" ")))
    saved = _t(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), label.alias("label"), F.col("event_id").alias("seq"))
    return store.save_photos(base_rows, saved, ["c_custkey"], "seq")
