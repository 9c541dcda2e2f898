"""What a place's report reads: statistics of points by area and window, comparisons, keyed look-ups, whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .spatial import assign_areas
from .stats import area_measures, city_values, risk_ranks

#: What one area's numbers are in a document.
ENTRY = "count long, rate double, rank long, total long, percentile double"
METHOD_VERSION = "1.0.0"


def point_statistics(points: DataFrame, shapes: DataFrame, stats: DataFrame, exposure: DataFrame, land: DataFrame, window: str = "24m") -> DataFrame:
    """Measures, risk ranks and city values of the area that holds each point, for one window.

    Columns id, area_id, metric, measure, value, risk_rank, total, city_value: a row for each of the area's
    metrics and measures. Points outside all areas, or in an area without statistics, have no row. The window is
    filtered before anything is ranked, and points only meet their own area's rows.
    """
    own = stats.where(F.col("window") == window)
    measures = area_measures(own, exposure, land)
    ranked = risk_ranks(measures).select("metric", "measure", "area_id", "risk_rank", "total")
    rows = measures.join(ranked, ["metric", "measure", "area_id"], "left").join(city_values(own, exposure, land).drop("window"), ["metric", "measure"], "left")
    placed = assign_areas(points, shapes).where("area_id is not null").select("id", "area_id")
    return placed.join(rows, "area_id").select("id", "area_id", "metric", "measure", "value", "risk_rank", "total", "city_value")


def area_comparisons(areas: DataFrame, comparisons: DataFrame, window: str = "24m") -> DataFrame:
    """The city's and the own borough's rate beside every area: area_id, metric, city_rate, borough_rate (null without one).

    Of several rows of one level, group and metric the largest rate counts.
    """
    own = comparisons.where(F.col("window") == window).groupBy("level", "grp", "metric").agg(F.max("rate").alias("rate"))
    city = own.where("level = 'city'").groupBy("metric").agg(F.max("rate").alias("city_rate"))
    borough = own.where("level = 'borough'").select(F.col("grp").alias("borough"), "metric", F.col("rate").alias("borough_rate"))
    # a city has one row a metric: the grid is areas by metrics, as the report has them
    return areas.select("area_id", "borough").join(F.broadcast(city)).join(borough, ["borough", "metric"], "left").select("area_id", "metric", "city_rate", "borough_rate")


def keyed_value(keys: DataFrame, table: DataFrame, key: str, columns: dict[str, object], order: str | None = None) -> DataFrame:
    """Keys with the columns of their row in a table, or each column's default where there is no row or no value.

    A key has one answer: of several rows the last by `order`, or the greatest by its columns where no order is given.
    """
    row = F.struct(*columns)
    one = table.groupBy(key).agg(F.max_by(row, F.struct(order, row) if order else row).alias("_row")).select(key, "_row.*")
    found = keys.join(one, key, "left")
    return found.select(*keys.columns, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in columns.items()])


def with_defaults(given: Column, defaults: dict[str, str]) -> Column:
    """A map of settings over a map of defaults: what is given wins."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.when(given.isNull(), base).otherwise(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given))


def whole_document(stats: DataFrame, comparisons: DataFrame, through: DataFrame, version: str = METHOD_VERSION) -> DataFrame:
    """The statistics as rows of one nested document: a row a window with `stats`, `comparisons` and the document's own fields as JSON text.

    Columns window, through (date text; today where there is none), version, stats (areas to metrics to numbers)
    and comparisons (a JSON array of level, group or null, metric, to rate), keys in order. A window's areas are what a report has.
    """
    entry = F.struct("count", "rate", "rank", "total", "percentile")
    metrics = stats.groupBy("window", F.col("area_id").cast("string").alias("area_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), entry.alias("value"))))).alias("metrics"))
    areas = metrics.groupBy("window").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("area_id", F.to_json("metrics").alias("metrics")))))).alias("stats"))
    named = comparisons.withColumn("name", F.to_json(F.array("level", "grp", "metric")))
    rates = named.groupBy("window").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rate"))))).alias("comparisons"))
    day = through.select(F.date_format(F.coalesce("data_through", F.current_date()), "yyyy-MM-dd").alias("through"))
    return areas.join(rates, "window", "left").join(F.broadcast(day)).select("window", "through", F.lit(version).alias("version"), "stats", "comparisons")


def document_statistics(document: DataFrame) -> DataFrame:
    """The rows of whole_document() again: window, area_id, metric, count, rate, rank, total, percentile."""
    areas = document.select("window", F.explode(F.from_json("stats", "map<string,string>")).alias("area_id", "body"))
    rows = areas.select("window", "area_id", F.explode(F.from_json("body", f"map<string,struct<{ENTRY.replace(' ', ':')}>>".replace(",:", ","))).alias("metric", "e"))
    return rows.select("window", F.col("area_id").cast("long").alias("area_id"), "metric", "e.*")


def document_comparisons(document: DataFrame) -> DataFrame:
    """The comparisons of whole_document() again: window, level, grp, metric, rate."""
    rows = document.select("window", F.explode(F.from_json("comparisons", "map<string,double>")).alias("name", "rate"))
    part = F.from_json("name", "array<string>")
    return rows.select("window", part[0].alias("level"), part[1].alias("grp"), part[2].alias("metric"), "rate")


def compact_document(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One JSON text of a small dimension: {"count": n, name: {key: row, ...}}, keys in order."""
    body = F.struct(*[c for c in rows.columns if c != key])
    whole = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))))).alias("m"))
    return whole.select(F.to_json(F.struct(F.size("m").alias("count"), F.col("m").alias(name))).alias("document"))


def rounded(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    """Some columns rounded half up, each to its own places; nulls stay."""
    return rows.select(*[half_up(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in rows.columns])


def in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Adds `place`: where a column's value stands in a fixed order, from 1; values outside it come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return rows.withColumn("place", F.when(at > 0, at).otherwise(len(order) + 1).cast("int"))


def tagged_union(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of several sources with equal columns under one another, each with its source's name."""
    out = None
    for name, df in sources.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def dispatch(messages: DataFrame, kind: str, needs: dict[str, list[str]]) -> DataFrame:
    """What becomes of typed messages: adds handled, success and error.

    Types outside `needs` are ignored (handled false, the rest null); of the others every column that the
    type needs must have a value, or success is false and error names the first that lacks one.
    """
    known = F.col(kind).isin(*needs)
    missing = F.coalesce(*[F.when((F.col(kind) == k) & F.col(c).isNull(), F.lit(f"{k} needs {c}")) for k, cs in needs.items() for c in cs])
    return messages.withColumn("handled", F.coalesce(known, F.lit(False))).withColumn("error", F.when(F.col("handled"), missing)).withColumn("success", F.when(F.col("handled"), F.col("error").isNull()))


def write_estimates(photos: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Photos with the estimates written to them: whole square feet, 0 at least (0 for no number), and their pipeline, "inbrowser" if none is named.

    Only photos that are there are written; of several estimates of one photo the last by `seq` counts.
    """
    value = F.col("sqft").try_cast("double")
    clean = F.greatest(F.lit(0), F.floor(F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value) + 0.5)).cast("long")
    last = estimates.groupBy(*keys).agg(F.max_by(F.struct(clean.alias("sqft"), F.coalesce(F.nullif("pipeline", F.lit("")), F.lit("inbrowser")).alias("pipeline")), "seq").alias("new"))
    kept = [c for c in photos.columns if c not in (*keys, "sqft", "pipeline")]
    return photos.join(last, keys, "left").select(*keys, F.coalesce("new.sqft", "sqft").alias("sqft"), F.coalesce("new.pipeline", "pipeline").alias("pipeline"), *kept)


def change_feed(log: DataFrame, key: str, order: str, child: str, mutations: list[str], since: int) -> DataFrame:
    """Keys that a mutation after `since` touched, with their state then: key, changed_at, n_children, n_mutations.

    Other messages change nothing and give no row. State is what the whole log up to now leaves: a child counts
    unless its last mutation is a delete.
    """
    own = log.where(F.col("op").isin(*mutations))
    touched = own.where(F.col(order) > since).groupBy(key).agg(F.max(order).alias("changed_at"), F.count("*").alias("n_mutations"))
    last = own.where(F.col(child).isNotNull()).groupBy(key, child).agg(F.max_by("op", order).alias("op"))
    state = last.groupBy(key).agg(F.count_if(F.col("op") != "delete").alias("n_children"))
    return touched.join(state, key, "left").select(key, "changed_at", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_mutations")
