"""Areal statistics: categories, windows, dense counts, rates, ranks, references and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import WINDOWS
from ..functions.numeric import DEFAULT_POPULATION, MEASURES, ambient_population, falsy_default, half_up, is_number, measure_values, safe_rate
from ..functions.text import compare_key


def merge_first(sources: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of sources with a `source` column; of the rows of one key the first source's, then the first by `order`, stays.

    Rows without a key (null or empty) are left out.
    """
    tagged = [df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(sources.items())]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    first = Window.partitionBy(key).orderBy("_rank", *order)
    return union.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_rank")


def categorize(incidents: DataFrame, categories: DataFrame, offence: str = "offence") -> DataFrame:
    """Adds `metric` by a case-blind look-up; of a repeated offence the last category counts; unmatched rows go.

    The dictionary is a handful of literal rows; the optimizer broadcasts it by its size.
    """
    last = Window.partitionBy("_key").orderBy(F.desc("ord"))
    dim = categories.withColumn("_key", compare_key(F.col("offence"))).withColumn("_n", F.row_number().over(last)).where("_n = 1").select("_key", "metric")
    return incidents.withColumn("_key", compare_key(F.col(offence))).join(dim, "_key").drop("_key")


def window_counts(events: DataFrame, areas: DataFrame, metrics: DataFrame, ranges: DataFrame, windows: list[str] | None = None) -> DataFrame:
    """window, area_id, metric, count for every area, metric and window (of `windows`, all known ones unless given), 0 where nothing happened.

    One pass: each event (area_id, metric, date) meets one row that holds all windows (both ends included) and is
    counted in every window it lies in, before the shuffle. The dense grid is of areas and metrics; windows
    are laid out last.
    """
    names = list(WINDOWS) if windows is None else windows
    one = ranges.groupBy().pivot("window", names).agg(F.first(F.struct("start", "end")))
    known = events.where("area_id is not null and metric is not null and date is not null").join(F.broadcast(one))
    sums = known.groupBy("area_id", "metric").agg(*[F.count_if(F.col("date").between(F.col(f"`{w}`.start"), F.col(f"`{w}`.end"))).alias(f"n_{w}") for w in names])
    grid = areas.select("area_id").join(F.broadcast(metrics.select("metric"))).join(sums, ["area_id", "metric"], "left")
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.coalesce(f"n_{w}", F.lit(0)).cast("long").alias("count")) for w in names]))
    return grid.select("area_id", "metric", rows.alias("r")).select("r.window", "area_id", "metric", "r.count")


def area_stats(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """Rate per 100,000, rank (lowest rate first, ties by the areas' order) and percentile of every count.

    `areas` has area_id, ord and population; a missing or zero population counts as the default.
    """
    pop = falsy_default(F.col("population"), DEFAULT_POPULATION)
    rated = counts.join(areas.select("area_id", "ord", pop.alias("pop")), "area_id").withColumn("raw", safe_rate(F.col("count"), F.col("pop")))
    by = Window.partitionBy("window", "metric")
    ranked = rated.withColumn("rank", F.row_number().over(by.orderBy("raw", "ord")).cast("long")).withColumn("total", F.count("*").over(by))
    percentile = (F.col("total") - F.col("rank")).cast("double") / F.col("total") * 100
    return ranked.select("window", "area_id", "metric", "count", half_up(F.col("raw"), 2).alias("rate"), "rank", "total", half_up(percentile, 1).alias("percentile"))


def comparisons(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """Rates of the whole city and of every borough: window, level, grp, metric, rate. An area's population counts once."""
    pop = falsy_default(F.col("population"), DEFAULT_POPULATION)
    rows = counts.join(areas.select("area_id", "borough", pop.alias("pop")), "area_id")
    sums = rows.groupingSets([["window", "metric"], ["window", "metric", "borough"]], "window", "metric", "borough").agg(F.sum("count").alias("n"), F.sum("pop").alias("p"), F.grouping("borough").alias("g"))
    return sums.select("window", F.when(F.col("g") == 1, "city").otherwise("borough").alias("level"), F.when(F.col("g") == 1, "ALL").otherwise(F.col("borough")).alias("grp"), "metric", half_up(safe_rate(F.col("n"), F.col("p")), 2).alias("rate"))


def area_measures(stats: DataFrame, exposure: DataFrame, land: DataFrame) -> DataFrame:
    """window, metric, measure, area_id, value: the four measures of every statistic, null where one cannot be had."""
    joined = stats.join(exposure.select("area_id", "population", "jobs"), "area_id", "left").join(land.select("area_id", "area_sq_mi"), "area_id", "left")
    values = measure_values(F.col("count"), F.col("rate"), F.col("area_sq_mi"), ambient_population(F.col("population"), F.col("jobs")))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), values[m].alias("value")) for m in MEASURES]))
    return joined.select("window", "metric", "area_id", pairs.alias("m")).select("window", "metric", "m.measure", "area_id", "m.value")


def risk_ranks(measures: DataFrame) -> DataFrame:
    """Competition rank and total among values that are numbers; others go."""
    by = Window.partitionBy("window", "metric", "measure")
    ok = measures.where(is_number(F.col("value")))
    return ok.withColumn("risk_rank", F.rank().over(by.orderBy("value")).cast("long")).withColumn("total", F.count("*").over(by))


def dot_positions(ranks: DataFrame) -> DataFrame:
    """Where a rank stands from 0 to 100; null if it is the only one."""
    return ranks.withColumn("position", F.when(F.col("total") > 1, (F.col("risk_rank") - 1).cast("double") / (F.col("total") - 1) * 100))


def city_values(stats: DataFrame, exposure: DataFrame, land: DataFrame) -> DataFrame:
    """window, metric, measure, city_value from totals; areas without exposure add counts only, and land only if above 0."""
    joined = stats.join(exposure.select("area_id", "population", "jobs"), "area_id", "left").join(land.select("area_id", "area_sq_mi"), "area_id", "left")
    jobs = F.coalesce("jobs", F.lit(0)).cast("long")
    sums = joined.groupBy("window", "metric").agg(
        F.sum("count").alias("n"),
        F.sum(F.coalesce("population", F.lit(0))).alias("p"),
        (F.sum(F.coalesce("population", F.lit(0)) * 16 + jobs * 8) / 24.0).alias("amb"),
        F.sum(F.when(F.col("area_sq_mi") > 0, F.col("area_sq_mi"))).alias("land"),
    )
    n = F.col("n").cast("double")
    values = {"per100k": F.when(F.col("p") > 0, n / F.col("p") * 100000), "ambient": F.when(F.col("amb") > 0, n / F.col("amb") * 100000), "perSqMi": F.when(F.col("land") > 0, n / F.col("land"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("city_value")) for k, v in values.items()]))
    return sums.select("window", "metric", pairs.alias("m")).select("window", "metric", "m.measure", "m.city_value")


def latest_only(rows: DataFrame, column: str) -> DataFrame:
    """Rows of the largest value of a column, by a scalar subquery's value."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.join(F.broadcast(top), F.col(column) == F.col("_top"), "left_semi")


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def incomplete(areas: DataFrame, column: str = "population") -> DataFrame:
    """The areas without a value above 0."""
    return areas.where(F.coalesce(F.col(column), F.lit(0)) <= 0)


def require_complete(areas: DataFrame, column: str = "population") -> DataFrame:
    """The areas, or an error that counts and names the first ten without a value above 0."""
    missing = incomplete(areas, column)
    n = missing.count()
    if n:
        raise ValueError(f"{n} areas without {column}: " + ", ".join(str(r[0]) for r in missing.select("area_id").orderBy("area_id").limit(10).collect()))
    return areas
