"""Points and areas: first-match point-in-polygon joins without a shuffle of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import GEOMETRY, bbox, geometry_area_m2, in_geometry
from ..functions.numeric import SQ_METERS_PER_SQ_MILE

#: Areas whose geometry is at most so many points together travel as one broadcast row; others go by grid cells.
MAX_POINTS = 500_000


def prepare_areas(areas: DataFrame) -> DataFrame:
    """area_id, ord, geometry with its box and land area, worked out once."""
    return areas.withColumn("geometry", F.col("geometry").cast(GEOMETRY)).withColumn("box", bbox(F.col("geometry"))).withColumn("area_sq_mi", geometry_area_m2(F.col("geometry")) / SQ_METERS_PER_SQ_MILE)


def residential(areas: DataFrame, kind: str = "ntatype") -> DataFrame:
    """Areas without a type, or of type 0; only other types go."""
    return areas.where(F.col(kind).isNull() | F.col(kind).isin("", "0"))


def _holds(area: Column, x: Column, y: Column) -> Column:
    box = area["box"]
    return x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"]) & in_geometry(x, y, area["geometry"])


def assign_areas(points: DataFrame, areas: DataFrame, x: str = "lon", y: str = "lat", max_points: int = MAX_POINTS, cell: float = 0.02) -> DataFrame:
    """Adds `area_id`: the first area by `ord` that holds the point, null if none does or a coordinate is missing.

    Up to `max_points` polygon points in all, the areas travel as one array in a broadcast row, and the first
    match is an array filter: points are not shuffled. Beyond that size areas and points meet by grid cells
    of `cell` degrees in an equi-join, and the least `ord` per point is kept.
    """
    ready = prepare_areas(areas).select("area_id", "ord", "geometry", "box").where("box is not null")
    size = ready.agg(F.coalesce(F.sum(F.size(F.flatten(F.flatten("geometry")))), F.lit(0))).first()[0]
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    if size <= max_points:
        held = ready.agg(F.array_sort(F.collect_list(F.struct("ord", "area_id", "geometry", "box")), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("_areas"))
        first = F.get(F.filter("_areas", lambda a: _holds(a, px, py)), F.lit(0))
        return points.join(F.broadcast(held)).withColumn("area_id", first["area_id"]).drop("_areas")
    rows = points.withColumn("_row", F.monotonically_increasing_id())
    span = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    cells = ready.withColumn("_cx", F.explode(span(F.col("box.min_x"), F.col("box.max_x")))).withColumn("_cy", F.explode(span(F.col("box.min_y"), F.col("box.max_y"))))
    keyed = rows.select("_row", px.alias("_x"), py.alias("_y"), F.floor(px / cell).alias("_cx"), F.floor(py / cell).alias("_cy"))
    found = keyed.join(cells.withColumn("_a", F.struct("ord", "area_id", "geometry", "box")), ["_cx", "_cy"]).where(_holds(F.col("_a"), F.col("_x"), F.col("_y")))
    best = found.groupBy("_row").agg(F.min_by("area_id", "ord").alias("area_id"))
    return rows.join(best, "_row", "left").drop("_row")
