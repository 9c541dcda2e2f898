"""Readers and writers: typed CSV keys, pruned Parquet, boundary JSON, image folders; documents and point clouds out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import GEOMETRY
from ..functions.text import compare_key

#: Image files by extension (fixed list).
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp", "bmp")
INCIDENT = "id string, date string, offence string, latitude string, longitude string"


def read_keyed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema, so that keys with leading zeros stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_incidents(spark: SparkSession, path: str, offences: list[str], start: str, end: str) -> DataFrame:
    """Incidents of some offences between two days, both included, with a key and coordinates; filters go to the scan where the format lets them."""
    rows = spark.read.schema(INCIDENT).json(path)
    return rows.where(F.col("id").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.substring("date", 1, 10).between(start, end) & compare_key(F.col("offence")).isin(*[o.upper() for o in offences]))


def geojson_geometry(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon coordinates (JSON text) as arrays of points."""
    many = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).otherwise(coordinates)
    parsed = F.from_json(many, "array<array<array<array<double>>>>")
    return F.transform(parsed, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))))).cast(GEOMETRY)


def read_boundaries(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    """Areas of a boundary file: the newer code or else the older, name, borough, geometry; typed areas other than 0 go.

    `limit` is part of the feature: a file of more areas is an error, for which would stay is nobody's choice.
    """
    raw = spark.read.schema("nta2020 string, ntacode string, ntaname string, boroname string, ntatype string, the_geom struct<type:string,coordinates:string>").json(path)
    if raw.limit(limit + 1).count() > limit:
        raise ValueError(f"{path} holds more than {limit} areas")
    kept = raw.where(F.col("ntatype").isNull() | F.col("ntatype").isin("", "0"))
    code = F.coalesce(F.nullif("nta2020", F.lit("")), F.nullif("ntacode", F.lit("")))
    return kept.select(code.alias("area_id"), F.col("ntaname").alias("name"), F.coalesce("boroname", F.lit("")).alias("borough"), geojson_geometry(F.col("the_geom.type"), F.col("the_geom.coordinates")).alias("geometry")).where("area_id is not null")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder, hidden ones left out, in name order: path, name, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(~F.col("name").startswith(".") & F.lower(F.substring_index("name", ".", -1)).isin(*IMAGE_TYPES)).orderBy("name")


def stats_document(stats: DataFrame) -> DataFrame:
    """One JSON text a window: areas to metrics to their numbers, keys in order."""
    entry = F.struct("count", "rate", "rank", "total", "percentile")
    metrics = stats.groupBy("window", "area_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), entry.alias("value"))))).alias("metrics"))
    areas = metrics.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.col("area_id").cast("string").alias("area_id"), F.to_json("metrics").alias("body")))).alias("areas"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("areas", lambda a: F.concat(F.to_json(F.array(a["area_id"])).substr(F.lit(2), F.length(F.to_json(F.array(a["area_id"]))) - 2), F.lit(":"), a["body"])), ","), F.lit("}"))
    return areas.select("window", body.alias("document"))


def write_pretty_json(rows: DataFrame, key: str, path: str, meta: dict) -> None:
    """A small report (one row an area, 10,000 at most) as one key-sorted JSON text file."""
    some = rows.limit(10_001).collect()
    if len(some) > 10_000:
        raise ValueError("a report holds at most 10,000 rows")
    body = {str(r[key]): {k: v for k, v in r.asDict().items() if k != key} for r in some}
    text = json.dumps({**meta, "areas": body}, indent=2, sort_keys=True)
    rows.sparkSession.createDataFrame([(text,)], T.StructType([T.StructField("value", T.StringType())])).coalesce(1).write.mode("overwrite").text(path)


def write_point_cloud(points: DataFrame, path: str) -> None:
    """An ASCII PLY as a folder of text parts: header first, then finite points in view order; colour grey unless given."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in ("x", "y", "z")]
    kept = points.where(finite[0] & finite[1] & finite[2])
    n = kept.count()
    header = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    colour = [F.coalesce(F.col(c), F.lit(180)) if c in points.columns else F.lit(180) for c in ("red", "green", "blue")]
    line = F.concat_ws(" ", *[F.format_string("%.5f", F.col(c).cast("double")) for c in ("x", "y", "z")], *[c.cast("string") for c in colour])
    spark = points.sparkSession
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    kept.select(line.alias("value")).write.mode("overwrite").text(f"{path}/1-points")
