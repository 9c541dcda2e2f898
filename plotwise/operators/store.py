"""A keyed store of listings and photos as a fold of a mutation log.

A log row is (seq, op, listing_id, url, photo_url, label, sqft, pipeline, position). The state after any
prefix of the log is a plain aggregation by key, so batches and streams share these functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import photo_base_hash


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _one_change(changes: DataFrame, keys: list[str], columns: list[str], order: str | None) -> DataFrame:
    """One row a key: of each column the last value by `order` that is not null, or the greatest without an order."""
    value = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))) if order else F.max
    return changes.groupBy(*keys).agg(*[value(c).alias(f"_{c}") for c in columns])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """Base rows with the newer non-null values of changes, and rows for keys that base lacks. Several changes of a key are folded first."""
    new = _one_change(changes, keys, columns, order)
    return base.join(new, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def partial_update(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """Only keys in base; null values of a change leave a column alone. Several changes of a key are folded first."""
    new = _one_change(changes, keys, columns, order)
    rest = [c for c in base.columns if c not in keys and c not in columns]
    return base.join(new, keys, "left").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], *rest)


def cascade_delete(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of deleted keys."""
    return parents.join(deleted, key, "left_anti"), children.join(deleted, key, "left_anti")


def fold_log(log: DataFrame, key: str, order: str) -> DataFrame:
    """Per key: created and touched, the number of writes, and whether it is there after the last row. Deletes reset what came before."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = F.max(F.when(F.col("op") == "delete", F.col(order))).over(by)
    alive = log.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(order) > F.col("_cut")))
    return alive.groupBy(key).agg(F.min(order).alias("created"), F.max(order).alias("touched"), F.count("*").alias("writes"), F.max_by("label", F.when(F.col("label").isNotNull(), F.col(order))).alias("label"))


def map_merge(rows: DataFrame, key: str, order: str, name: str, value: str) -> DataFrame:
    """A map per key in which the newest value of a name wins."""
    last = latest(rows.where(F.col(name).isNotNull()), [key, name], [order])
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("merged"))


def newest_run(rows: DataFrame, key: str, token: str, value: str) -> DataFrame:
    """Of several runs of one key the newest one's result survives."""
    return rows.groupBy(key).agg(F.max(token).alias("token"), F.max_by(value, token).alias("result"))


def changes_of(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows at which a value differs from the one before, the first of a key left out."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def debounce(rows: DataFrame, key: str, time: str, gap: str = "350 milliseconds") -> DataFrame:
    """Bursts of rows at most `gap` apart: key, start, end, n."""
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def history(listings: DataFrame, photos: DataFrame, key: str) -> DataFrame:
    """Photos and analysed photos of every listing, newest first."""
    sums = photos.groupBy(key).agg(F.count("*").alias("n_photos"), F.count("estimated_sqft").alias("n_analyzed"))
    return listings.join(sums, key, "left").fillna(0, ["n_photos", "n_analyzed"]).orderBy(F.desc("updated_at"), key)


def placed_first(position: str = "position") -> Column:
    """Order of photos: by position, unplaced ones (0 among them) last."""
    return F.when(F.coalesce(F.col(position), F.lit(0)) != 0, F.col(position)).asc_nulls_last()


def annotate(photos: DataFrame, positions: DataFrame, key: str = "photo_url") -> DataFrame:
    """Photos with their positions, unplaced ones (0 among them) last."""
    return photos.join(positions, key, "left").orderBy(placed_first(), key)


def carousel_places(photos: DataFrame, positions: DataFrame, listing: str, key: str) -> DataFrame:
    """Photos with `place`, from 1 within their listing, in the order of annotate(); a window holds one listing's photos."""
    by = Window.partitionBy(listing).orderBy(placed_first(), key)
    return photos.join(positions, key, "left").withColumn("place", F.row_number().over(by).cast("long"))


def positions_by_hash(photos: DataFrame, thumbnails: DataFrame, photo_url: str, thumb_url: str) -> DataFrame:
    """Photos with the position of the thumbnail whose link has the same base: the smallest of several, null where none has it."""
    base = thumbnails.select(photo_base_hash(F.col(thumb_url)).alias("_base"), "position").where("_base is not null").groupBy("_base").agg(F.min("position").alias("position"))
    return photos.withColumn("_base", photo_base_hash(F.col(photo_url))).join(base, "_base", "left").drop("_base")


def save_photos(base: DataFrame, saved: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Photos after saves: one that is there gets the new label alone, an empty one too; others are added without an estimate.

    Of several saves of one photo the last by `order` counts.
    """
    last = saved.groupBy(*keys).agg(F.max_by(F.trim(F.coalesce("label", F.lit(""))), order).alias("_label"))
    rest = [c for c in base.columns if c not in (*keys, "label")]
    return base.join(last, keys, "full").select(*keys, F.coalesce("_label", "label").alias("label"), *rest)
