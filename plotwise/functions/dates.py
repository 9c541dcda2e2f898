"""Dates: parsing and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months of each trailing window; ytd starts with the year.
WINDOWS = {"3m": 3, "6m": 6, "12m": 12, "24m": 24, "ytd": None}


def to_iso_date(x: Column) -> Column:
    """The first ten characters as a date, else the whole as a timestamp, else null."""
    text = x.cast("string")
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_timestamp(text).cast("date"))


def months_back(day: Column, months: int, overflow: bool = True) -> Column:
    """The day so many months before. With overflow a day beyond the month's end rolls into the next month; without, it is the last."""
    if not overflow:
        return F.add_months(day, -months)
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def window_start(window: str, end: Column, overflow: bool = True) -> Column:
    """Start of a trailing window that ends on a day; a name that is not known counts as 12 months."""
    months = WINDOWS.get(window, 12)
    return F.trunc(end, "YEAR") if months is None else months_back(end, months, overflow)


def window_ranges(anchor: DataFrame, overflow: bool = True, windows=tuple(WINDOWS)) -> DataFrame:
    """One row a window for each row of a table with a date `end`: window, start, end."""
    made = F.array(*[F.struct(F.lit(w).alias("window"), window_start(w, F.col("end"), overflow).alias("start"), F.col("end").alias("end")) for w in windows])
    return anchor.select(F.explode(made).alias("r")).select("r.*")


def display_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("unknown"))
