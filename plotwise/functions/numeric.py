"""Numbers: rounding, rates and measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed conversion values.
SQFT_PER_M2 = 10.763910416709722
SQ_METERS_PER_SQ_MILE = 2589988.110336
DEFAULT_POPULATION = 40000
MEASURES = ("count", "per100k", "perSqMi", "ambient")


def half_up(x: Column, decimals: int = 0) -> Column:
    """Rounds halves up on the binary product, which differs from round() on values such as 1.005."""
    factor = float(10**decimals)
    return F.floor(x * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def safe_rate(count: Column, population: Column, per: float = 100000.0) -> Column:
    """count / population * per, and 0 where there is no population."""
    return F.when(population > 0, count.cast("double") / population.cast("double") * F.lit(per)).otherwise(F.lit(0.0))


def falsy_default(x: Column, default) -> Column:
    """x, or the default where x is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("long")), F.lit(default))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ambient_population(population: Column, jobs: Column) -> Column:
    """Average people present: residents count 16 hours of the day, workers 8."""
    return (F.coalesce(population, F.lit(0)).cast("double") * 16 + F.coalesce(jobs, F.lit(0)).cast("double") * 8) / 24


def measure_values(count: Column, rate: Column, area_sq_mi: Column, ambient: Column) -> dict[str, Column]:
    """The four measures; a measure whose denominator is missing or not above 0 is null."""
    c = count.cast("double")
    return {
        "count": c,
        "per100k": rate,
        "perSqMi": F.when(area_sq_mi > 0, c / area_sq_mi),
        "ambient": F.when(ambient > 0, c / ambient * 100000),
    }


def confidence_from_interval(sqft: Column, low: Column, high: Column) -> Column:
    """1 less the interval's width as a share of the estimate, kept within 0.05 and 0.99."""
    return clamp(1.0 - (high - low) / F.greatest(sqft, F.lit(1.0)), 0.05, 0.99)


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two directions without sign, modulo pi."""
    import math

    d = F.pmod(a - b, F.lit(math.pi))
    return F.least(d, F.lit(math.pi) - d)


def is_number(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
