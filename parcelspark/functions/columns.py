"""Column expressions that several products share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def recency(days: Column, fold: float) -> Column:
    return F.exp(-days / fold)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))
