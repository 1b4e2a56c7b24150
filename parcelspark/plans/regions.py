"""Valuation knobs by region: the most specific region that has entries, over the global ones, over the built-in defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The defaults.
DEFAULTS = {"sqft_factor": 0.76, "land_rate_lo": 5000.0, "land_rate_hi": 6500.0, "dist_scale": 5.0}
GLOBAL = "global"
LEVELS = ("fips", "county", "cbsa", "state")


def county_name(c: Column) -> Column:
    """'Montgomery County', 'MONTGOMERY CO.' and 'City of Montgomery' alike."""
    letters = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(letters, r"\b(county|city|co|of)\b", ""), r"\s+", " "))


def region_keys(subjects: DataFrame) -> Column:
    """An array of (level, key) from the most specific on: five digits of fips5, county within the state (VA where unknown), cbsa, state."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    given = F.substring(F.upper(F.trim(F.coalesce(F.nullif(F.col("state").cast("string"), F.lit("")), F.lit("VA")))), 1, 2)
    county = county_name(F.col("county"))
    candidates = {
        "fips": F.when(text("fips5").rlike(r"^\d{5}$"), text("fips5")),
        "county": F.when(county != "", F.concat(F.lit("county:"), F.lower(given), F.lit(":"), county)),
        "cbsa": F.when(text("cbsa") != "", F.concat(F.lit("cbsa:"), text("cbsa"))),
        "state": F.when(given != "", F.concat(F.lit("state:"), given)),
    }
    return F.array_compact(F.array(*(F.when(candidates[name].isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(name).alias("level"), candidates[name].alias("key"))) for i, name in enumerate(LEVELS))))


def over(base: Column, more: Column) -> Column:
    """Two maps in one: entries of ``more`` win."""
    return F.map_zip_with(base, more, lambda _, a, b: F.coalesce(b, a))


def knobs(subjects: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """key, level (what decided: fips, county, cbsa, state or global) and a map of knobs for each of ``subjects`` (fips5, county, cbsa, state).

    ``entries`` (region, name, value): one row a knob, region ``global`` for all; names that begin with an underscore are notes and null values are none. Of a repeated entry the larger value counts. The
    most specific region with an entry, a note alone included, wins as a whole: siblings and parents are not mixed in, only global entries and defaults.
    """
    text = entries.groupBy("region", "name").agg(F.max("value").alias("value"))
    real = ~F.col("name").startswith("_") & F.col("value").isNotNull()
    maps = text.groupBy("region").agg(F.map_from_entries(F.collect_list(F.when(real, F.struct("name", "value")))).alias("own"))
    defaults = F.create_map(*(F.lit(x) for pair in DEFAULTS.items() for x in pair))
    empty = F.create_map().cast("map<string,double>")
    asked = subjects.select(key, F.explode_outer(region_keys(subjects)).alias("k")).select(key, "k.*")
    found = asked.join(maps.withColumnRenamed("region", "key"), "key", "left")
    best = found.groupBy(key).agg(F.min_by(F.struct("level", "own"), F.when(F.col("own").isNotNull(), F.col("place"))).alias("best"))
    everywhere = maps.filter(F.col("region") == GLOBAL).agg(F.first("own").alias("everywhere"))  # one row, also of none
    rows = best.join(F.broadcast(everywhere))
    merged = over(over(defaults, F.coalesce("everywhere", empty)), F.coalesce(F.col("best.own"), empty))
    return rows.select(key, F.coalesce(F.col("best.level"), F.lit(GLOBAL)).alias("level"), merged.alias("knobs"))
