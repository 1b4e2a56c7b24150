"""Accuracy by segment and slopes of parcels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.plans import segments, terrain, valuation
from parcelspark.queries.places import _squares
from parcelspark.sources.bridge import PARCELS_SQL, listings, parcels

# An elevation raster over the parcels' places, from the orders: their key gives the cell, their total the height.
GRID = terrain.Grid(37.0, -81.0, 0.02)
SIDE = 50


def _raster(spark, d):
    o = F.col("o_orderkey")
    cell = spark.read.parquet(f"{d}/orders.parquet").select(F.floor(F.pmod(o, F.lit(SIDE * SIDE)) / SIDE).cast("int").alias("row"), F.pmod(o, F.lit(SIDE)).cast("int").alias("col"), F.pmod(F.floor("o_totalprice"), F.lit(300)).alias("h"))
    return cell.groupBy("row", "col").agg(F.avg("h").alias("z"))


def _slopes(spark, d):
    return terrain.slopes(_raster(spark, d), GRID)


def _scored(spark, d):
    rows = listings(spark, d)
    per = valuation.estimates(rows).drop("county")
    more = rows.select("listing_id", "class_id", "county", "acres", F.col("lat").isNotNull().alias("has_geo"))
    return segments.with_segments(per.join(more, "listing_id").withColumnRenamed("listing_id", "id"))


QUERIES = {
    "error_segments": lambda spark, d: segments.segment_metrics(_scored(spark, d)),
    "error_intervals": lambda spark, d: segments.bootstrap(_scored(spark, d), 100),
    "raster_slopes": _slopes,
    "parcel_slopes": lambda spark, d: terrain.parcel_slopes(parcels(spark, d), _slopes(spark, d), GRID),
    "polygon_slopes": lambda spark, d: terrain.polygon_slopes(_squares(spark), _slopes(spark, d), GRID),
}

_S = f"""WITH {PARCELS_SQL}, z AS (SELECT CAST((o_orderkey % {SIDE * SIDE}) // {SIDE} AS INTEGER) AS r, CAST(o_orderkey % {SIDE} AS INTEGER) AS c, avg(CAST(floor(o_totalprice) AS BIGINT) % 300) AS z FROM orders GROUP BY 1, 2),
s AS (SELECT o.r, o.c, sqrt(pow((e.z - w.z) / (2 * {GRID.step}::DOUBLE * 111320 * cos(radians(37.0::DOUBLE + (o.r + 0.5::DOUBLE) * {GRID.step}::DOUBLE))), 2) + pow((n.z - u.z) / (2 * {GRID.step}::DOUBLE * 111320), 2)) * 100 AS slope
  FROM z o JOIN z e ON e.r = o.r AND e.c = o.c + 1 JOIN z w ON w.r = o.r AND w.c = o.c - 1 JOIN z n ON n.r = o.r + 1 AND n.c = o.c JOIN z u ON u.r = o.r - 1 AND u.c = o.c)"""
_STATS = "count(*) AS slope_n_cells, sum(w * slope) / sum(w) AS slope_mean_pct, max(slope) AS slope_max_pct, " + ", ".join(f"sum(CASE WHEN slope < {p} THEN w ELSE 0 END) / sum(w) * 100 AS pct_under_{p}pct_slope" for p in terrain.UNDER)
_OVER = lambda lo, hi, start, place: f"greatest(0.0::DOUBLE, least({hi}, {start}::DOUBLE + {place} * {GRID.step}::DOUBLE + {GRID.step}::DOUBLE) - greatest({lo}, {start}::DOUBLE + {place} * {GRID.step}::DOUBLE)) / {GRID.step}::DOUBLE"
_TIER = lambda v, tiers, missing: f"CASE WHEN {v} IS NULL THEN '{missing}' " + " ".join(f"WHEN {v} < {b} THEN '{n}'" for b, n in tiers[:-1]) + f" ELSE '{tiers[-1][1]}' END"
ORACLE = {
    "raster_slopes": f'{_S} SELECT r AS "row", c AS col, slope FROM s',
    "parcel_slopes": f"""{_S}, h AS (SELECT parcel_id, lat, lng, sqrt(greatest(CASE WHEN acres > 0 THEN acres ELSE 0.5::DOUBLE END, 0.05::DOUBLE) * 4046.86::DOUBLE / pi()) / 111320 AS half FROM parcels),
q AS (SELECT parcel_id, lat - half AS south, lat + half AS north, lng - half / cos(radians(lat)) AS west, lng + half / cos(radians(lat)) AS east FROM h),
w AS (SELECT parcel_id, slope, {_OVER("south", "north", "37.0", "r")} * {_OVER("west", "east", "-81.0", "c")} AS w FROM q JOIN s ON r BETWEEN floor((south - 37) / {GRID.step}::DOUBLE) - 1 AND floor((north - 37) / {GRID.step}::DOUBLE) + 1 AND c BETWEEN floor((west + 81) / {GRID.step}::DOUBLE) - 1 AND floor((east + 81) / {GRID.step}::DOUBLE) + 1)
SELECT parcel_id, {_STATS} FROM w WHERE w > 0 GROUP BY 1""",
    "polygon_slopes": f"""{_S}, sq AS (SELECT i AS polygon_id, -81.0003::DOUBLE + i * 0.2::DOUBLE AS x, 37.0003::DOUBLE + i * 0.15::DOUBLE AS y FROM range(5) t(i)),
p AS (SELECT r, c, slope, -81.0::DOUBLE + (c + (a + 0.5::DOUBLE) / 4) * {GRID.step}::DOUBLE AS px, 37.0::DOUBLE + (r + (b + 0.5::DOUBLE) / 4) * {GRID.step}::DOUBLE AS py FROM s, range(4) t(a), range(4) u(b)),
w AS (SELECT polygon_id, r, c, slope, count(*) / 16.0::DOUBLE AS w FROM sq, p WHERE px BETWEEN x AND x + 0.25::DOUBLE AND py BETWEEN y AND y + 0.25::DOUBLE AND NOT (px BETWEEN x + 0.075::DOUBLE AND x + 0.175::DOUBLE AND py BETWEEN y + 0.075::DOUBLE AND y + 0.175::DOUBLE) GROUP BY ALL)
SELECT polygon_id, {_STATS} FROM w GROUP BY 1""",
}


def with_comps(pit: str) -> dict[str, str]:
    """SQL of the segments after ``pit``, which defines the comps known at the time of each sale."""
    cuts = {"class": "class_id", "price_band": _TIER("sold_price", segments.PRICE_BANDS, ""), "acre_tier": _TIER("acres", segments.ACRE_TIERS, "(no acres)"), "sqft_tier": _TIER("sqft", segments.SQFT_TIERS, "(no sqft)"), "county": "county", "join_success": "CASE WHEN lat IS NOT NULL THEN 'has_geo' ELSE 'no_geo' END", "overall": "'all'"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS cut, {v} AS segment, * FROM x" for k, v in cuts.items())
    return {"error_segments": f"""{pit}, per AS (SELECT listing_id, median(c_price / c_sqft) * sqft AS e, min(c_price / c_sqft) * sqft AS lo, max(c_price / c_sqft) * sqft AS hi FROM pit GROUP BY listing_id, sqft),
x AS (SELECT l.*, e - sold_price AS gap, sold_price BETWEEN lo AND hi AS covered FROM per JOIN listings l USING (listing_id)), every AS ({each})
SELECT cut, segment, count(*) AS n, median(abs(gap / sold_price)) AS median_ape, avg(abs(gap / sold_price)) AS mape, avg(abs(gap)) AS mae, median(abs(gap)) AS median_abs_error, avg(CASE WHEN abs(gap / sold_price) <= 0.10::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS ppe10, avg(CASE WHEN abs(gap / sold_price) <= 0.20::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS ppe20,
avg(CASE WHEN covered THEN 1.0::DOUBLE ELSE 0 END) AS coverage, median(gap / sold_price) AS median_signed, avg(gap / sold_price) AS mean_signed FROM every GROUP BY 1, 2"""}
