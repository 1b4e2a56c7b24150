"""Slope of land: an elevation raster, its slope cell by cell, and the slope inside parcels weighted by area.

A raster is a table (row, col, z) over a grid of ``step`` degrees from (lat0, lng0); cells without a row have no elevation. Zones meet cells by square tiles, so a zone is compared with the cells of the
tiles it touches and with no others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.relational import point_in_polygon

METRES_PER_DEGREE = 111_320.0
ACRE_M2 = 4046.86
LEAST_ACRES, USUAL_ACRES = 0.05, 0.5
UNDER = (5, 10, 15)
TILE = 8


@dataclass(frozen=True)
class Grid:
    lat0: float
    lng0: float
    step: float

    def middle(self, row: Column) -> Column:
        return F.lit(self.lat0) + (row + 0.5) * self.step


def slopes(raster: DataFrame, grid: Grid) -> DataFrame:
    """row, col, slope in per cent of grade from the four neighbours, where all four are known. Each cell sends its elevation to its neighbours: one shuffle, no join."""
    to = lambda side, dr, dc: F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(side).alias("side"))
    sent = raster.filter("z IS NOT NULL").select("z", F.explode(F.array(to("w", 0, 1), to("e", 0, -1), to("s", 1, 0), to("n", -1, 0), to("own", 0, 0))).alias("t")).select("t.*", "z")
    z = {s: F.max(F.when(F.col("side") == s, F.col("z"))).alias(s) for s in ("w", "e", "s", "n", "own")}
    cells = sent.groupBy("row", "col").agg(*z.values()).filter("w IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND n IS NOT NULL AND own IS NOT NULL")
    up = 2 * grid.step * METRES_PER_DEGREE
    across = up * F.cos(F.radians(grid.middle(F.col("row"))))
    return cells.select("row", "col", (F.sqrt(F.pow((F.col("e") - F.col("w")) / across, 2) + F.pow((F.col("n") - F.col("s")) / up, 2)) * 100).alias("slope"))


def squares(parcels: DataFrame, key: str) -> DataFrame:
    """key, south, north, west, east: the square as wide as the circle of the parcel's acres (half an acre where unknown, 0.05 at least) around its point."""
    acres = F.greatest(F.when(F.col("acres") > 0, F.col("acres")).otherwise(USUAL_ACRES), F.lit(LEAST_ACRES))
    half = F.sqrt(acres * ACRE_M2 / math.pi) / METRES_PER_DEGREE
    wide = half / F.cos(F.radians("lat"))
    rows = parcels.filter("lat IS NOT NULL AND lng IS NOT NULL AND abs(lat) < 90")
    return rows.select(key, (F.col("lat") - half).alias("south"), (F.col("lat") + half).alias("north"), (F.col("lng") - wide).alias("west"), (F.col("lng") + wide).alias("east"))


def _cells_of(zones: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Zones (south, north, west, east) with every cell that they overlap, and ``share``, the overlap in cells."""
    at = lambda c, start: F.floor((F.col(c) - start) / grid.step).cast("int")
    ranged = zones.withColumns({"_r0": at("south", grid.lat0), "_r1": at("north", grid.lat0), "_c0": at("west", grid.lng0), "_c1": at("east", grid.lng0)})
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    tiled = ranged.withColumn("_tr", F.explode(F.sequence(tile("_r0"), tile("_r1")))).withColumn("_tc", F.explode(F.sequence(tile("_c0"), tile("_c1"))))
    joined = tiled.join(cells.withColumns({"_tr": tile("row"), "_tc": tile("col")}), ["_tr", "_tc"]).filter("row BETWEEN _r0 AND _r1 AND col BETWEEN _c0 AND _c1")

    def overlap(low: str, high: str, place: str, start: float) -> Column:
        edge = F.lit(start) + F.col(place) * grid.step
        return F.greatest(F.lit(0.0), F.least(F.col(high), edge + grid.step) - F.greatest(F.col(low), edge)) / grid.step

    return joined.withColumn("share", overlap("south", "north", "row", grid.lat0) * overlap("west", "east", "col", grid.lng0)).drop("_tr", "_tc", "_r0", "_r1", "_c0", "_c1")


def _statistics(rows: DataFrame, key: str) -> DataFrame:
    under = [(F.sum(F.when(F.col("slope") < p, F.col("share")).otherwise(0.0)) / F.sum("share") * 100).alias(f"pct_under_{p}pct_slope") for p in UNDER]
    return rows.filter("share > 0").groupBy(key).agg(F.count("*").alias("slope_n_cells"), (F.sum(F.col("share") * F.col("slope")) / F.sum("share")).alias("slope_mean_pct"), F.max("slope").alias("slope_max_pct"), *under)


def parcel_slopes(parcels: DataFrame, slope_cells: DataFrame, grid: Grid, key: str = "parcel_id") -> DataFrame:
    """Slope statistics of each parcel's square, cells weighted by the area of theirs that lies inside. Parcels without a place or over cells without slope have no row."""
    return _statistics(_cells_of(squares(parcels, key), slope_cells, grid), key)


def polygon_slopes(polygons: DataFrame, slope_cells: DataFrame, grid: Grid, key: str = "polygon_id", per_side: int = 4) -> DataFrame:
    """The same inside real outlines (``rings`` of structs x, y; holes left out): a cell's share is that of ``per_side`` x ``per_side`` points spread over it that lie inside."""
    corner = lambda f, axis: f(F.transform(F.flatten("rings"), lambda p: p[axis]))
    zones = polygons.select(key, "rings", corner(F.array_min, "y").alias("south"), corner(F.array_max, "y").alias("north"), corner(F.array_min, "x").alias("west"), corner(F.array_max, "x").alias("east")).filter("south IS NOT NULL")
    rows = _cells_of(zones, slope_cells, grid).drop("share")
    at = [(i + 0.5) / per_side for i in range(per_side)]
    spread = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in at for b in at))
    x, y = (F.lit(start) + (F.col(place) + F.col(f"p.{f}")) * grid.step for start, place, f in ((grid.lng0, "col", "a"), (grid.lat0, "row", "b")))
    points = rows.withColumn("p", F.explode(spread)).filter(point_in_polygon(x, y, F.col("rings")))
    return _statistics(points.groupBy(key, "row", "col", "slope").agg((F.count("*") / len(at) ** 2).alias("share")), key)
