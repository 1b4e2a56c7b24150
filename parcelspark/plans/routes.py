"""Walking order of stops: clusters along a space-filling curve, a greedy tour inside each.

A route's stops are put into squares of a quadtree: the largest squares that hold at most ``most`` stops. Squares follow one another along the Z-order curve, and within a square the tour starts at the
stop of the highest score and goes on to the nearest one left. A route of at most ``most`` stops is one square, so its order is the plain greedy tour. No task holds more than ``most`` stops of a square.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.operators.stages import settled

BITS = 16
EARTH_MILES = 3958.7613


def curve(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2^BITS in turn: the place on the Z-order curve."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i + 1))
    return out


def squares_of(cells: DataFrame, most: int) -> DataFrame:
    """(route, x, y, n) of filled finest cells -> (route, x, y, level, square): the coarsest level whose square holds at most ``most`` stops, the finest where none does."""
    every = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(BITS))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), BITS - F.col("level"))).cast("long")
    every = every.withColumn("sx", up("x")).withColumn("sy", up("y"))
    small = every.groupBy("route", "level", "sx", "sy").agg(F.sum("n").alias("held")).filter((F.col("held") <= most) | (F.col("level") == BITS)).drop("held")
    # Joined from the finest level up, a square of many cells is not looked up: only those that are small enough are there.
    level = every.join(small, ["route", "level", "sx", "sy"]).groupBy("route", "x", "y").agg(F.min("level").alias("level"))
    side = F.pow(F.lit(2), BITS - F.col("level"))
    corner = lambda c: (F.floor(F.col(c) / side) * side).cast("long")
    return level.withColumn("square", curve(corner("x"), corner("y")))


def _tour(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One square's stops in greedy order: first the highest score (nulls as 0, ties to the smaller stop), then always the nearest left (ties likewise)."""
    t = table.sort_by("stop")
    lat, lng = (np.radians(t.column(c).to_numpy()) for c in ("lat", "lng"))
    score = np.nan_to_num(t.column("score").cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    left, order, gaps = np.ones(len(t), bool), [int(score.argmax())], [None]
    left[order[0]] = False
    while left.any():
        at = order[-1]
        h = np.sin((lat - lat[at]) / 2) ** 2 + np.cos(lat) * np.cos(lat[at]) * np.sin((lng - lng[at]) / 2) ** 2
        miles = np.where(left, 2 * EARTH_MILES * np.arcsin(np.sqrt(np.minimum(1, h))), np.inf)
        order.append(int(miles.argmin()))
        gaps.append(float(miles[order[-1]]))
        left[order[-1]] = False
    t = t.take(order)
    return pa.table({"route": t.column("route"), "square": t.column("square"), "part": t.column("part"), "stop": t.column("stop"), "place": pa.array(range(1, len(t) + 1), pa.int64()), "miles": pa.array(gaps, pa.float64())})


def walking_order(stops: DataFrame, route: str, stop: str, most: int = 500) -> DataFrame:
    """``stops`` (lat, lng, score) with route_order from 1 in each route and miles from the stop before (null at the start of a square). Stops without a place come last, by their number.

    Where more than ``most`` stops share the finest cell they are dealt into parts by their hash. ``stop`` is unique within a route.
    """
    rows = stops.select(F.col(route).alias("route"), F.col(stop).alias("stop"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("score").cast("double").alias("score"))
    placed = (F.abs("lat") <= 90) & (F.abs("lng") <= 180) & ~F.isnan("lat") & ~F.isnan("lng")
    cell = lambda c, half: F.least(F.floor((F.col(c) + half) / (2 * half) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    there = rows.filter(placed).withColumn("x", cell("lng", 180)).withColumn("y", cell("lat", 90))
    cells = settled(there.groupBy("route", "x", "y").agg(F.count("*").alias("n")))
    squares = squares_of(cells, most).join(cells, ["route", "x", "y"])
    parts = F.when(F.col("level") == BITS, F.ceil(F.col("n") / most)).otherwise(1).cast("long")
    dealt = there.join(squares.select("route", "x", "y", "square", parts.alias("parts")), ["route", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("stop"), F.col("parts")))
    kind = lambda c: dealt.schema[c].dataType.simpleString()
    toured = settled(dealt.select("route", "square", "part", "stop", "lat", "lng", "score").groupBy("route", "square", "part").applyInArrow(_tour, f"route {kind('route')}, square long, part long, stop {kind('stop')}, place long, miles double"))
    sizes = toured.groupBy("route", "square", "part").agg(F.count("*").alias("n"))
    line = Window.partitionBy("route").orderBy("square", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).drop("n")
    first = toured.join(before, ["route", "square", "part"]).select("route", "stop", (F.col("before") + F.col("place")).alias("route_order"), "miles")
    totals = sizes.groupBy("route").agg(F.sum("n").alias("n"))
    last = rows.filter(~F.coalesce(placed, F.lit(False))).join(totals, "route", "left")
    last = last.select("route", "stop", (F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("route").orderBy("stop"))).alias("route_order"), F.lit(None).cast("double").alias("miles"))
    return first.unionByName(last).withColumnsRenamed({"route": route, "stop": stop})

