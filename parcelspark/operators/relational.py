"""Relational helpers: range join, latest per key, top rows per group, grid joins, set differences, gap filling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.functions.columns import haversine_miles
from parcelspark.operators.stages import settled


CROWD = 16  # right places in an occupied cell, about, at the first radius of a search for the nearest


def range_join(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Left join to half-open bands of the row's class. ``bands`` is a dimension of some dozens of rows, hence broadcast."""
    b = F.broadcast(bands.withColumnRenamed("class_id", "_class"))
    return rows.join(b, (F.col("class_id") == F.col("_class")) & (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left").drop("_class", "lo", "hi")


def first_per(rows: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must end in a unique key."""
    out = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)
    return out.drop(rank) if rank == "_rank" else out


def mode_per(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller value."""
    return first_per(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, [F.desc("n"), F.asc(value)])


def quantiles(rows: DataFrame, by: list[str], value: str, probs: dict[str, float], count: str | None = None, low_rank: bool = False, pieces: int = 1024) -> DataFrame:
    """Exact quantiles, linearly interpolated, of groups that may each hold much of the table; nulls don't count.

    Values are counted in ``pieces`` ranges of equal width between the least and the largest; the ranges that hold a wanted rank are
    picked by running counts, and only their rows are ranked. So no task sorts or holds a group. ``low_rank`` gives the value at rank int(n p) instead.
    """
    x = rows.select(F.struct(*by).alias("_key"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    ends = x.agg(F.min("_v").alias("a"), F.max("_v").alias("b")).first()
    low, width = (ends["a"], (ends["b"] - ends["a"]) / pieces or 1.0) if ends["a"] is not None else (0.0, 1.0)
    x = x.withColumn("_piece", F.least(F.lit(pieces - 1), F.floor((F.col("_v") - low) / width).cast("int")))
    w = Window.partitionBy("_key").orderBy("_piece")
    held = x.groupBy("_key", "_piece").count().withColumn("_upto", F.sum("count").over(w)).withColumn("_n", F.sum("count").over(Window.partitionBy("_key")))
    wanted = []
    for name, p in probs.items():
        at = F.floor(F.col("_n") * p).cast("double") if low_rank else (F.col("_n") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(name).alias("name"), F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(at).alias("rank"), (at - F.floor(at)).alias("share"))]
    asked = held.withColumn("_w", F.explode(F.array(*wanted))).select("_key", "_piece", "_n", "_w.*", (F.col("_upto") - F.col("count")).alias("_before"), "_upto").filter("rank >= _before AND rank < _upto")
    ranked = x.join(asked.select("_key", "_piece").distinct(), ["_key", "_piece"]).withColumn("_i", F.row_number().over(Window.partitionBy("_key", "_piece").orderBy("_v")) - 1)
    found = asked.withColumn("_i", F.col("rank") - F.col("_before")).join(ranked, ["_key", "_piece", "_i"])
    weighted = F.when(F.col("share") > 0, F.col("_v") * F.col("share")).otherwise(0.0)
    out = found.groupBy("_key").agg(*(F.sum(F.when(F.col("name") == name, weighted)).alias(name) for name in probs), *([F.max("_n").alias(count)] if count else []))
    return out.select("_key.*", *probs, *([count] if count else []))


def match_all(rows: DataFrame, predicates: list[Column | None]) -> DataFrame:
    """Rows that meet every predicate that is given."""
    return rows.filter(reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True)))


def _cell_row(lat: Column, step: float) -> Column:
    return F.floor(lat / step).cast("long")


def _cell_column(lng: Column, row: Column, step: float) -> Column:
    """Cells widen towards the poles: as wide as ``step`` degrees of latitude at the far edge of the rows beside this one."""
    edge = F.least(F.lit(89.5), (F.abs(row) + 2) * step)
    return F.floor(lng / (step / F.cos(F.radians(edge)))).cast("long")


def radius_join(left: DataFrame, right: DataFrame, miles: float) -> DataFrame:
    """Pairs within ``miles``: columns of left, columns of right (named apart by the caller: lat2, lng2), miles.

    Right rows are copied to the nine cells around them, joined by cell, then held to the exact distance; no cross join. Cells are as wide as
    their latitude needs, up to 89.5 degrees; pairs across the date line are not found.
    """
    step = miles / 69.0
    near = right.withColumn("_cy", F.explode(F.array(*(_cell_row(F.col("lat2"), step) + i for i in (-1, 0, 1)))))
    near = near.withColumn("_cx", F.explode(F.array(*(_cell_column(F.col("lng2"), F.col("_cy"), step) + i for i in (-1, 0, 1)))))
    home = left.withColumn("_cy", _cell_row(F.col("lat"), step)).withColumn("_cx", _cell_column(F.col("lng"), F.col("_cy"), step))
    return home.join(near, ["_cy", "_cx"]).withColumn("miles", haversine_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))).filter(F.col("miles") <= miles).drop("_cy", "_cx")


def dealt_join(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, left_rows: int, right_rows: int) -> DataFrame:
    """Inner join by keys that may each hold much of both sides: a key's left rows are dealt to parts of some ``left_rows``, its right rows to parts of some ``right_rows``, and each part meets each.

    The ids spread the rows. A left row of a key with one right part stays in one place, its pairs together.
    """
    share = lambda rows, n, c: rows.groupBy(*by).agg(F.count("*").alias(f"{c}_n")).withColumn(c, F.ceil(F.col(f"{c}_n") / n).cast("int"))
    parts = settled(share(left, left_rows, "_lefts").join(share(right, right_rows, "_rights"), by))
    met = parts.agg(F.sum(F.col("_lefts_n") * F.col("_rights"))).first()[0] or 0
    n = min(4096, max(4 * math.ceil(met / left_rows), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda row_id, c: F.pmod(F.xxhash64(row_id), F.col(c)).cast("int")
    parts, types = parts.drop("_lefts_n", "_rights_n"), dict(left.dtypes)
    one = left.join(parts, by).withColumn("_left", dealt(left_id, "_lefts")).withColumn("_right", every("_rights")).drop("_lefts", "_rights")
    two = right.join(parts, by).withColumn("_right", dealt(right_id, "_rights")).withColumn("_left", every("_lefts")).drop("_lefts", "_rights")
    key = [f"_{c}" if types[c] == "double" else c for c in by]  # as text: Spark would deal rows again by a number it normalises
    for c, k in zip(by, key, strict=True):
        one, two = (one, two) if c == k else (one.withColumn(k, F.col(c).cast("string")), two.withColumn(k, F.col(c).cast("string")).drop(c))
    met_rows = one.repartition(n, *key, "_left", "_right").hint("merge").join(two, [*key, "_left", "_right"])  # a side sent to all would leave the other's few tasks
    return met_rows.drop("_left", "_right", *(k for c, k in zip(by, key, strict=True) if c != k))


def nearest(left: DataFrame, right: DataFrame, by: str, order: str, start: float, most: float, growth: float = 4.0) -> DataFrame:
    """Each left row (key ``by``) with its nearest right row (ties to the smaller ``order``), or nulls beyond ``most`` miles.

    Places are searched, not rows: of right rows at one place only the first by ``order`` can be nearest, and left rows at one place share their answer.
    Radii grow: only places without a neighbour so far are joined again by larger cells. The first is ``start``, or less where right places stand close:
    so many that an occupied cell holds some CROWD of them. The radii change the work, not the result.
    """
    known = settled(first_of(right, ["lat2", "lng2"], order))
    places = settled(left.select("lat", "lng").filter("lat IS NOT NULL AND lng IS NOT NULL").distinct())
    row = _cell_row(F.col("lat2"), start / 69.0)
    held = known.groupBy(row.alias("_cy"), _cell_column(F.col("lng2"), row, start / 69.0).alias("_cx")).count().agg(F.avg("count").alias("n")).first().n
    todo, found, miles = places, None, min(start, most) * min(1.0, math.sqrt(CROWD / max(1.0, held or 1.0)))
    while True:
        pairs = radius_join(todo, known, min(miles, most))
        here = settled(first_of(pairs, ["lat", "lng"], "miles", order))
        found = here if found is None else found.unionByName(here)
        if miles >= most:
            break
        todo = todo.join(here.select("lat", "lng"), ["lat", "lng"], "left_anti")
        miles *= growth
    new = [c for c in found.columns if c not in left.columns]
    return left.join(found.select("lat", "lng", *new), ["lat", "lng"], "left").select(*left.columns, *new)


def first_of(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The first row of each group by ascending ``order``, as a partial aggregate: no group is sorted or held. Columns come in another order."""
    rest = [*order, *(c for c in rows.columns if c not in by and c not in order)]
    return rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_first")).select(*by, "_first.*")


def nearest_line(points: DataFrame, lines: DataFrame, by: str, miles: float) -> DataFrame:
    """Each point with its nearest line (line_id, array of structs lat, lng) within ``miles``, measured on a local plane.

    Segments are copied to the cells their box touches, one cell further on all sides; places meet them by cell, and points at one place share their answer.
    """
    step = miles / 69.0
    n = F.size("points")
    pair = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    parts = lines.select("line_id", F.explode(pair).alias("s")).select("line_id", F.col("s.a.lat").alias("a_lat"), F.col("s.a.lng").alias("a_lng"), F.col("s.b.lat").alias("b_lat"), F.col("s.b.lng").alias("b_lng"))
    rows = F.sequence(_cell_row(F.least("a_lat", "b_lat"), step) - 1, _cell_row(F.greatest("a_lat", "b_lat"), step) + 1)
    parts = parts.withColumn("_cy", F.explode(rows))
    columns = F.sequence(_cell_column(F.least("a_lng", "b_lng"), F.col("_cy"), step) - 1, _cell_column(F.greatest("a_lng", "b_lng"), F.col("_cy"), step) + 1)
    parts = parts.withColumn("_cx", F.explode(columns))
    places = points.select("lat", "lng").filter("lat IS NOT NULL AND lng IS NOT NULL").distinct()
    home = places.withColumn("_cy", _cell_row(F.col("lat"), step)).withColumn("_cx", _cell_column(F.col("lng"), F.col("_cy"), step))
    flat = F.cos(F.radians("lat")) * 69.0
    x, y = lambda c: (F.col(c) - F.col("lng")) * flat, lambda c: (F.col(c) - F.col("lat")) * 69.0
    ax, ay, dx, dy = x("a_lng"), y("a_lat"), x("b_lng") - x("a_lng"), y("b_lat") - y("a_lat")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    far = F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))
    pairs = home.join(parts, ["_cy", "_cx"]).withColumn("line_miles", far).filter(F.col("line_miles") <= miles)
    best = first_of(pairs.select("lat", "lng", "line_miles", "line_id"), ["lat", "lng"], "line_miles", "line_id")
    return points.join(best, ["lat", "lng"], "left").select(*points.columns, "line_id", "line_miles")


def polygon_join(points: DataFrame, polygons: DataFrame, by: str, cell: float = 0.05) -> DataFrame:
    """Pairs of a point (lat, lng) and a polygon that holds it (polygon_id, rings: arrays of structs x, y; holes by the even-odd rule).

    Polygons are copied to the cells of their outer box; points meet them by cell, then rays are cast.
    """
    x, y = (F.transform(F.flatten("rings"), pick) for pick in (lambda p: p["x"], lambda p: p["y"]))
    box = {"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)}
    at = lambda c: F.floor(c / cell).cast("long")
    parts = polygons.withColumn("_cx", F.explode(F.sequence(at(box["x0"]), at(box["x1"])))).withColumn("_cy", F.explode(F.sequence(at(box["y0"]), at(box["y1"]))))
    home = points.withColumn("_cx", at(F.col("lng"))).withColumn("_cy", at(F.col("lat")))
    return home.join(parts, ["_cx", "_cy"]).filter(point_in_polygon(F.col("lng"), F.col("lat"), F.col("rings"))).drop("_cx", "_cy", "rings")


def variant_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, variants) -> DataFrame:
    """Left rows with the right row that the best variant of their key meets (ties to the smaller right key); nulls where none does.

    ``variants`` makes an array of ways to write a key, best first. Right rows are listed under each of their variants too.
    """
    one = settled(left.withColumn("_row", F.monotonically_increasing_id()))  # written, so both sides of the join below see the same numbers
    tried = one.select("_row", F.posexplode(variants(F.col(left_key))).alias("_place", "_key"))
    known = first_per(right.select("*", F.posexplode(variants(F.col(right_key))).alias("_other", "_key")), ["_key"], [F.asc("_other"), F.asc(right_key)])
    hits = first_per(tried.join(known, "_key"), ["_row"], [F.asc("_place"), F.asc("_other"), F.asc(right_key)])
    return one.join(hits.drop("_key", "_other").withColumnRenamed("_place", "variant"), "_row", "left").drop("_row")


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both snapshots whose value differs, nulls included."""
    a, b = old.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    return a.join(b, key).filter(~F.col("before").eqNullSafe(F.col("after")))


def merge_presets(scored: DataFrame, key: list[str], preset: str, value: str, names: list[str]) -> DataFrame:
    """One row a key with a column for each preset and the best of them."""
    wide = scored.groupBy(*key).pivot(preset, names).agg(F.max(value))
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return wide.withColumn("best", best)


def token_search(rows: DataFrame, haystack: str, query: str, address: str) -> DataFrame:
    """Rows that hold every word of the query; 3 points where the address starts with it, 2 where it holds it."""
    words = [w for w in query.upper().split() if w]
    text = F.upper(haystack)
    hit = F.lit(True)
    for w in words:
        hit = hit & text.contains(w)
    q = " ".join(words)
    score = F.when(F.upper(address).startswith(q), 3).when(F.upper(address).contains(q), 2).otherwise(0)
    return rows.filter(hit).withColumn("addr_score", score)


def house_search(rows: DataFrame, address: str, house: str) -> DataFrame:
    """Rows at a house number: the number, then no further digit."""
    return rows.filter(F.col(address).rlike(f"^{house}([^0-9]|$)"))


def prefix_index(rows: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """An inverted index of words by their prefixes: (prefix, key), each once.

    A key's texts are brought together and its prefixes made distinct in its row, so no table of prefixes is aggregated.
    """
    words = lambda t: F.filter(F.split(F.regexp_replace(F.upper(t), "[^A-Z0-9]+", " "), " "), lambda w: F.length(w) >= least)
    prefixes = lambda w: F.transform(F.sequence(F.lit(least), F.length(w)), lambda n: F.substring(w, F.lit(1), n))
    held = rows.groupBy(key).agg(F.collect_set(text).alias("_texts")).select(key, F.array_distinct(F.flatten(F.transform("_texts", words))).alias("_words"))
    return held.select(key, F.explode(F.array_distinct(F.flatten(F.transform("_words", prefixes)))).alias("prefix"))


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd ray casting over rings (arrays of structs x, y), holes included; rings are closed or not."""

    def crossings(ring):
        n = F.size(ring)
        at = F.when(n > 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def edge(total, i):
            a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
            cross = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
            return total + F.when(cross, 1).otherwise(0)

        return F.aggregate(at, F.lit(0), edge)

    return F.pmod(F.aggregate(rings, F.lit(0), lambda t, r: t + crossings(r)), F.lit(2)) == 1


def as_of_join(subjects: DataFrame, sales: DataFrame, by: str, at: str, when: str, value: list[str], key: str) -> DataFrame:
    """For each subject the latest sale strictly before its date (ties to the larger key); columns of sales named prior_*.

    Subjects and sales are sorted together once for each ``by``; no pairs are made.
    """
    names = list(dict.fromkeys([when, key, *value]))
    known = sales.select(F.col(by), F.col(when).alias("_day"), F.struct(*(F.col(c).alias(f"prior_{c}") for c in names)).alias("_sale"), F.lit(False).alias("_asks"))
    rows = subjects.withColumn("_day", F.col(at)).withColumn("_asks", F.lit(True)).unionByName(known, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy(F.datediff("_day", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_last", F.max("_sale").over(before)).filter("_asks").select(*subjects.columns, "_last.*")


def diff(before: DataFrame, after: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """NEW, DROPPED and CHANGED keys between two scored tables."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "DROPPED").when(F.abs(F.col("new") - F.col("old")) >= least, "CHANGED")
    return a.join(b, key, "full_outer").withColumn("change", change).filter("change IS NOT NULL")
