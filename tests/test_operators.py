"""Joins and streams on small tables with results known by hand."""

from pyspark.sql import functions as F

import __spark_entry__
from parcelspark.operators.relational import as_of_join, diff, point_in_polygon, prefix_index, radius_join, range_join
from parcelspark.streaming import windows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_range_join_bounds_and_unknown_class(spark):
    rows = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("A", None), ("B", 10.0)], "class_id string, p double")
    bands = spark.createDataFrame([("A", 0.0, 20.0, "low"), ("A", 20.0, 1e15, "high")], "class_id string, lo double, hi double, band string")
    got = [(r.class_id, r.p, r.band) for r in range_join(rows, bands, "p").collect()]
    assert sorted(got, key=str) == sorted([("A", 10.0, "low"), ("A", 20.0, "high"), ("A", None, None), ("B", 10.0, None)], key=str)


def test_polygon_with_a_hole(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rings = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))]
    df = spark.createDataFrame([(1.0, 1.0, rings), (5.0, 5.0, rings), (11.0, 5.0, rings)], "x double, y double, rings array<array<struct<x: double, y: double>>>")
    assert [r.inside for r in df.select(point_in_polygon(F.col("x"), F.col("y"), F.col("rings")).alias("inside")).collect()] == [True, False, False]


def test_radius_join_finds_neighbours_across_cells(spark):
    left = spark.createDataFrame([(1, 37.0, -81.0)], "id long, lat double, lng double")
    right = spark.createDataFrame([(1, 37.0, -81.0), (2, 37.0144, -81.0), (3, 37.02, -81.0), (4, 37.0, -81.0181)], "other long, lat2 double, lng2 double")
    assert sorted(r.other for r in radius_join(left, right, 1.0).collect()) == [1, 2, 4]


def test_as_of_is_strictly_before(spark):
    sales = spark.createDataFrame([(1, 7, "2001-01-01", 10.0), (2, 7, "2001-01-01", 11.0), (3, 7, "2001-06-01", 12.0)], "id long, parcel long, d string, price double").withColumn("d", F.col("d").cast("date"))
    got = {r.id: r.prior_price for r in as_of_join(sales, sales, "parcel", "d", "d", ["price"], "id").collect()}
    assert got == {1: None, 2: None, 3: 11.0}


def test_diff(spark):
    a, b = (spark.createDataFrame(x, "k long, v double") for x in ([(1, 1.0), (2, 5.0), (3, 2.0)], [(2, 11.0), (3, 2.5), (4, 1.0)]))
    assert {r.k: r.change for r in diff(a, b, "k", "v", 5.0).collect()} == {1: "DROPPED", 2: "CHANGED", 4: "NEW"}


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tmp_path / "in"
    batch.write.parquet(str(folder))
    stream = windows.tumbling(spark.readStream.schema(batch.schema).parquet(str(folder)))
    windows.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = lambda df: {(r.window_start, r.event_type, r.n) for r in df.collect()}
    got, want = rows(spark.read.parquet(str(tmp_path / "out"))), rows(windows.tumbling(batch))
    last = max(x[0] for x in want)  # the last window is still open
    assert {x for x in got if x[0] < last} == {x for x in want if x[0] < last}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def test_prefix_index_makes_prefixes_distinct_in_their_row(spark):
    rows = spark.createDataFrame([(1, "ab abc"), (1, "AB-x"), (2, None), (2, "abd"), (None, "zz"), (3, "q")], "k long, t string")
    index = prefix_index(rows, "k", "t")
    assert sorted(((r.k or 0, r.prefix) for r in index.collect())) == [(0, "ZZ"), (1, "AB"), (1, "ABC"), (2, "AB"), (2, "ABD")]
    assert "Aggregate [k" in (plan := index._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate [k" not in plan.split("Generate")[0]
