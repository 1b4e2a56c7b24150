"""Subjects from numbers and typed addresses on hand-made rows; text containment against a plain loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from parcelspark.plans import resolve


def test_containing_against_a_loop(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 12)))
    asked, rows = [(i, word() if i else None) for i in range(40)], [(i, word() if i else None) for i in range(60)]
    got = resolve.containing(spark.createDataFrame(asked, "a long, q string"), "q", spark.createDataFrame(rows, "b long, w string"), "w")
    want = {(a, b) for a, q in asked for b, w in rows if q and w and len(q) >= 3 and q in w}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_texts(spark):
    cases = [(" 12 Oak st,  Boone VA 24060-1234", "12 OAK ST, BOONE", "OAK ST"), ("7b N Main Street", "7B N MAIN STREET", "MAIN STREET"), ("Oak St", "OAK ST", None), ("", "", None), (None, None, None), ("5 SW Elm,x", "5 SW ELM,X", "ELM")]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, t string").select("i", resolve.normalised(F.col("t")).alias("n"), resolve.street_of(F.col("t")).alias("s")).orderBy("i").collect()
    assert [(r.n, r.s) for r in got] == [c[1:] for c in cases]


def test_the_cascade(spark):
    day = dt.date(2001, 1, 1)
    listings = spark.createDataFrame([
        (1, 10, "12 Oak Street", "Boone", "Closed", day, None, None), (2, 10, "12 Oak Street", "Boone", "Active", day, None, None), (3, 11, "14 Oak Street", "BOONE", "Closed", day, 37.0, -81.0), (4, 12, "16 Oak Street", "Boone ", "Closed", None, 39.0, -83.0), (5, 13, "18 Oak Street", "Boone", "Closed", day, 38.0, -82.0), (6, None, None, None, None, None, None, None),
    ], "listing_id long, parcel_id long, address string, city string, status string, list_date date, lat double, lng double")
    parcels = spark.createDataFrame([(10, "12 Oak St", "Boone", "X", 5.0, day, None, None), (20, "120 Elm Ave", "Ada", "X", 6.0, day, 36.0, -80.0), (21, "12 Elm Ave", "Ada", "Y", 7.0, None, None, None), (22, "", "Ada", "Y", 8.0, None, None, None), (23, "30 Oak Street", "Boone", "X", 9.0, day, None, None)], "parcel_id long, site_address string, city string, county string, assessed double, last_sale_date date, lat double, lng double")
    subjects = spark.createDataFrame([(1, None, " 10 "), (2, "12 oak st Boone VA", None), (3, "12 Elm Avenue", None), (4, "nowhere at all", "20"), (5, "zz", "99"), (6, None, None), (7, "", " "), (8, "30 Oak St", None), (9, "16 OAK", "404")], "subject_id long, asked_address string, asked_parcel string")
    got = {r.subject_id: (r.step, r.listing_id, r.parcel_id, r.lat, r.place) for r in resolve.resolve(subjects, listings, parcels).collect()}
    assert got == {
        1: ("listing_number", 2, 10, 38.0, "street"), 2: ("listing_address", 2, 10, 38.0, "street"), 3: ("parcel_address", None, 21, None, "none"), 4: ("parcel_number", None, 20, 36.0, "own"), 5: ("none", None, None, None, "none"), 6: ("none", None, None, None, "none"),
        7: ("none", None, None, None, "none"), 8: ("parcel_address", None, 23, 38.0, "street"), 9: ("listing_address", 4, 12, 39.0, "own"),
    }
    nothing = resolve.resolve(subjects, listings.filter("false"), parcels.filter("false"))
    assert {r.step for r in nothing.collect()} == {"none"} and nothing.count() == 9


def test_rows_of_one_address_make_no_pairs_of_their_own(spark, monkeypatch):
    found, whole = [], resolve.containing
    monkeypatch.setattr(resolve, "containing", lambda *a: found.append(whole(*a)) or found[-1])
    day = F.lit("2001-01-01").cast("date")
    listings = spark.range(1, 201).select(F.col("id").alias("listing_id"), F.col("id").alias("parcel_id"), F.lit("12 Oak St").alias("address"), F.lit("Boone").alias("city"), F.when(F.col("id") == 150, "Active").otherwise("Closed").alias("status"), F.date_add(day, F.col("id").cast("int")).alias("list_date"), *(F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias(c) for c in ("lat", "lng")))
    parcels = spark.range(1, 201).select(F.col("id").alias("parcel_id"), F.lit("30 Elm St").alias("site_address"), F.lit("Boone").alias("city"), F.lit("X").alias("county"), F.lit(1.0).alias("assessed"), F.date_add(day, (F.col("id") % 190).cast("int")).alias("last_sale_date"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lng")))
    subjects = spark.range(100).select(F.col("id").alias("subject_id"), F.when(F.col("id") < 50, "12 oak st").otherwise("30 elm st").alias("asked_address"), F.lit(None).cast("string").alias("asked_parcel"))
    got = resolve.resolve(subjects, listings, parcels).collect()
    assert {(r.step, r.listing_id, r.parcel_id, r.lat, r.place) for r in got if r.subject_id < 50} == {("listing_address", 150, 150, 150.0, "own")}
    assert {(r.step, r.listing_id, r.parcel_id, r.lat, r.place) for r in got if r.subject_id >= 50} == {("parcel_address", None, 189, None, "none")}
    streets = resolve.street_places(listings, spark.createDataFrame([("OAK ST", "BOONE")], "street string, place_city string")).collect()
    assert [tuple(r) for r in streets] == [("OAK ST", "BOONE", 22.0, 22.0)]
    assert len(found) == 4 and all(f.count() <= 12 for f in found)
