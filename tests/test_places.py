"""Regional knobs, relisted places and walking routes on hand-made rows."""

import datetime as dt
import math
import random

from parcelspark.plans import regions, relists, routes


def test_five_levels_of_knobs(spark):
    entries = [("51121", "sqft_factor", 0.9), ("51121", "_note", None), ("county:va:montgomery", "dist_scale", 4.0), ("county:va:montgomery", "dist_scale", 3.0), ("cbsa:13980", "land_rate_hi", 1.0), ("state:NC", "_note", 1.0), ("state:VA", "land_rate_lo", 2.0), ("global", "extra", 7.0), ("global", "dist_scale", None)]
    rows = [(1, "51121", "Montgomery County", "13980", "VA"), (2, "5112", "CITY OF MONTGOMERY co.", None, None), (3, None, "Elsewhere", "13980", "va"), (4, None, None, None, "nc"), (5, " ", "", "", "VA"), (6, None, "Montgomery", None, "MD"), (7, None, None, None, None)]
    got = {r.id: (r.level, r.knobs) for r in regions.knobs(spark.createDataFrame(rows, "id long, fips5 string, county string, cbsa string, state string"), spark.createDataFrame(entries, "region string, name string, value double"), "id").collect()}
    base = {**regions.DEFAULTS, "extra": 7.0}
    want = {1: ("fips", {"sqft_factor": 0.9}), 2: ("county", {"dist_scale": 4.0}), 3: ("cbsa", {"land_rate_hi": 1.0}), 4: ("state", {}), 5: ("state", {"land_rate_lo": 2.0}), 6: ("global", {}), 7: ("state", {"land_rate_lo": 2.0})}
    assert got == {i: (level, {**base, **own}) for i, (level, own) in want.items()}
    none = spark.createDataFrame([], "region string, name string, value double")
    assert [r.knobs for r in regions.knobs(spark.createDataFrame(rows[:1], "id long, fips5 string, county string, cbsa string, state string"), none, "id").collect()] == [regions.DEFAULTS]


def test_relists_by_parcel_and_by_address(spark):
    day = lambda m, d: dt.date(2001, m, d)
    lost, schema = "Expired/Cancelled", "listing_id long, parcel_id string, address string, city string, zip string, status string, expired_at date, list_date date, list_price double"
    rows = [
        (1, "A", "1 Oak Street", "Boone", "24060", lost, day(7, 20), day(1, 1), 1.0), (2, None, "1 OAK ST.", "boone", "24060-1234", "Active", None, day(1, 2), 1.0),  # the place is active under another spelling
        (3, "B", "2 Oak St", "Boone", "24060", lost, day(7, 20), day(1, 1), 1.0), (4, "B", "two oak", "Boone", None, "Closed", None, day(7, 21), 1.0),  # the parcel was listed later
        (5, "C", "3 Oak St", "Boone", "24060", lost, day(7, 10), day(1, 1), 1.0), (6, "C2", "3 Oak Street", "Boone", "24060", lost, day(7, 20), day(1, 1), 2.0),  # one place, the later expiry stays
        (7, None, None, "Boone", None, lost, day(7, 20), day(1, 1), 1.0), (8, None, " ", None, None, lost, day(7, 21), day(1, 1), 1.0), (9, "D", None, None, None, lost, day(7, 5), day(1, 1), 1.0), (10, "D", None, None, None, lost, day(7, 6), day(1, 1), 1.0),
        (11, "E", "4 Oak", "Boone", "1", lost, day(6, 1), day(1, 1), 1.0), (12, "F", "5 Oak", "Boone", "1", lost, day(7, 20), None, 1.0), (13, "F", "5 Oak", "Boone", "1", "Closed", None, day(7, 20), 1.0),
    ]
    got = {r.listing_id for r in relists.unrelisted(spark.createDataFrame(rows, schema), "2001-08-02").collect()}
    assert got == {6, 7, 8, 10, 12}


def greedy(stops):
    miles = lambda a, b: 2 * routes.EARTH_MILES * math.asin(math.sqrt(min(1, math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)))
    left = sorted(stops)
    order = [max(left, key=lambda s: (s[3] or 0.0, -s[0]))]
    left.remove(order[0])
    while left:
        order.append(min(left, key=lambda s: (round(miles(order[-1], s), 12), s[0])))
        left.remove(order[-1])
    return [s[0] for s in order]


def test_small_routes_are_the_greedy_tour(spark):
    rnd = random.Random(1)
    rows = [(r, i, 37 + rnd.random(), -81 + rnd.random(), rnd.choice([None, 1.0, 5.0])) for r in ("x", "y") for i in range(40)] + [("x", 90, None, -81.0, 9.0), ("x", 91, 37.0, None, 9.0), ("z", 1, None, None, None)]
    got = {}
    for r in routes.walking_order(spark.createDataFrame(rows, "route string, stop long, lat double, lng double, score double"), "route", "stop", 100).orderBy("route", "route_order").collect():
        got.setdefault(r.route, []).append((r.stop, r.route_order))
    for name in ("x", "y"):
        want = greedy([r[1:] for r in rows if r[0] == name and r[2] is not None and r[3] is not None])
        assert got[name] == [(s, i) for i, s in enumerate([*want, *([90, 91] if name == "x" else [])], 1)]
    assert got["z"] == [(1, 1)]


def test_large_routes_in_bounded_squares(spark):
    rnd = random.Random(2)
    rows = [("x", i, 37 + rnd.random() ** 3, -81 + rnd.random() ** 3, rnd.random()) for i in range(600)] + [("x", 1000 + i, 37.5, -80.5, None) for i in range(90)]
    df = spark.createDataFrame(rows, "route string, stop long, lat double, lng double, score double")
    got = routes.walking_order(df, "route", "stop", 25).collect()
    assert sorted(r.route_order for r in got) == list(range(1, 691)) and sorted(r.stop for r in got) == sorted(r[1] for r in rows)
    runs, n = [], 0
    for r in sorted(got, key=lambda r: r.route_order):
        if r.miles is None and n:
            runs.append(n)
            n = 0
        n += 1
    held = [*runs, n]
    crowd = math.ceil(90 / 25)
    assert sorted(held)[: len(held) - crowd][-1] <= 25 and max(held) <= 60  # parts of the one crowded cell are dealt by hash
    straight = sum(r.miles or 0 for r in got)
    assert straight < 0.5 * sum(abs(a[2] - b[2]) * 69 for a, b in zip(rows, rows[1:]))
