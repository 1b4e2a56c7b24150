"""Segments with bootstrap intervals against resampling here; slopes on planes and odd zones."""

import math

import numpy as np
import pytest

from parcelspark.plans import segments, terrain

SCORED = "id long, sold_price double, estimate double, low double, high double, class_id string, county string, acres double, sqft double, has_geo boolean"


def scored_rows(n=1500):
    rnd = np.random.default_rng(5)
    sold = rnd.uniform(50_000, 1_500_000, n)
    est = sold * np.exp(rnd.normal(0.03, 0.2, n))
    return [(i, float(sold[i]), float(est[i]), float(est[i] * 0.9), float(est[i] * 1.1), "AB"[i % 2], None if i % 50 == 0 else f"C{i % 3}", None if i % 7 == 0 else float(i % 60), float(i % 11 * 600), i % 5 != 0) for i in range(n)]


def test_segments_and_missing_values(spark):
    rows = [*scored_rows(200), (900, 0.0, 1.0, 1.0, 1.0, "A", "C1", 1.0, 1.0, True), (901, 10.0, None, None, None, "A", "C1", 1.0, 1.0, True), (902, 100.0, 100.0, None, 120.0, None, None, None, None, None)]
    got = {(r.cut, r.segment): r for r in segments.segment_metrics(segments.with_segments(spark.createDataFrame(rows, SCORED))).collect()}
    good = [r for r in rows if r[1] > 0 and r[2] is not None]
    assert got["overall", "all"].n == len(good)
    assert {s for c, s in got if c == "join_success"} == {"has_geo", "no_geo"} and got["county", ""].n == sum(r[6] is None for r in good)
    assert got["acre_tier", "(no acres)"].n == sum(r[7] is None for r in good) and got["sqft_tier", "(no sqft)"].n == sum(not r[8] for r in good)
    some = [abs(r[2] / r[1] - 1) for r in good if 150_000 <= r[1] < 300_000]
    assert math.isclose(got["price_band", "150-300k"].median_ape, np.median(some)) and math.isclose(got["price_band", "150-300k"].ppe10, np.mean(np.array(some) <= 0.1))
    for cut in segments.CUTS:
        assert sum(r.n for (c, _), r in got.items() if c == cut) == len(good)


def test_bootstrap_interval_against_resampling(spark):
    rows = scored_rows()
    table = segments.with_segments(spark.createDataFrame(rows, SCORED))
    got = {(r.cut, r.segment): r for r in segments.bootstrap(table, 200).collect()}
    ape = np.array([abs(r[2] / r[1] - 1) for r in rows])
    rnd = np.random.default_rng(1)
    drawn = [rnd.choice(ape, len(ape)) for _ in range(2000)]
    r = got["overall", "all"]
    for name, stat in (("mape", np.mean), ("median_ape", np.median), ("ppe10", lambda x: np.mean(x <= 0.1))):
        low, high = np.quantile([stat(x) for x in drawn], [0.025, 0.975])
        width = high - low
        assert abs(r[f"{name}_low"] - low) < 0.35 * width and abs(r[f"{name}_high"] - high) < 0.35 * width, name
        assert r[f"{name}_low"] <= stat(ape) + segments.STEP and r[f"{name}_high"] >= stat(ape) - segments.STEP
    again = {(r.cut, r.segment): r for r in segments.bootstrap(table.repartition(7), 200).collect()}
    assert all(math.isclose(again[k].mape_low, r.mape_low, rel_tol=1e-9) and again[k].median_ape_high == r.median_ape_high for k, r in got.items())
    narrow = got["class", "A"]
    assert narrow.mape_high - narrow.mape_low > r.mape_high - r.mape_low


def test_poisson_weights_are_poisson(spark):
    from pyspark.sql import functions as F

    w = [r.w for r in spark.range(20000).select(segments.poisson_weight(F.col("id"), F.lit(3)).alias("w")).collect()]
    assert abs(np.mean(w) - 1) < 0.03 and abs(np.var(w) - 1) < 0.05 and abs(np.mean(np.array(w) == 0) - math.exp(-1)) < 0.01


GRID = terrain.Grid(37.0, -81.0, 0.001)


def plane(spark, a, b, side=40):
    return spark.createDataFrame([(r, c, float(a * r + b * c)) for r in range(side) for c in range(side) if (r, c) != (20, 20)], "row int, col int, z double")


def test_slope_of_a_plane_and_cells_without_elevation(spark):
    got = {(r.row, r.col): r.slope for r in terrain.slopes(plane(spark, 3.0, 2.0), GRID).collect()}
    assert len(got) == 38 * 38 - 5  # the border, the missing cell and its neighbours
    step = 0.001 * terrain.METRES_PER_DEGREE
    for (r, _), s in got.items():
        across = step * math.cos(math.radians(37.0 + (r + 0.5) * 0.001))
        assert math.isclose(s, 100 * math.hypot(2 / across, 3 / step), rel_tol=1e-9)


def test_parcels_weigh_cells_by_area(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(40) for c in range(40)], "row int, col int, slope double")
    rows = [(1, 37.0100, -80.9900, 2.0), (2, 37.0153, -80.9851, 20.0), (3, 37.5, -80.5, 1.0), (4, None, -80.99, 1.0), (5, 37.0155, -80.9855, None), (6, 37.0155, -80.9855, 0.0)]
    got = {r.parcel_id: r for r in terrain.parcel_slopes(spark.createDataFrame(rows, "parcel_id long, lat double, lng double, acres double"), cells, GRID).collect()}
    assert set(got) == {1, 2, 5, 6}
    for key, lat, lng, acres in rows:
        if key not in got:
            continue
        half = math.sqrt((acres or 0.5) * terrain.ACRE_M2 / math.pi) / terrain.METRES_PER_DEGREE
        wide = half / math.cos(math.radians(lat))
        total = mean = 0.0
        n, most = 0, 0.0
        for r in range(40):
            for c in range(40):
                y, x = 37.0 + r * 0.001, -81.0 + c * 0.001
                w = max(0, min(lat + half, y + 0.001) - max(lat - half, y)) * max(0, min(lng + wide, x + 0.001) - max(lng - wide, x))
                if w > 1e-15:
                    total, mean, n, most = total + w, mean + w * (10 * r + c), n + 1, max(most, 10.0 * r + c)
        assert math.isclose(got[key].slope_mean_pct, mean / total, rel_tol=1e-6) and got[key].slope_max_pct == most and got[key].slope_n_cells == n


def test_polygons_with_holes(spark):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    cells = spark.createDataFrame([(r, c, 1.0 if c < 20 else 9.0) for r in range(40) for c in range(40)], "row int, col int, slope double")
    outer, hole = ring(-80.99, 37.01, -80.97, 37.03), ring(-80.98, 37.01, -80.97, 37.03)
    shapes = spark.createDataFrame([(1, [outer]), (2, [outer, hole]), (3, []), (4, None)], "polygon_id long, rings array<array<struct<x: double, y: double>>>")
    got = {r.polygon_id: r for r in terrain.polygon_slopes(shapes, cells, GRID).collect()}
    assert set(got) == {1, 2}
    assert math.isclose(got[1].slope_mean_pct, 5.0, rel_tol=0.05) and got[2].slope_mean_pct == pytest.approx(1.0, abs=0.01) and got[2].pct_under_5pct_slope == pytest.approx(100)
