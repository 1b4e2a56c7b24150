"""Learned models: held-out bounds, no own target in a mean, repeatable fits; metrics against DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.operators.treesum import tree_sum
from parcelspark.operators.relational import range_join
from parcelspark.plans import boosting, encoding, models
from parcelspark.sources.bridge import listings, price_bands

DATA, UNTIL = "/root/testdata/sf0.01", "2000-06-01"


@pytest.fixture(scope="module")
def rows(spark):
    return listings(spark, DATA)


def test_tree_sum_does_not_depend_on_how_rows_are_dealt(spark):
    def of(batches):
        return np.sum([np.bincount(b.column("id").to_numpy() % 5, minlength=5) for b in batches] or [np.zeros(5, np.int64)], 0)

    want = np.bincount(np.arange(1000) % 5, minlength=5)
    for n in (1, 7, 150):
        assert (tree_sum(spark.range(1000).repartition(n), 5, of) == want).all()
    assert (tree_sum(spark.range(0), 5, of) == 0).all()


def test_means_leave_the_own_fold_out(spark):
    data = [(i, "ab"[i % 2] if i % 7 else None, float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k string, y double")
    fold = {r.id: r.f for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(encoding.FOLDS)).alias("f")).collect()}
    got = {r.id: r.m for r in encoding.target_means(df, df, "k", "y", "id", True, "m").collect()}
    for i, k, _ in data:
        rest = [(q, y) for j, q, y in data if fold[j] != fold[i]]
        overall = sum(y for _, y in rest) / len(rest)
        own = [y for q, y in rest if q == k]
        assert math.isclose(got[i], (sum(own) + 20 * overall) / (len(own) + 20))
    new = spark.createDataFrame([(1, "a"), (2, "never"), (3, None)], "id long, k string")
    seen = {r.id: r.m for r in encoding.target_means(new, df, "k", "y", "id", False, "m").collect()}
    a = [y for _, k, y in data if k == "a"]
    overall = sum(y for *_, y in data) / len(data)
    assert math.isclose(seen[1], (sum(a) + 20 * overall) / (len(a) + 20)) and math.isclose(seen[2], overall)
    empty = df.filter("false")
    assert encoding.target_means(empty, empty, "k", "y", "id", True, "m").count() == 0
    assert encoding.target_means(new, empty, "k", "y", "id", False, "m").filter("m IS NOT NULL").count() == 0


def test_trees_find_the_quantiles_of_a_known_law(spark):
    rnd = np.random.default_rng(3)
    x, z = rnd.uniform(0, 1, 6000), rnd.uniform(0, 1, 6000)
    y = np.where(x < 0.5, 10.0, 40.0) + rnd.uniform(-8, 8, 6000)
    df = spark.createDataFrame([(int(i), float(a), None if i % 9 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "id long, x double, z double, y double").cache()
    model = boosting.fit(df.filter("id < 4000"), ["x", "z"], "y", rounds=12, rate=0.4, least=20)
    again = boosting.fit(df.filter("id < 4000"), ["x", "z"], "y", rounds=12, rate=0.4, least=20)
    assert all((a == b).all() for r, s in zip(model.rounds, again.rounds, strict=True) for t, u in zip(r, s, strict=True) for a, b in zip(t, u, strict=True))
    got = boosting.predicted(model, df.filter("id >= 4000"), ["id", "x", "y"]).collect()
    assert all(r.p25 <= r.p50 <= r.p75 for r in got)
    for low in (True, False):
        some = [r for r in got if (r.x < 0.48 if low else r.x > 0.52)]
        for name, want in (("p25", -4), ("p50", 0), ("p75", 4)):
            assert abs(np.mean([r[name] for r in some]) - (10 if low else 40) - want) < 1.5
    assert abs(np.mean([r.p25 <= r.y <= r.p75 for r in got]) - 0.5) < 0.05


def test_days_on_market_beat_cohort_quartiles(spark, rows):
    got = models.day_predictions(rows, UNTIL).cache()
    assert got.filter("p25 > p50 OR p50 > p75").count() == 0
    metrics = {r.class_id: r for r in models.day_metrics(got).collect()}
    whole = metrics[None]
    bands = price_bands(spark)
    cohorts = models.day_quantiles(rows.filter(f"dom <= {models.MOST_DAYS}"), bands, UNTIL).withColumnsRenamed({f"p{p}": f"c{p}" for p in (25, 50, 75)})
    both = range_join(rows.join(got.drop("class_id", "dom"), "listing_id"), bands, "list_price").join(cohorts, ["class_id", "city", "band"])
    loss = lambda c, p: F.sum(F.greatest(p / 100 * (F.col("dom") - F.col(c)), (p / 100 - 1) * (F.col("dom") - F.col(c)))).alias(c)
    sums = both.agg(*(loss(f"{x}{p}", p) for p in (25, 50, 75) for x in "pc")).first()
    assert all(sums[f"p{p}"] < sums[f"c{p}"] for p in (25, 50, 75)), sums
    assert abs(whole.coverage - 0.5) < 0.03
    con = duckdb.connect()
    con.register("predictions", got.toArrow())
    losses = ", ".join(f"avg(greatest({p / 100} * (dom - p{p}), {p / 100 - 1} * (dom - p{p})))" for p in (25, 50, 75))
    for c, n, mae, coverage, *pinball in con.execute(f"SELECT class_id, count(*), avg(abs(dom - p50)), avg(CAST(dom BETWEEN p25 AND p75 AS DOUBLE)), {losses} FROM predictions GROUP BY ROLLUP (class_id)").fetchall():
        r = metrics[c]
        assert r.n == n and all(math.isclose(a, b) for a, b in zip((mae, coverage, *pinball), (r.mae, r.coverage, r.pinball_25, r.pinball_50, r.pinball_75), strict=True))


def test_price_for_days_takes_the_highest_price_that_will_do(spark, rows):
    model, early = models.day_model(rows, UNTIL, rounds=2)
    some = rows.filter("status = 'Active'").limit(5).withColumn("list_price", F.when(F.col("listing_id") % 2 == 0, F.lit(5000.0)).otherwise(F.col("list_price"))).cache()
    price = {r.listing_id: r.list_price for r in some.collect()}
    for target, feasible in ((1e9, True), (-1e9, False)):
        for r in models.price_for_days(model, early, some, target).collect():
            low, high = max(int(price[r.listing_id] * 0.75), 25_000), int(price[r.listing_id] * 1.25)
            grid = list(range(low, high + 5000, 5000))
            assert r.feasible is feasible and r.price in grid and (r.price == grid[-1] or not feasible)


def test_price_for_days_works_means_out_before_the_grid(spark, rows):
    model, early = models.day_model(rows, "2000-06-01", 2)
    out = models.price_for_days(model, early, rows.filter("status = 'Active'"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join" not in plan[: plan.index("Generate explode")]


def test_best_offers_against_a_loop(spark):
    edges = np.arange(1.0, 10.0)
    model = boosting.Trees(["price"], (0.25, 0.5), [edges], np.array([50.0, 60.0]), 1, [[(np.zeros(1, np.int64), np.array([4]), np.array([0.0, 20.0])), (np.zeros(1, np.int64), np.array([c]), np.array([-5.0, 7.0]))] for c in (2, 6)])
    some = [(k, float(x)) for k in range(6) for x in range(k, 10)] + [(3, 0.5), (1, 0.25)]  # keys 1 and 3 come in two pieces
    got = {r.key: tuple(r)[1:] for r in boosting.best_offers(model, spark.createDataFrame(some, "key long, price double").coalesce(1), "key", "price", "p50", 62.0).collect()}
    for k in range(6):
        prices = np.array([x for key, x in some if key == k])
        days = np.sort(model.predict(np.stack([np.searchsorted(edges, prices, "right")]).astype(np.uint8)), 0)[1]
        hit = max(((x, d) for x, d in zip(prices, days, strict=True) if d <= 62), default=(None, None))
        near = min((d, x) for x, d in zip(prices, days, strict=True))
        assert got.pop(k) == (*hit, near[1], near[0])
    assert not got


def test_value_model_on_prices_that_follow_the_size(rows):
    priced = rows.withColumn("sold_price", F.when(F.col("sold_price").isNotNull(), F.col("sqft") * (150 + F.pmod(F.xxhash64("listing_id"), F.lit(20)))))
    _, got = models.value_model(priced, UNTIL, trees=10)
    got = got.collect()
    mean = models.sales(priced).filter(f"close_date < '{UNTIL}'").agg(F.avg(F.log1p("sold_price"))).first()[0]
    error = np.mean([abs(math.log1p(r.sold_price) - math.log1p(r.model_value)) for r in got])
    assert error < 0.3 * np.mean([abs(math.log1p(r.sold_price) - mean) for r in got])
    again = {r.listing_id: r.model_value for r in models.value_model(priced, UNTIL, trees=10)[1].collect()}
    assert all(math.isclose(again[r.listing_id], r.model_value, rel_tol=1e-6) for r in got)


def test_cut_model_metrics(rows):
    scored = models.cut_model(rows, UNTIL, trees=3).cache()
    bins = models.cut_metrics(scored).collect()
    pairs = [(r.p, r.y) for r in scored.collect()]
    assert sum(r.n for r in bins) == len(pairs) and math.isclose(sum(r.squares for r in bins), sum((p - y) ** 2 for p, y in pairs), rel_tol=1e-9)
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    auc = np.mean([(np.array(neg) < p).mean() + (np.array(neg) == p).mean() / 2 for p in pos])
    assert abs(bins[0].auc - auc) < 0.01
