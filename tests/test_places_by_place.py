"""Joins by place over many rows at few places: the pairs made are of places."""

from pyspark.sql import functions as F

from parcelspark.operators.relational import nearest, nearest_line
from parcelspark.plans import leads, sites

COPIES = 40


def rows_made(df) -> int:
    """The most rows that a join of the plan gave, as it ran."""
    made = []

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            made.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return max(made, default=0)


def points(spark, n: int, shift: int = 0):
    """n places with COPIES rows each."""
    i = F.col("id") % n
    return spark.range(n * COPIES).select((F.col("id") + shift).alias("id"), (37 + (i * 7 % 50) / 100).alias("lat"), (-81 + (i * 11 % 50) / 100).alias("lng"))


def test_nearest_with_many_rows_at_a_place(spark):
    left, right = points(spark, 50).withColumnRenamed("id", "a"), points(spark, 30, 1000).select(F.col("id").alias("b"), (F.col("lat") + 0.003).alias("lat2"), F.col("lng").alias("lng2"))
    left = left.unionByName(spark.createDataFrame([(99_999, None, -81.0)], "a long, lat double, lng double"))
    got = nearest(left, right, "a", "b", 5.0, 80.0)
    pairs = left.join(F.broadcast(right)).filter("lat IS NOT NULL").toPandas()
    want = {}
    from math import asin, cos, radians, sin, sqrt

    for a, lat, lng, b, lat2, lng2 in pairs.itertuples(index=False):
        m = 2 * 3958.7613 * asin(sqrt(sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lng2 - lng) / 2) ** 2))
        want[a] = min(want.get(a, (1e9, 0)), (round(m, 9), b))
    seen = {r.a: (None if r.b is None else (round(r.miles, 9), r.b)) for r in got.collect()}
    assert seen == {**want, 99_999: None}
    assert rows_made(got) <= 50 * COPIES + 1


def test_near_infrastructure_makes_pairs_of_places(spark):
    parcels = points(spark, 50).withColumnRenamed("id", "parcel_id")
    infra = points(spark, 30).select(F.col("id").alias("infra_id"), F.element_at(F.array(*map(F.lit, ("substation", "fibre", "water"))), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.lit(115).alias("kv"), F.lit(0.5).alias("capacity"), "lat", "lng")
    got = sites.near_infrastructure(parcels, infra)
    assert got.count() == 50 * COPIES and rows_made(got) <= 50 * COPIES


def test_nearest_line_makes_pairs_of_places(spark):
    lines = spark.createDataFrame([(1, [(37.0, -81.0), (37.5, -80.5)]), (2, [(37.0, -80.5), (37.5, -81.0)])], "line_id long, points array<struct<lat: double, lng: double>>")
    got = nearest_line(points(spark, 50), lines, "id", 10.0)
    assert got.count() == 50 * COPIES and rows_made(got) <= 50 * COPIES


def test_neighbours_of_sales_makes_pairs_with_places(spark):
    rows = points(spark, 50).select(F.col("id").alias("listing_id"), F.when(F.col("id") < 1000, "Active").otherwise("Closed").alias("status"), F.lit("2001-08-01").cast("date").alias("close_date"), (F.col("id") * 1.5).alias("sold_price"), "lat", "lng")
    got = leads.neighbours_of_sales(rows, "2001-08-02")
    assert {r.n_sales for r in got.collect()} == {20} and got.count() == 1000
    assert rows_made(got) <= 1000  # 20 sales at each of 50 places; all listings with all sales at their place would be 20,000


def test_assemblages_with_many_parcels_at_a_place(spark, monkeypatch):
    from parcelspark.plans import sites as plan

    seen, components = [], plan.components
    monkeypatch.setattr(plan, "components", lambda nodes, links: seen.append((nodes.count(), links.count())) or components(nodes, links))
    big = points(spark, 50).select(F.col("id").alias("parcel_id"), "lat", "lng", F.lit(30.0).alias("acres"), F.concat(F.lit("SMITH "), F.element_at(F.array(*map(F.lit, ("JOHN", "MARY", "PAUL"))), (F.col("id") % 3 + 1).cast("int"))).alias("owner1"))
    got = {r.component: (r.n_parcels, r.n_owners) for r in plan.assemblages(big).collect()}
    assert seen[0][0] == 50 and sum(n for n, _ in got.values()) == 50 * COPIES and all(x[1] == 3 for x in got.values())
    assert seen[0][1] < 50 * 49 / 2
