"""Owners' keys are worked out once for each way of writing a name, and sellers' neighbours by place."""

from pyspark.sql import functions as F

from parcelspark.plans import owners, sellers
from parcelspark.queries.models import _weekly
from parcelspark.sources.bridge import listings, parcels

DATA = "/root/testdata/sf0.01"


def test_owner_keys_once_a_name(spark, monkeypatch):
    sizes, settled = [], owners.settled
    monkeypatch.setattr(owners, "settled", lambda df: sizes.append(df.count()) or settled(df))
    rows = spark.range(3000).select(F.col("id").alias("parcel_id"), F.lit("A").alias("county"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("Smith "), F.element_at(F.array(*map(F.lit, ("John", "Mary", "LLC"))), (F.col("id") % 3 + 1).cast("int")))).alias("owner1"))
    got = {r.canonical_owner_id: r.n_parcels for r in owners.owner_portfolios(rows).collect()}
    assert got == {"PER:SMITH JOHN": 750, "PER:SMITH MARY": 750, "ENT:SMITH": 750}
    assert sizes == [4, 4]
    assert owners.owner_keys(rows).filter("canonical_owner_id IS NULL AND owner_class = 'unknown'").count() == 750


def test_seller_scoring_meets_places(spark, monkeypatch):
    met, join = [], sellers.radius_join
    monkeypatch.setattr(sellers, "radius_join", lambda a, b, miles: met.append((a.count(), a.distinct().count(), b.count(), b.distinct().count())) or join(a, b, miles))
    p = parcels(spark, DATA)
    owed = p.filter("parcel_id % 17 = 0").select("parcel_id", F.lit(1.0).alias("amount"))
    sellers.seller_scoring(p, listings(spark, DATA), sellers.monthly_rates(_weekly(spark)), owed, p.filter("parcel_id % 10 = 1"), "2001-08-02").collect()
    assert len(met) == 1 and met[0][0] == met[0][1] <= 1000 and met[0][2] == met[0][3]
