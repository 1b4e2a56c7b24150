"""Places: what lies near a parcel, suitability of sites, tracts that could be assembled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.columns import haversine_miles
from parcelspark.operators.graph import components
from parcelspark.operators.relational import nearest, radius_join
from parcelspark.operators.stages import settled
from parcelspark.plans.owners import with_owner_keys

# Share of the score by voltage in kV, and presets of least acres and farthest substation.
VOLTAGE = [(500, 1.0), (230, 0.9), (138, 0.7), (115, 0.6)]
PRESETS = {"edge": (2.0, 10.0), "enterprise": (10.0, 5.0), "hyperscale": (25.0, 3.0)}
HUBS = {"north": (37.9, -80.5), "centre": (37.5, -80.5), "south": (37.1, -80.5)}


def near_infrastructure(parcels: DataFrame, infra: DataFrame) -> DataFrame:
    """Each parcel with its nearest substation and fibre point, and the water within five miles. infra_id is the key of ``infra``.

    Water is summed by place, and parcels at one place share its sums, so pairs are of places and not of rows.
    """
    at = lambda kind: infra.filter(F.col("kind") == kind).select("infra_id", "kv", "capacity", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    points = parcels.select("parcel_id", "lat", "lng")
    places = settled(points.select("lat", "lng").filter("lat IS NOT NULL AND lng IS NOT NULL").distinct().withColumn("place", F.monotonically_increasing_id()))
    sub = nearest(places, at("substation"), "place", "infra_id", 5.0, 80.0).select("lat", "lng", F.col("infra_id").alias("substation_id"), F.col("miles").alias("substation_miles"), "kv")
    fibre = nearest(places, at("fibre"), "place", "infra_id", 5.0, 80.0).select("lat", "lng", F.col("miles").alias("fibre_miles"))
    works = at("water").groupBy("lat2", "lng2").agg(F.sum("capacity").alias("capacity"), F.count_distinct("infra_id").alias("works"))
    water = radius_join(places, works, 5.0).groupBy("lat", "lng").agg(F.sum("capacity").alias("water_5mi"), F.sum("works").alias("works_5mi"))
    near = sub.join(fibre, ["lat", "lng"], "left").join(water, ["lat", "lng"], "left")
    return points.join(near, ["lat", "lng"], "left").drop("lat", "lng")


def proximity(miles: Column, full: float, zero: float) -> Column:
    """1 up to ``full`` miles, 0 from ``zero`` on, a line between; 0 where unknown."""
    return F.when(miles <= full, 1.0).when(miles < zero, (zero - miles) / (zero - full)).otherwise(0.0)


def site_scores(parcels: DataFrame, infra: DataFrame) -> DataFrame:
    """Suitability of each parcel under each preset, with the hard filters it fails."""
    rows = with_owner_keys(parcels.select("parcel_id", "acres", "owner1")).join(near_infrastructure(parcels, infra), "parcel_id")
    volt = F.lit(0.4)
    for kv, share in reversed(VOLTAGE):
        volt = F.when(F.col("kv") >= kv, share).otherwise(volt)
    water = F.coalesce("water_5mi", F.lit(0.0))
    each = []
    for name, (acres, most) in PRESETS.items():
        power = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("substation_miles") / most), F.lit(0.0)) * volt * 40
        land = F.when(F.col("acres") < acres, 0.0).when(F.col("acres") >= 4 * acres, 1.0).otherwise((F.col("acres") - acres) / (3 * acres)) * 20
        wet = F.when(water >= 10, 1.0).when(water >= 3, 0.7).when(water >= 1, 0.4).when(water > 0, 0.1).otherwise(0.0) * 20
        fails = F.array_compact(F.array(F.when(F.coalesce("acres", F.lit(0.0)) < acres, "acres"), F.when(F.col("owner_class") == "govt_or_institution", "owner"), F.when(F.coalesce("substation_miles", F.lit(1e9)) > most, "substation")))
        each.append(F.struct(F.lit(name).alias("preset"), (power + land + wet + proximity(F.col("fibre_miles"), 1.0, 5.0) * 20).alias("score"), F.array_join(fails, ";").alias("fails")))
    return rows.select("parcel_id", F.inline(F.array(*each)))


def hub_distances(parcels: DataFrame) -> DataFrame:
    """Miles and drive minutes (by distance: 25, 38 or 50 miles an hour over 1.3 times the way) to the reference points."""
    columns = []
    for name, (lat, lng) in HUBS.items():
        road = haversine_miles(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng)) * 1.3
        columns += [road.alias(f"{name}_miles"), (road / F.when(road < 5, 25.0).when(road < 20, 38.0).otherwise(50.0) * 60).alias(f"{name}_minutes")]
    return parcels.select("parcel_id", *columns)


def assemblages(parcels: DataFrame, least_acres: float = 25.0, miles: float = 1.0, least_total: float = 200.0) -> DataFrame:
    """Clusters of large parcels within a mile of each other that two owners or more hold, with ``least_total`` acres together."""
    big = parcels.filter(F.col("acres") >= least_acres).select("parcel_id", "lat", "lng", "acres", "owner1")
    big = with_owner_keys(big).withColumnRenamed("canonical_owner_id", "owner")
    # Parcels at one place are linked with each other: the place stands for them, by its smallest id. Those without a place are linked with none, and one parcel is no cluster.
    places = settled(big.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy("lat", "lng").agg(F.min("parcel_id").alias("id")))
    left = places.select(F.col("id").alias("a"), "lat", "lng")
    right = places.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    links = radius_join(left, right, miles).filter("a < b").select("a", "b")
    labels = components(places.select("id"), links).join(places, "id").select("lat", "lng", "component")
    per = big.join(labels, ["lat", "lng"]).groupBy("component").agg(F.count("*").alias("n_parcels"), F.count_distinct("owner").alias("n_owners"), F.sum("acres").alias("total_acres"), F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng"))
    return per.filter((F.col("n_parcels") >= 2) & (F.col("n_owners") >= 2) & (F.col("total_acres") >= least_total))
