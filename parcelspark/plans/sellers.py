"""Who is likely to sell: additive signals of a parcel, its owner and its listings; mortgage rates by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.functions import text
from parcelspark.functions.columns import haversine_miles
from parcelspark.operators.relational import radius_join
from parcelspark.operators.stages import settled
from parcelspark.plans.owners import with_owner_keys

# Remarks of a sale under pressure, names of estates.
ESTATE_NAME = r"(?i)\b(ESTATE|HEIRS?|TRUSTEE|LIFE TENANT|DECEASED)\b"


def monthly_rates(weekly: DataFrame) -> DataFrame:
    """Mean rate of each month (day, rate -> m, rate)."""
    return weekly.groupBy((F.year("day") * 12 + F.month("day") - 1).alias("m")).agg(F.round(F.avg("rate"), 2).alias("rate"))


def rate_at(rows: DataFrame, day: str, rates: DataFrame, key: str, name: str, months: int = 3) -> DataFrame:
    """Rows with the rate of their month, or of the nearest within ``months`` (the earlier of two). Rates have a row a month; each month that occurs meets seven at most, once for all its rows."""
    m = F.year(day) * 12 + F.month(day) - 1
    order = F.array(*(F.lit(x) for i in range(months + 1) for x in ([0] if i == 0 else [-i, i])))
    tried = rows.select(m.alias("_m")).distinct().select("_m", F.posexplode(F.transform(order, lambda i: F.col("_m") + i)).alias("place", "m"))
    best = tried.join(rates, "m").groupBy("_m").agg(F.min_by("rate", "place").alias(name))
    return rows.withColumn("_m", m).join(best, "_m", "left").select(*rows.columns, name)


def _recency(days, window: int, floor: float = 0.25):
    return F.when((days >= 0) & (days < window), F.greatest(F.lit(floor), 1 - days / window)).otherwise(0.0)


def seller_scoring(parcels: DataFrame, listings: DataFrame, rates: DataFrame, delinquent: DataFrame, moved: DataFrame, as_of: str, least: float = 40.0) -> DataFrame:
    """Parcels off the market that score ``least``, or whose entity buys often: score and the names of the signals, those for before those against.

    Expirations count within the present ownership. ``delinquent`` (parcel_id, amount), ``moved`` (parcel_id): mail addresses that changed.
    """
    day = F.lit(as_of).cast("date")
    owner = F.col("owner1")
    keyed = with_owner_keys(parcels).withColumnsRenamed({"canonical_owner_id": "canon", "owner_type": "kind", "owner_class": "klass"})
    site, mail = text.address_key(F.col("site_address")), text.address_key(F.col("mail_address"))
    base = keyed.withColumns({"entity": F.coalesce(F.col("kind") == "entity", F.lit(False)), "tenure": F.datediff(day, "last_sale_date") / 365.25, "absent": (site != "") & (mail != "") & (site != mail), "estate": owner.rlike(ESTATE_NAME)})
    live = listings.filter("status IN ('Active', 'Pending')").select("parcel_id").distinct()
    base = base.join(live, "parcel_id", "left_anti")
    gone = listings.filter(F.col("status").isin("Expired/Cancelled", "Withdrawn") & (F.col("off_market_date") <= day)).select("parcel_id", "listing_id", "off_market_date", "list_price", "original_list_price", "lat", "lng", "remarks")
    own = gone.join(parcels.select("parcel_id", "last_sale_date"), "parcel_id").filter(F.col("last_sale_date").isNull() | (F.col("off_market_date") > F.col("last_sale_date")))
    cut = (F.col("original_list_price") - F.col("list_price")) / F.nullif("original_list_price", F.lit(0.0)) * 100
    history = own.groupBy("parcel_id").agg(F.count("*").alias("n_expired"), F.max("off_market_date").alias("last_off"), F.max_by(cut, F.struct("off_market_date", "listing_id")).alias("cut"), F.max_by("remarks", F.struct("off_market_date", "listing_id")).alias("said"))
    held = keyed.select("canon", "last_sale_date", "kind").filter("canon IS NOT NULL")
    owners = held.groupBy("canon").agg(F.count("*").alias("n_parcels"), F.count_if((F.col("kind") == "entity") & (F.col("last_sale_date") >= F.date_sub(day, 1826))).alias("bought"))
    forced = listings.filter((F.col("status") == "Closed") & (F.col("dom") >= 180) & (F.col("sold_price") < F.col("assessed")) & (F.col("close_date") >= F.date_sub(day, 365))).select("owner1", F.col("parcel_id").alias("sold_parcel"))
    forced = with_owner_keys(forced).withColumnRenamed("canonical_owner_id", "canon")
    alumni = forced.groupBy("canon").agg(F.count_distinct("sold_parcel").alias("forced"), F.min("sold_parcel").alias("one"))
    sold = listings.filter((F.col("status") == "Closed") & (F.col("close_date") >= F.add_months(day, -12))).groupBy("county", "subdivision").agg(F.count("*").alias("k"))
    ranked = sold.withColumn("i", F.row_number().over(Window.partitionBy("county").orderBy("k", "subdivision")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("county")))
    bar = ranked.filter("i = CAST(floor(n * 0.75) AS INT)").select("county", F.col("k").alias("bar"))
    hot = ranked.join(bar, "county").filter("k >= bar").select("county", "subdivision", F.lit(True).alias("hot"))
    anchors = gone.filter(F.col("off_market_date") >= F.date_sub(day, 30)).select(F.col("parcel_id").alias("anchor"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")).distinct()
    # Places meet places; a parcel that is itself an anchor there is told by its own key.
    places = settled(base.select("lat", "lng").filter("lat IS NOT NULL AND lng IS NOT NULL").distinct())
    about = radius_join(places, settled(anchors.select("lat2", "lng2").distinct()), 0.5).select("lat", "lng").distinct()
    itself = base.join(anchors, F.col("parcel_id") == F.col("anchor")).filter(haversine_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) <= 0.5).select("parcel_id")
    beside = base.select("parcel_id", "lat", "lng").join(about, ["lat", "lng"]).join(itself, "parcel_id", "left_anti").select("parcel_id", F.lit(True).alias("beside"))
    current = rates.agg(F.max_by("rate", "m").alias("current"))  # one row
    rows = rate_at(base, "last_sale_date", rates, "parcel_id", "bought_at").join(F.broadcast(current))
    for extra, on in ((history, "parcel_id"), (owners, "canon"), (alumni, "canon"), (hot, ["county", "subdivision"]), (beside, "parcel_id"), (delinquent.groupBy("parcel_id").agg(F.sum("amount").alias("owed")), "parcel_id"), (moved.select("parcel_id", F.lit(True).alias("moved")).distinct(), "parcel_id")):
        rows = rows.join(extra, on, "left")
    t, person = F.col("tenure"), ~F.col("entity")
    flipper = F.col("entity") & (F.col("bought") >= 3)
    equity = F.when((F.col("assessed") > 0) & (F.col("last_sale_price") > 0), F.col("assessed") - F.col("last_sale_price")).otherwise(0.0)
    curve = F.when(t < 2, 0.0).when(t <= 8, 25 * (t - 2) / 6).when(t <= 15, 25 * (1 - (t - 8) / 14)).when(t <= 25, F.greatest(F.lit(5.0), 25 * (1 - (t - 8) / 14))).otherwise(5.0)
    lock = F.round(F.col("current") - F.col("bought_at"), 2)
    penalty = F.least(F.lit(20.0), (lock - 1) * 10)
    off = F.datediff(day, "last_off")
    recent = F.col("last_sale_date") >= F.date_sub(day, 730)
    family = recent & (F.col("last_sale_price") <= 1000)
    absent = F.col("absent")
    flag = lambda cond, points: F.when(cond, points).otherwise(0.0)
    good = {
        "tenure": F.when(t.isNotNull(), curve).otherwise(0.0), "equity": F.when(equity > 0, F.least(F.lit(15.0), equity / 200_000 * 15)).otherwise(0.0), "estate_pattern": flag(F.col("estate"), 30.0), "absentee": flag(absent, 10.0),
        "oos_mail": flag(absent & (F.col("mail_state") != "VA"), 5.0), "expired": 20 * _recency(off, 540), "investor_dispose": flag(F.col("entity") & t.between(3, 7), 15.0), "hot_subdivision": flag(F.col("hot"), 10.0),
        "vintage_estate": flag((F.col("year_built") < 1960) & (F.col("assessed") >= 300_000), 5.0), "multi_prop": flag((F.col("n_parcels") >= 5) & ~flipper & (F.col("klass") != "govt_or_institution"), 5.0),
        "intra_family": F.when(family & (t < 2), 25.0).when(family, 10.0).otherwise(0.0), "mail_changed": flag(F.col("moved"), 30.0), "tax_delinquent": F.when(F.col("owed").isNotNull(), 10 + F.least(F.lit(20.0), F.col("owed") / 250)).otherwise(0.0),
        "price_cut": flag(F.col("cut") >= 15, 25 * _recency(off, 365)), "serial_relister": flag(F.col("n_expired") >= 3, 25.0), "empty_nester": flag((F.col("bedrooms") >= 4) & (t >= 15) & (F.col("year_built") < 1975) & person, 15.0),
        "forced_sale_alumni": flag(person & ((F.col("forced") > 1) | (F.col("one") != F.col("parcel_id"))), 15.0), "distressed": flag(person & F.col("said").rlike(text.DISTRESSED), 15.0), "neighbor_of_expired": flag(person & F.col("beside"), 10.0),
    }
    good = {k: F.coalesce(v, F.lit(0.0)) for k, v in good.items()}
    bad = {"recent_purchase": flag(t < 1.5, -25.0), "rate_locked": F.coalesce(flag((lock >= 1) & (penalty >= 5), -penalty), F.lit(0.0))}
    # Each signal is worked out once a row: the points are written, then added up and named.
    rows = settled(rows.select("parcel_id", "county", F.array(*good.values(), *bad.values()).alias("points"), F.coalesce(flipper, F.lit(False)).alias("is_flipper")))
    total = F.round(F.aggregate("points", F.lit(0.0), lambda a, x: a + x), 6)
    names = F.array_join(F.array_compact(F.array(*(F.when(F.get("points", F.lit(i)) != 0, F.lit(k)) for i, k in enumerate({**good, **bad})))), ";")
    return rows.select("parcel_id", "county", total.alias("score"), "is_flipper", names.alias("signals")).filter((F.col("score") >= least) | F.col("is_flipper"))
