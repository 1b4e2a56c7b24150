"""Products over sale and deed histories: off-market sales, trends, chains, lost listings, saved searches, outreach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.operators.relational import first_per, match_all, radius_join

GONE = ["Expired/Cancelled", "Withdrawn"]


def expired_then_sold(listings: DataFrame, deeds: DataFrame, least_price: float = 5000.0) -> DataFrame:
    """Listings that did not sell on the market, with the parcel's last deed where that is no older than their end."""
    last = deeds.filter(F.col("deed_price") > least_price).groupBy("parcel_id").agg(F.max_by(F.struct("deed_date", "deed_price"), F.struct("deed_date", "deed_id")).alias("d")).select("parcel_id", "d.*")
    gone = listings.filter(F.col("status").isin(*GONE)).withColumn("off_date", F.date_add("list_date", F.col("dom")))
    rows = gone.join(last, "parcel_id").filter("deed_date >= coalesce(off_date, list_date)")
    days = lambda c: F.datediff("deed_date", c).cast("long")
    return rows.select(
        "listing_id", "class_id", "status", "city", "list_date", "off_date", "deed_date", "deed_price",
        F.round(F.col("deed_price") / F.nullif("original_list_price", F.lit(0.0)), 4).alias("deed_to_original"), days("off_date").alias("days_off_to_deed"), days("list_date").alias("days_listed_to_deed"),
    )


def price_trends(listings: DataFrame, deeds: DataFrame, least: int = 3, least_price: float = 5000.0) -> DataFrame:
    """Quantiles of market sales and of the arm's-length deeds whose parcel and year no market sale covers."""
    done = listings.filter("status = 'Closed' AND sold_price > 0 AND close_date IS NOT NULL")
    market = done.select(F.year("close_date").alias("year"), "parcel_id", "city", "class_id", F.lit("mls").alias("source"), F.col("sold_price").alias("price"))
    deed = deeds.filter(F.col("arms_length") & (F.col("deed_price") > least_price)).select(F.year("deed_date").alias("year"), "parcel_id", F.col("county").alias("city"), F.lit("DEED").alias("class_id"), F.lit("deed").alias("source"), F.col("deed_price").alias("price"))
    rows = market.unionByName(deed.join(market.select("parcel_id", "year"), ["parcel_id", "year"], "left_anti"))
    q = lambda p, name: F.round(F.percentile("price", p), 0).alias(name)
    return rows.groupBy("year", "city", "class_id", "source").agg(F.count("*").alias("n"), q(0.5, "median_sold"), q(0.25, "p25_sold"), q(0.75, "p75_sold")).filter(F.col("n") >= least)


def sale_history(listings: DataFrame) -> DataFrame:
    """Each parcel's distinct sales (whole price, date), newest first."""
    rows = listings.filter("status = 'Closed' AND sold_price > 0").select("parcel_id", F.col("sold_price").cast("long").alias("price"), F.col("close_date").alias("sale_date")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parcel_id").orderBy(F.col("sale_date").desc_nulls_last(), F.desc("price"))))


def expired_unrelisted(listings: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Parcels whose listing expired within ``days`` and that neither are on the market nor were listed again. One pass, one shuffle."""
    day = F.lit(as_of).cast("date")
    rows = listings.withColumn("off_date", F.date_add("list_date", F.col("dom")))
    lost = (F.col("status") == "Expired/Cancelled") & (F.col("off_date") <= day) & (F.col("off_date") > F.date_sub(day, days))
    last = F.max_by(F.struct("listing_id", "off_date", "list_price", "original_list_price"), F.when(lost, F.struct("off_date", "listing_id"))).alias("x")
    per = rows.groupBy("parcel_id").agg(last, F.count_if(F.col("status").isin("Active", "Pending")).alias("live"), F.max("list_date").alias("newest"), F.count_if(lost).alias("n_expired"))
    return per.filter("n_expired > 0 AND live = 0 AND newest <= x.off_date").select("parcel_id", "x.*", "n_expired")


def on_market(day: Column) -> Column:
    return (F.col("list_date") <= day) & (F.date_add("list_date", F.col("dom")) > day)


def saved_search_diff(listings: DataFrame, as_of: str, days: int = 30, class_id: str | None = None, city: str | None = None, least_price: float | None = None, most_price: float | None = None, least_beds: int | None = None) -> DataFrame:
    """What a saved search finds on ``as_of`` and did not find ``days`` before (NEW), or the reverse (DROPPED). One scan."""
    given = lambda x, cond: None if x is None else cond
    price = F.col("list_price")
    found = match_all(listings, [given(class_id, F.col("class_id") == class_id), given(city, F.col("city") == city), given(least_price, price >= least_price), given(most_price, price <= most_price), given(least_beds, F.col("bedrooms") >= least_beds)])
    day = F.lit(as_of).cast("date")
    now, old = on_market(day), on_market(F.date_sub(day, days))
    change = F.when(now & ~old, "NEW").when(old & ~now, "DROPPED")
    return found.select("listing_id", "parcel_id", "city", "list_price", change.alias("change")).filter("change IS NOT NULL")


def neighbour_outreach(listings: DataFrame, scores: DataFrame, as_of: str, days: int = 14, keep: int = 5, least: int = 30, miles: float = 0.5) -> DataFrame:
    """For each recent sale the best-scored parcels of its subdivision; where that is unknown, those within ``miles``.

    Of a subdivision only the best keep + 1 parcels can be chosen (the sold one may be among them), so that many are joined.
    """
    day = F.lit(as_of).cast("date")
    sales = listings.filter((F.col("status") == "Closed") & (F.col("sold_price") > 0) & (F.col("close_date") >= F.date_sub(day, days)) & (F.col("close_date") <= day)).select("listing_id", "parcel_id", "subdivision", "close_date", "sold_price", F.col("lat"), F.col("lng"))
    live = listings.filter("status IN ('Active', 'Pending')").select("parcel_id").distinct()
    latest = first_per(listings, ["parcel_id"], [F.col("list_date").desc_nulls_last(), F.desc("listing_id")])
    pool = latest.join(scores.select("parcel_id", "score").filter(F.col("score") >= least), "parcel_id").join(live, "parcel_id", "left_anti")
    pool = pool.select(F.col("parcel_id").alias("neighbour"), "subdivision", "score", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    best = first_per(pool.filter("subdivision IS NOT NULL"), ["subdivision"], [F.desc("score"), F.asc("neighbour")], keep + 1)
    same = sales.join(best, "subdivision").select("listing_id", "parcel_id", "close_date", "sold_price", "neighbour", "score", F.lit(0.0).alias("miles"))
    near = radius_join(sales.filter("subdivision IS NULL").drop("subdivision"), pool.drop("subdivision"), miles).select("listing_id", "parcel_id", "close_date", "sold_price", "neighbour", "score", "miles")
    rows = same.unionByName(near).filter("neighbour <> parcel_id")
    return first_per(rows, ["listing_id"], [F.desc("score"), F.asc("miles"), F.asc("neighbour")], keep, "place").drop("parcel_id")
