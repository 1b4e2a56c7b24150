"""Expired listings that are not on the market again, found by parcel or by address however it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.text import mail_key


def place_key(address: Column, city: Column, zip_code: Column) -> Column:
    """The address as a mailbox key with town and postal code; null where no address is known."""
    line = F.concat_ws(" ", F.trim(address), F.trim(city), F.trim(zip_code))
    key = mail_key(line)
    return F.when(F.length(F.trim(F.coalesce(address, F.lit("")))) > 0, key)


def unrelisted(listings: DataFrame, as_of: str, days: int = 28) -> DataFrame:
    """listing_id, parcel_id, place, expired_at, list_date, list_price of listings that expired within ``days`` and were not listed again.

    Listed again: a listing of the same parcel or the same place is active or pending now, or was listed after the expiry, whatever became of it. Parcels that are unknown and
    places that are unknown match nothing. Of several expiries of a place (of a parcel where the place is unknown) the latest stays, ties to the larger listing_id. ``listings`` has address, zip and expired_at.

    What is known of a key is summed up before it is shuffled, so a key with many listings stays one row; each key type is joined once.
    """
    day = F.lit(as_of).cast("date")
    rows = listings.withColumn("place", place_key(F.col("address"), F.col("city"), F.col("zip")))
    marketed = F.max(F.when(F.col("status").isin("Active", "Pending"), True)).alias("live")
    seen = {k: rows.filter(F.col(k).isNotNull()).groupBy(k).agg(marketed, F.max("list_date").alias("newest")).withColumnsRenamed({"live": f"{k}_live", "newest": f"{k}_newest"}) for k in ("parcel_id", "place")}
    lost = rows.filter((F.col("status") == "Expired/Cancelled") & (F.col("expired_at") >= F.date_sub(day, days)) & (F.col("expired_at") <= day))
    known = lost.join(seen["parcel_id"], "parcel_id", "left").join(seen["place"], "place", "left")
    again = lambda k: F.coalesce(F.col(f"{k}_live"), F.lit(False)) | F.coalesce(F.col(f"{k}_newest") > F.col("expired_at"), F.lit(False))
    left = known.filter(~again("parcel_id") & ~again("place"))
    fields = ["listing_id", "parcel_id", "place", "expired_at", "list_date", "list_price"]
    one = F.coalesce("place", F.concat(F.lit("parcel "), F.col("parcel_id").cast("string")), F.concat(F.lit("listing "), F.col("listing_id").cast("string")))
    return left.groupBy(one.alias("_one")).agg(F.max_by(F.struct(*fields), F.struct("expired_at", "listing_id")).alias("x")).select("x.*")
