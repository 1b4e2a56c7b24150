"""Feeds written and read back: every reader and writer over the bridge's rows, with the SQL of what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelspark.operators.stages import scratch
from parcelspark.sources import readers, writers
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, PARCELS_SQL, listings, parcels

SHORT = StructType([f for f in readers.LISTING if f.name in ("listing_id", "city", "list_price", "bedrooms", "list_date", "close_date")])


def _feed(spark, d):
    """Listings as a feed gives them: everything as text, prices missing or no numbers for some."""
    rows = listings(spark, d)
    price = F.when(F.col("listing_id") % 10 == 0, "n/a").when(F.col("listing_id") % 10 != 1, F.col("list_price").cast("string"))
    return rows.select(F.col("listing_id").cast("string").alias("listing_id"), "city", price.alias("list_price"), (F.col("bedrooms") + 0.2).cast("string").alias("bedrooms"), *(F.col(c).cast("string").alias(c) for c in ("list_date", "close_date")), F.lit("x").alias("unknown"))


def _jsonl(spark, d):
    path = scratch(spark, "jsonl")
    rows = _feed(spark, d)
    writers.append_jsonl(rows.filter("CAST(listing_id AS long) % 2 = 0").drop("unknown"), path)
    writers.append_jsonl(rows.filter("CAST(listing_id AS long) % 2 = 1"), path)  # other columns, appended
    return readers.read_jsonl(spark, path, SHORT)


def _strict(spark, d):
    path = scratch(spark, "lines")
    row = F.to_json(F.struct("listing_id", "city", "bedrooms"))
    listings(spark, d).select(F.when(F.col("listing_id") % 7 == 0, F.substring(row, 1, 9)).otherwise(row).alias("value")).write.text(path)
    return readers.read_jsonl_strict(spark, path, StructType.fromDDL("listing_id long, city string, bedrooms int"))


def _csv(spark, d):
    path = scratch(spark, "csv")
    writers.write_csv(_feed(spark, d), path)
    return readers.read_csv(spark, path, SHORT)


def _dates(spark, d):
    day = F.col("last_sale_date")
    layouts = [F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T04:00:00Z")), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "MMddyyyy"), F.upper(F.date_format(day, "dd-MMM-yy")), F.date_format(day, "dd-MMM-yyyy"), F.unix_millis(day.cast("timestamp")).cast("string")]
    written = F.element_at(F.array(*layouts), (F.col("parcel_id") % 7 + 1).cast("int"))
    return parcels(spark, d).select("parcel_id", readers.sale_date(written, AS_OF).alias("sale_date"))


def _rolls(spark, d):
    """Tax rolls: pages of a hundred lines at most, a line for every ninth parcel."""
    line = F.concat(F.lit("  "), F.lpad(F.col("parcel_id").cast("string"), 6, "0"), F.lit("    "), F.col("owner1"), F.lit("   $"), F.format_number((F.col("parcel_id") * 37 % 9000).cast("double"), 2))
    page = parcels(spark, d).filter("parcel_id % 9 = 0").groupBy("county", F.floor(F.col("parcel_id") / 900).alias("page")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    pages = page.select(F.col("county").alias("source"), "page", F.concat(F.lit("TAX ROLL\n"), "text").alias("text"))
    return readers.delinquencies(pages, "X").select("source", "parcel_id_raw", "delinquent_amount")


def _supplemental(spark, d):
    raw = listings(spark, d).filter("status = 'Closed'").select(F.col("listing_id").cast("string").alias("listing_id"), F.when(F.col("listing_id") % 3 == 0, "Vacant LAND").when(F.col("listing_id") % 3 == 1, "Farm").otherwise("Home").alias("property_type"), F.col("sqft").cast("string").alias("sqft"), (F.col("acres") * 43_560).cast("string").alias("lot_sqft"), "sold_price")
    return readers.supplemental_pool(raw, {"land": "LD_3", "farm": "FM_5"}, 0.76).select("listing_id", "class_id", "status", "sqft", "acres", "sold_price", "list_price")


def _scraped(spark, d):
    return readers.scraped_pool(listings(spark, d).filter("status = 'Closed'").select("listing_id", "city", "sold_price")).select("listing_id", "city", "status", "sold_price", "list_price", "original_list_price", "sqft")


def _slim(spark, d):
    i = F.col("listing_id")
    words = lambda *w: F.element_at(F.array(*map(F.lit, w)), (i % len(w) + 1).cast("int"))
    extras = F.create_map(F.lit("garage"), words("Two car", "3-car attached", "None", "one", "carport"), F.lit("basement"), words("Full", "Crawl space", "None", "walk-out"))
    return readers.slim_listings(listings(spark, d).withColumn("extras", F.when(i % 11 > 0, extras))).select("listing_id", "city", "list_price", "garage_bays", "has_basement")


def _union(spark, d):
    rows = parcels(spark, d).select(F.col("parcel_id").cast("string").alias("parcel_id"), "county", "assessed")
    own = [rows.filter(f"county = '{c}' AND parcel_id % 2 = 0") for c in ("REGION_0", "REGION_1")]
    return readers.parcel_union(own, rows.withColumn("county", F.concat(F.lit(" "), F.lower("county"))), rows.schema)


def _index(spark, d):
    rows = listings(spark, d).withColumn("address", F.concat(F.col("parcel_id").cast("string"), F.lit(" Oak")))
    return readers.search_index(rows, parcels(spark, d))


def _replaced(spark, d):
    path = scratch(spark, "pool")
    for some in ("parcel_id % 2 = 0", "parcel_id % 3 = 0"):
        writers.replace_parquet(parcels(spark, d).filter(some).select("parcel_id", "assessed"), path)
    return spark.read.parquet(path)


def _upserted(spark, d):
    rows = listings(spark, d).select("listing_id", "original_list_price", "list_price")
    old = rows.filter("listing_id % 3 > 0").withColumn("original_list_price", F.when(F.col("listing_id") % 5 > 0, F.col("original_list_price")))
    new = rows.filter("listing_id % 2 = 0").select("listing_id", (F.col("original_list_price") + 1).alias("original_list_price"), (F.col("list_price") - 1).alias("list_price"))
    return writers.upsert(old, new, "listing_id", ["original_list_price"])


def _inserted(spark, d):
    rows = parcels(spark, d).select(F.when(F.col("parcel_id") % 4 > 0, F.col("city")).alias("city"), (F.col("parcel_id") % 50).alias("kind"))
    old = rows.filter("kind < 20").groupBy("city", "kind").agg(F.lit(1).alias("seen"))
    return writers.insert_absent(old, rows.filter("kind < 40").withColumn("seen", F.lit(2)), ["city", "kind"])


def _points(spark, d):
    layer = writers.geojson(parcels(spark, d).withColumn("lat", F.when(F.col("parcel_id") % 6 > 0, F.col("lat"))), "lat", "lng", ["parcel_id", "assessed"])
    got = F.from_json("feature", "geometry struct<coordinates array<double>>, properties struct<parcel_id long, assessed double>")
    return layer.select(got.alias("f")).select("f.properties.parcel_id", "f.properties.assessed", F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def _months(spark, d):
    path = scratch(spark, "months")
    rows = parcels(spark, d).select("parcel_id", "assessed")
    for month, some in (("2001-06", "parcel_id % 2 = 0"), ("2001-07", "parcel_id % 3 = 0"), ("2001-06", "parcel_id % 5 = 0")):
        writers.write_month(rows.filter(some), path, month)
    return spark.read.schema("parcel_id long, assessed double, snapshot_month string").parquet(path)


QUERIES = {
    "feed_jsonl": _jsonl, "feed_jsonl_strict": _strict, "feed_csv": _csv, "feed_sale_dates": _dates, "feed_tax_rolls": _rolls, "feed_supplemental": _supplemental, "feed_scraped": _scraped, "feed_slim": _slim, "feed_parcel_union": _union, "feed_search_index": _index,
    "feed_history": lambda spark, d: readers.history_backfill(listings(spark, d)), "pool_replaced": _replaced, "pool_upserted": _upserted, "pool_inserted": _inserted, "layer_geojson": _points, "pool_months": _months,
}

_READ = f"{BRIDGE_SQL} SELECT CAST(listing_id AS VARCHAR) AS listing_id, city, CASE WHEN listing_id % 10 > 1 THEN list_price END AS list_price, bedrooms, list_date, close_date FROM listings"
ORACLE = {
    "feed_jsonl": _READ,
    "feed_csv": _READ,
    "feed_jsonl_strict": f"{BRIDGE_SQL} SELECT listing_id, city, bedrooms FROM listings WHERE listing_id % 7 > 0",
    "feed_sale_dates": f"WITH {PARCELS_SQL} SELECT parcel_id, last_sale_date AS sale_date FROM parcels",
    "feed_tax_rolls": f"WITH {PARCELS_SQL} SELECT county AS source, lpad(CAST(parcel_id AS VARCHAR), 6, '0') AS parcel_id_raw, CAST(parcel_id * 37 % 9000 AS DOUBLE) AS delinquent_amount FROM parcels WHERE parcel_id % 9 = 0 AND parcel_id * 37 % 9000 >= 50",
    "feed_supplemental": f"{BRIDGE_SQL} SELECT CAST(listing_id AS VARCHAR) AS listing_id, CASE listing_id % 3 WHEN 0 THEN 'LD_3' WHEN 1 THEN 'FM_5' ELSE 'RE_1' END AS class_id, 'Closed' AS status, sqft * 0.76::DOUBLE AS sqft, acres * 43560 / 43560.0::DOUBLE AS acres, sold_price, NULL::DOUBLE AS list_price FROM listings WHERE status = 'Closed'",
    "feed_scraped": f"{BRIDGE_SQL} SELECT CAST(listing_id AS VARCHAR) AS listing_id, city, 'Closed' AS status, sold_price, sold_price AS list_price, sold_price AS original_list_price, NULL::DOUBLE AS sqft FROM listings WHERE status = 'Closed'",
    "feed_slim": f"{BRIDGE_SQL} SELECT CAST(listing_id AS VARCHAR) AS listing_id, city, list_price, CASE WHEN listing_id % 11 > 0 THEN CASE listing_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 1 END END AS garage_bays, CASE WHEN listing_id % 11 > 0 THEN listing_id % 4 IN (0, 3) END AS has_basement FROM listings",
    "feed_parcel_union": f"WITH {PARCELS_SQL}, r AS (SELECT CAST(parcel_id AS VARCHAR) AS parcel_id, county, assessed, parcel_id % 2 = 0 AS even FROM parcels) SELECT parcel_id, county, assessed FROM r WHERE county IN ('REGION_0', 'REGION_1') AND even UNION ALL SELECT parcel_id, ' ' || lower(county), assessed FROM r WHERE county NOT IN (SELECT county FROM r WHERE county IN ('REGION_0', 'REGION_1') AND even)",
    "feed_search_index": f"{BRIDGE_SQL}, {PARCELS_SQL} SELECT 'mls' AS source, CAST(listing_id AS VARCHAR) AS id, CAST(parcel_id AS VARCHAR) AS parcel, CASE status WHEN 'Active' THEN 0 WHEN 'Pending' THEN 1 WHEN 'Closed' THEN 2 ELSE 3 END AS rank0, upper(concat_ws(' ', parcel_id || ' Oak', city, subdivision)) AS text FROM listings UNION ALL SELECT 'parcel', CAST(parcel_id AS VARCHAR), CAST(parcel_id AS VARCHAR), 9, upper(concat_ws(' ', site_address, city, owner1)) FROM parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM listings)",
    "feed_history": f"{BRIDGE_SQL} SELECT listing_id, class_id, city, 'new' AS kind, list_date AS observed_at, original_list_price AS price FROM listings UNION ALL SELECT listing_id, class_id, city, 'price_change', list_date, list_price FROM listings WHERE list_price <> original_list_price UNION ALL SELECT listing_id, class_id, city, 'sold_price_set', close_date, sold_price FROM listings WHERE sold_price > 0 AND close_date IS NOT NULL",
    "pool_replaced": f"WITH {PARCELS_SQL} SELECT parcel_id, assessed FROM parcels WHERE parcel_id % 3 = 0",
    "pool_upserted": f"{BRIDGE_SQL} SELECT listing_id, CASE WHEN listing_id % 3 > 0 AND listing_id % 5 > 0 THEN original_list_price WHEN listing_id % 2 = 0 THEN original_list_price + 1 END AS original_list_price, CASE WHEN listing_id % 2 = 0 THEN list_price - 1 ELSE list_price END AS list_price FROM listings WHERE listing_id % 3 > 0 OR listing_id % 2 = 0",
    "pool_inserted": f"WITH {PARCELS_SQL}, r AS (SELECT DISTINCT CASE WHEN parcel_id % 4 > 0 THEN city END AS city, parcel_id % 50 AS kind FROM parcels) SELECT city, kind, CASE WHEN kind < 20 THEN 1 ELSE 2 END AS seen FROM r WHERE kind < 40",
    "layer_geojson": f"WITH {PARCELS_SQL} SELECT parcel_id, assessed, round(lng, 6) AS lng, round(lat, 6) AS lat FROM parcels WHERE parcel_id % 6 > 0",
    "pool_months": f"WITH {PARCELS_SQL} SELECT parcel_id, assessed, '2001-06' AS snapshot_month FROM parcels WHERE parcel_id % 5 = 0 UNION ALL SELECT parcel_id, assessed, '2001-07' FROM parcels WHERE parcel_id % 3 = 0",
}
