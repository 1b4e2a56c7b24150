"""Regional knobs, relisted places and walking routes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.plans import regions, relists, routes
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, PARCELS_SQL, listings, parcels

# Regions with entries, from the nations' keys k; all five levels occur. Written for both dialects.
ENTRIES = """SELECT concat('51', lpad(CAST(k AS STRING), 3, '0')) AS region, 'sqft_factor' AS name, 0.5D + k / 100.0D AS value FROM nk WHERE k % 2 = 0
UNION ALL SELECT concat('51', lpad(CAST(k AS STRING), 3, '0')), 'dist_scale', 3.0D + k FROM nk WHERE k % 2 = 0
UNION ALL SELECT concat('county:va:ab', translate(CAST(k AS STRING), '0123456789', 'abcdefghij')), 'land_rate_lo', 1000.0D * (k + 1) FROM nk WHERE k % 3 = 0
UNION ALL SELECT concat('cbsa:', CAST(10000 + k AS STRING)), 'land_rate_hi', 7000.0D + k FROM nk WHERE k % 4 = 1
UNION ALL SELECT concat('cbsa:', CAST(10000 + k AS STRING)), '_fitted', CAST(NULL AS DOUBLE) FROM nk WHERE k % 4 = 1
UNION ALL SELECT 'state:VA', 'dist_scale', 9.0D + k * 0 FROM nk WHERE k = 0 UNION ALL SELECT 'state:NC', '_fitted', 1.0D + k * 0 FROM nk WHERE k = 0
UNION ALL SELECT 'global', 'sqft_factor', 1.0D + k * 0 FROM nk WHERE k = 0 UNION ALL SELECT 'global', 'floor', 2.5D + k * 0 FROM nk WHERE k = 0"""
SUBJECTS = """SELECT parcel_id, CASE WHEN parcel_id % 5 = 0 THEN concat('51', lpad(CAST(parcel_id % 30 AS STRING), 3, '0')) WHEN parcel_id % 5 = 1 THEN '51x' END AS fips5,
CASE WHEN parcel_id % 7 > 0 THEN concat('Ab', translate(CAST(parcel_id % 40 AS STRING), '0123456789', 'abcdefghij'), ' County') END AS county, CASE WHEN parcel_id % 3 = 0 THEN 10000 + parcel_id % 30 END AS cbsa,
CASE WHEN parcel_id % 13 = 0 THEN 'MD' WHEN parcel_id % 2 = 0 THEN mail_state END AS state FROM parcels"""


def _knobs(spark, d):
    nk = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    subjects = spark.sql(SUBJECTS.replace("FROM parcels", "FROM {parcels}"), parcels=parcels(spark, d))
    out = regions.knobs(subjects, spark.sql(ENTRIES.replace("FROM nk", "FROM {nk}"), nk=nk), "parcel_id")
    return out.select("parcel_id", "level", *(F.col("knobs")[k].alias(k) for k in (*regions.DEFAULTS, "floor")))


# Addresses as agents write them: suffixes and case vary by listing, some listings carry no parcel.
WRITTEN = """CASE listing_id % 3 WHEN 0 THEN upper(replace(replace(replace(replace(site_address, 'Street', 'St'), 'AVENUE', 'ave.'), 'Rd.', 'Road'), 'Lane', 'Ln')) WHEN 1 THEN replace(site_address, ' ', '  ') ELSE concat(site_address, ',') END"""


def _unrelisted(spark, d):
    rows = listings(spark, d).join(parcels(spark, d).select("parcel_id", "site_address"), "parcel_id")
    rows = rows.withColumns({"address": F.when(F.col("listing_id") % 17 > 0, F.expr(WRITTEN)), "zip": F.lpad((F.col("parcel_id") % 900 + 24000).cast("string"), 5, "0"), "expired_at": F.col("off_market_date")})
    return relists.unrelisted(rows.withColumn("parcel_id", F.when(F.col("listing_id") % 4 > 0, F.col("parcel_id"))), AS_OF, 2500)


def _routes(spark, d):
    stops = parcels(spark, d).select("county", "parcel_id", F.when(F.col("parcel_id") % 50 > 0, F.col("lat")).alias("lat"), "lng", F.col("assessed").alias("score"))
    return routes.walking_order(stops, "county", "parcel_id", 200)


QUERIES = {"regional_knobs": _knobs, "unrelisted_places": _unrelisted, "walking_routes": _routes}


def _duck(text: str) -> str:
    """The shared text in DuckDB's spelling of types and doubles."""
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", text.replace("AS STRING", "AS VARCHAR"))


_LEVEL = "CASE best WHEN 0 THEN 'fips' WHEN 1 THEN 'county' WHEN 2 THEN 'cbsa' WHEN 3 THEN 'state' ELSE 'global' END"
_OWN = lambda name, usual: f"coalesce(max(value) FILTER (e.region = b.region AND name = '{name}'), max(value) FILTER (e.region = 'global' AND name = '{name}'), {usual}) AS {name}"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(' ', upper(regexp_replace(concat_ws(' ', trim(address), trim(city), trim(zip)), '[.,#]', ' ', 'g')), ' '), '\\s+', ' ', 'g'), ' STREET ', ' ST '), ' AVENUE ', ' AVE '), ' ROAD ', ' RD '), ' LANE ', ' LN '))"
ORACLE = {
    "regional_knobs": f"""WITH {PARCELS_SQL}, nk AS (SELECT n_nationkey AS k FROM nation), e AS ({_duck(ENTRIES)}), s AS ({_duck(SUBJECTS)}), t AS (SELECT *, upper(coalesce(state, 'VA')) AS st FROM s),
c AS (SELECT parcel_id, 0 AS place, fips5 AS region FROM t WHERE regexp_full_match(fips5, '\\d{{5}}') UNION ALL SELECT parcel_id, 1, concat('county:', lower(st), ':', trim(replace(lower(county), ' county', ''))) FROM t WHERE county IS NOT NULL
  UNION ALL SELECT parcel_id, 2, concat('cbsa:', cbsa) FROM t WHERE cbsa IS NOT NULL UNION ALL SELECT parcel_id, 3, concat('state:', st) FROM t),
b AS (SELECT parcel_id, min(place) AS best, arg_min(region, place) AS region FROM c WHERE region IN (SELECT region FROM e) GROUP BY 1), w AS (SELECT p.parcel_id, best, region FROM parcels p LEFT JOIN b USING (parcel_id))
SELECT parcel_id, {_LEVEL} AS level, {", ".join(_OWN(k, f"{v}::DOUBLE") for k, v in regions.DEFAULTS.items())}, {_OWN("floor", "NULL")} FROM w b JOIN e ON e.region IN ('global', coalesce(b.region, 'global')) GROUP BY parcel_id, best""",
    "unrelisted_places": f"""{BRIDGE_SQL}, {PARCELS_SQL}, r AS (SELECT listing_id, CASE WHEN listing_id % 4 > 0 THEN l.parcel_id END AS parcel_id, CASE WHEN listing_id % 17 > 0 THEN {WRITTEN} END AS address, l.city, lpad(CAST(l.parcel_id % 900 + 24000 AS VARCHAR), 5, '0') AS zip, status, off_market_date AS expired_at, list_date, list_price FROM listings l JOIN parcels USING (parcel_id)),
k AS (SELECT *, CASE WHEN address IS NOT NULL THEN {_KEY} END AS place FROM r), x AS (SELECT * FROM k WHERE status = 'Expired/Cancelled' AND expired_at BETWEEN DATE '{AS_OF}' - 2500 AND DATE '{AS_OF}'),
y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE (k.parcel_id = x.parcel_id OR k.place = x.place) AND (k.status IN ('Active', 'Pending') OR k.list_date > x.expired_at)))
SELECT listing_id, parcel_id, place, expired_at, list_date, list_price FROM y QUALIFY row_number() OVER (PARTITION BY coalesce(place, 'parcel ' || parcel_id, 'listing ' || listing_id) ORDER BY expired_at DESC, listing_id DESC) = 1""",
}
