"""Searches by criteria, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.plans import criteria
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, listings

WATCHED = {
    "cities": ["nation_1", " Nation_2", "NATION_3", "NATION_15", "NATION_16"], "classes": ["RE_1", "MF_2", "LD_3"], "statuses": ["Active", "Pending"], "min_price": 20_000, "max_price": 400_000, "min_beds": 2, "max_beds": 4, "min_full_baths": 2,
    "min_sqft": 900, "max_sqft": 3_800, "min_acres": 1.5, "max_acres": 38, "zoning_like": "r-", "subdivision_like": "sub 1", "school_districts": ["HS 1", "HS 2", "HS 3", "HS 5"], "center_lat": 37.5, "center_lng": -80.5, "radius_mi": 30, "listed_within_days": 2000,
}
ASKED = {"city": "nation_16", "min_beds": 2, "min_price": 20_000, "max_price": 450_000, "max_acres": 39, "keywords": ["home", "NEW"]}


def _rows(spark, d):
    """Listings with zoning and high school from the parcel's number, missing for some."""
    p = F.col("parcel_id")
    return listings(spark, d).withColumns({"zoning": F.when(p % 4 > 0, F.concat(F.lit("R-"), (p % 4).cast("string"))).when(p % 8 == 0, "B1"), "high_school": F.when(p % 11 > 0, F.concat(F.lit("HS "), (p % 11).cast("string"))), "address": F.when(p % 13 > 0, F.concat(p.cast("string"), F.lit(" OAK"))), "public_remarks": F.col("remarks"), "agent_remarks": F.lit(None).cast("string")})


QUERIES = {
    "watch_list": lambda spark, d: criteria.watch_list(_rows(spark, d), AS_OF, **{**WATCHED, "max_beds": None, "school_districts": None, "cities": None}).select("listing_id", "city", "status", "list_price", "miles_to_center"),
    "criteria_met": lambda spark, d: criteria.criteria_met(_rows(spark, d), AS_OF, "listing_id", **WATCHED),
    "structured_search": lambda spark, d: criteria.structured_search(_rows(spark, d), ASKED, AS_OF).select("listing_id", "city", "status", "list_price", "sold_price", "bedrooms"),
}

_R = f"""{BRIDGE_SQL}, r AS (SELECT *, CASE WHEN parcel_id % 4 > 0 THEN 'R-' || (parcel_id % 4) WHEN parcel_id % 8 = 0 THEN 'B1' END AS zoning, CASE WHEN parcel_id % 11 > 0 THEN 'HS ' || (parcel_id % 11) END AS high_school, CASE WHEN parcel_id % 13 > 0 THEN parcel_id || ' OAK' END AS address,
  round(sqrt(pow((lat - 37.5::DOUBLE) * 69, 2) + pow((lng + 80.5::DOUBLE) * 55.2::DOUBLE, 2)), 2) AS miles FROM listings)"""
_IN = lambda column, values: f"upper(trim({column})) IN ({', '.join(repr(v.strip().upper()) for v in values)})"
_EACH = {
    "cities": _IN("city", WATCHED["cities"]), "classes": _IN("class_id", WATCHED["classes"]), "statuses": _IN("status", WATCHED["statuses"]), "school_districts": _IN("high_school", WATCHED["school_districts"]), "min_price": "list_price >= 20000", "max_price": "list_price <= 400000",
    "min_beds": "bedrooms >= 2", "max_beds": "bedrooms <= 4", "min_full_baths": "full_baths >= 2", "min_sqft": "sqft >= 900", "max_sqft": "sqft <= 3800", "min_acres": "acres >= 1.5", "max_acres": "acres <= 38", "zoning_like": "upper(zoning) LIKE '%R-%'", "subdivision_like": "upper(subdivision) LIKE '%SUB 1%'",
    "listed_within_days": f"list_date >= DATE '{AS_OF}' - 2000", "radius": "abs(lat - 37.5) <= 30 / 69.0::DOUBLE AND abs(lng + 80.5) <= 30 / 55.2::DOUBLE AND miles <= 30",
}
ORACLE = {
    "watch_list": f"{_R} SELECT listing_id, city, status, list_price, miles AS miles_to_center FROM r WHERE " + " AND ".join(f"({v})" for k, v in _EACH.items() if k not in ("max_beds", "school_districts", "cities")),
    "criteria_met": f"{_R} " + " UNION ALL ".join(f"SELECT listing_id, '{k}' AS criterion FROM r WHERE {v}" for k, v in _EACH.items()),
    "structured_search": f"{_R} SELECT listing_id, city, status, list_price, sold_price, bedrooms FROM r WHERE trim(address) <> '' AND upper(city) = 'NATION_16' AND bedrooms >= 2 AND coalesce(sold_price, list_price) BETWEEN 20000 AND 450000 AND acres <= 39 AND upper(remarks) LIKE '%NEW%' AND upper(remarks) LIKE '%HOME%' ORDER BY status = 'Active' DESC, close_date DESC NULLS LAST, listing_id LIMIT 12",
}
