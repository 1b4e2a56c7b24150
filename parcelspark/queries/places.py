"""Joins by place, key variants and time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.functions import text
from parcelspark.operators import relational as rel
from parcelspark.plans import sites
from parcelspark.queries.owners import K
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, INFRA_SQL, PARCELS_SQL, infrastructure, listings, parcels

P = f"WITH {PARCELS_SQL}, {INFRA_SQL}"
HAVERSINE = "2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(i.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(i.lat)) * pow(sin(radians(i.lng - p.lng) / 2), 2))))"


def _lines(spark):
    step = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((37.0 + F.pmod(F.col("id") * 7 + i * 3, F.lit(10)) / 10.0).alias("lat"), (-81.0 + i * 0.25).alias("lng")))
    return spark.range(5).select(F.col("id").alias("line_id"), step.alias("points"))


def _squares(spark):
    def ring(size):
        x, y = -81.0003 + F.col("id") * 0.2, 37.0003 + F.col("id") * 0.15  # no parcel lies on an edge
        corner = lambda a, b: F.struct((x + a * size + (0.25 - size) / 2).alias("x"), (y + b * size + (0.25 - size) / 2).alias("y"))
        return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))

    return spark.range(5).select(F.col("id").alias("polygon_id"), F.array(ring(0.25), ring(0.1)).alias("rings"))


def _variants(spark, d):
    short = parcels(spark, d).select(F.lpad(F.col("parcel_id").cast("string"), 12, "0").alias("roll_id"), "assessed")
    asked = listings(spark, d).filter("status = 'Active'").select("listing_id", F.when(F.col("listing_id") % 2 == 0, F.col("parcel_id").cast("string")).otherwise(F.concat(F.lit(" 00"), F.col("parcel_id").cast("string"), F.lit("-"))).alias("raw_id"))
    return rel.variant_join(asked, short, "raw_id", "roll_id", text.parcel_id_variants).select("listing_id", "roll_id", "assessed")


def _deltas(spark, d):
    a = parcels(spark, d).filter("parcel_id % 5 <> 0").select("parcel_id", (F.col("parcel_id") % 90).cast("double").alias("score"))
    b = parcels(spark, d).filter("parcel_id % 7 <> 0").select("parcel_id", (F.col("parcel_id") % 90 + F.col("parcel_id") % 9).cast("double").alias("score"))
    return rel.diff(a, b, "parcel_id", "score", 5.0)


def _snapshots(spark, d):
    new = parcels(spark, d).select("parcel_id", "mail_address")
    old = new.withColumn("mail_address", F.when(F.col("parcel_id") % 10 == 0, None).when(F.col("parcel_id") % 10 == 1, F.concat("mail_address", F.lit(" APT 2"))).otherwise(F.col("mail_address")))
    return rel.snapshot_changes(old, new, "parcel_id", "mail_address")


def _points(spark, d):
    return parcels(spark, d).select("parcel_id", "lat", "lng")


QUERIES = {
    "near_infrastructure": lambda spark, d: sites.near_infrastructure(parcels(spark, d), infrastructure(spark, d)),
    "site_scores": lambda spark, d: sites.site_scores(parcels(spark, d), infrastructure(spark, d)),
    "site_presets": lambda spark, d: rel.merge_presets(sites.site_scores(parcels(spark, d), infrastructure(spark, d)), ["parcel_id"], "preset", "score", list(sites.PRESETS)),
    "hub_distances": lambda spark, d: sites.hub_distances(parcels(spark, d)),
    "assemblages": lambda spark, d: sites.assemblages(parcels(spark, d)),
    "nearest_lines": lambda spark, d: rel.nearest_line(_points(spark, d), _lines(spark), "parcel_id", 10.0),
    "polygons_of_parcels": lambda spark, d: rel.polygon_join(_points(spark, d), _squares(spark), "parcel_id").select("parcel_id", "polygon_id"),
    "variant_keys": _variants,
    "score_deltas": _deltas,
    "mail_changes": _snapshots,
    "token_search": lambda spark, d: rel.token_search(parcels(spark, d).select("parcel_id", "site_address", "owner1", F.concat_ws(" ", "site_address", "owner1", "city").alias("hay")), "hay", "oak smith", "site_address").drop("hay"),
    "house_search": lambda spark, d: rel.house_search(parcels(spark, d).select("parcel_id", "site_address"), "site_address", "110"),
    "prefix_index": lambda spark, d: rel.prefix_index(parcels(spark, d), "parcel_id", "owner1", 2),
}

_LINES = "lines AS (SELECT a AS line_id, i AS n, 37.0::DOUBLE + ((a * 7 + i * 3) % 10) / 10.0::DOUBLE AS lat, -81.0::DOUBLE + i * 0.25::DOUBLE AS lng FROM range(5) t(a), range(5) u(i))"
_FOUND = f"""{P}, sub AS (SELECT parcel_id, infra_id AS substation_id, {HAVERSINE} AS substation_miles, kv FROM parcels p, infra i WHERE kind = 'substation' QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY substation_miles, infra_id) = 1),
fib AS (SELECT parcel_id, min({HAVERSINE}) AS fibre_miles FROM parcels p, infra i WHERE kind = 'fibre' GROUP BY 1), wat AS (SELECT parcel_id, sum(capacity) AS water_5mi, count(*) AS works_5mi FROM parcels p, infra i WHERE kind = 'water' AND {HAVERSINE} <= 5 GROUP BY 1),
near AS (SELECT parcel_id, substation_id, substation_miles, kv, fibre_miles, water_5mi, works_5mi FROM parcels LEFT JOIN sub USING (parcel_id) LEFT JOIN fib USING (parcel_id) LEFT JOIN wat USING (parcel_id))"""
_SITES = f"""{_FOUND}, pre AS (SELECT unnest(['edge', 'enterprise', 'hyperscale']) AS preset, unnest([2, 10, 25]) AS la, unnest([10, 5, 3]) AS mm),
f AS (SELECT n.*, acres, owner1, preset, la, mm, CASE WHEN kv >= 500 THEN 1.0::DOUBLE WHEN kv >= 230 THEN 0.9::DOUBLE WHEN kv >= 138 THEN 0.7::DOUBLE WHEN kv >= 115 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS vf FROM near n JOIN parcels USING (parcel_id), pre),
sc AS (SELECT parcel_id, preset, coalesce(greatest(0, 1 - substation_miles / mm), 0) * vf * 40 + CASE WHEN acres < la THEN 0 WHEN acres >= 4 * la THEN 20 ELSE 20 * (acres - la) / (3 * la) END + CASE WHEN water_5mi >= 10 THEN 20 WHEN water_5mi >= 3 THEN 14 WHEN water_5mi >= 1 THEN 8 WHEN water_5mi > 0 THEN 2 ELSE 0 END
  + CASE WHEN fibre_miles <= 1 THEN 20 WHEN fibre_miles < 5 THEN 20 * (5 - fibre_miles) / 4 ELSE 0 END AS score, concat_ws(';', CASE WHEN acres < la THEN 'acres' END, CASE WHEN regexp_matches(upper(owner1), '\\bCOUNTY OF\\b') THEN 'owner' END, CASE WHEN coalesce(substation_miles, 1e9) > mm THEN 'substation' END) AS fails FROM f)"""
_ROAD = {k: f"2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({a}::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians({a}::DOUBLE)) * pow(sin(radians({b}::DOUBLE - lng) / 2), 2)))) * 1.3::DOUBLE" for k, (a, b) in sites.HUBS.items()}
ORACLE = {
    "near_infrastructure": f"{_FOUND} SELECT * FROM near",
    "site_scores": f"{_SITES} SELECT * FROM sc",
    "site_presets": f"{_SITES} SELECT parcel_id, max(score) FILTER (preset = 'edge') AS edge, max(score) FILTER (preset = 'enterprise') AS enterprise, max(score) FILTER (preset = 'hyperscale') AS hyperscale, max(score) AS best FROM sc GROUP BY 1",
    "hub_distances": f"WITH {PARCELS_SQL} SELECT parcel_id, " + ", ".join(f"{r} AS {k}_miles, {r} / CASE WHEN {r} < 5 THEN 25 WHEN {r} < 20 THEN 38 ELSE 50 END * 60 AS {k}_minutes" for k, r in _ROAD.items()) + " FROM parcels",
    "nearest_lines": f"""{P}, {_LINES}, seg AS (SELECT a.line_id, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng FROM lines a JOIN lines b ON b.line_id = a.line_id AND b.n = a.n + 1),
v AS (SELECT parcel_id, lat, lng, line_id, (alng - lng) * 69 * cos(radians(lat)) AS ax, (alat - lat) * 69 AS ay, (blng - alng) * 69 * cos(radians(lat)) AS dx, (blat - alat) * 69 AS dy FROM parcels, seg),
w AS (SELECT *, least(1, greatest(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM v), z AS (SELECT parcel_id, lat, lng, line_id, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS line_miles FROM w),
b AS (SELECT * FROM z WHERE line_miles <= 10 QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY line_miles, line_id) = 1) SELECT p.parcel_id, p.lat, p.lng, line_id, line_miles FROM parcels p LEFT JOIN b USING (parcel_id)""",
    "polygons_of_parcels": f"""{P}, sq AS (SELECT i AS polygon_id, -81.0003::DOUBLE + i * 0.2::DOUBLE AS x, 37.0003::DOUBLE + i * 0.15::DOUBLE AS y FROM range(5) t(i))
SELECT parcel_id, polygon_id FROM parcels, sq WHERE lng BETWEEN x AND x + 0.25::DOUBLE AND lat BETWEEN y AND y + 0.25::DOUBLE AND NOT (lng BETWEEN x + 0.075::DOUBLE AND x + 0.175::DOUBLE AND lat BETWEEN y + 0.075::DOUBLE AND y + 0.175::DOUBLE)""",
    "variant_keys": f"{BRIDGE_SQL}, {PARCELS_SQL} SELECT listing_id, lpad(CAST(p.parcel_id AS VARCHAR), 12, '0') AS roll_id, p.assessed FROM listings l LEFT JOIN parcels p ON p.parcel_id = l.parcel_id WHERE status = 'Active'",
    "score_deltas": f"""{P}, a AS (SELECT parcel_id, CAST(parcel_id % 90 AS DOUBLE) AS old FROM parcels WHERE parcel_id % 5 <> 0), b AS (SELECT parcel_id, CAST(parcel_id % 90 + parcel_id % 9 AS DOUBLE) AS new FROM parcels WHERE parcel_id % 7 <> 0),
x AS (SELECT parcel_id, old, new, CASE WHEN old IS NULL THEN 'NEW' WHEN new IS NULL THEN 'DROPPED' WHEN abs(new - old) >= 5 THEN 'CHANGED' END AS change FROM a FULL JOIN b USING (parcel_id)) SELECT * FROM x WHERE change IS NOT NULL""",
    "mail_changes": f"WITH {PARCELS_SQL} SELECT parcel_id, CASE WHEN parcel_id % 10 = 1 THEN mail_address || ' APT 2' END AS before, mail_address AS after FROM parcels WHERE parcel_id % 10 IN (0, 1)",
    "token_search": f"WITH {PARCELS_SQL} SELECT parcel_id, site_address, owner1, CAST(CASE WHEN starts_with(upper(site_address), 'OAK SMITH') THEN 3 WHEN contains(upper(site_address), 'OAK SMITH') THEN 2 ELSE 0 END AS INTEGER) AS addr_score FROM parcels WHERE upper(site_address || ' ' || owner1 || ' ' || city) LIKE '%OAK%' AND upper(site_address || ' ' || owner1 || ' ' || city) LIKE '%SMITH%'",
    "house_search": f"WITH {PARCELS_SQL} SELECT parcel_id, site_address FROM parcels WHERE regexp_matches(site_address, '^110([^0-9]|$)')",
    "prefix_index": f"WITH {PARCELS_SQL}, w AS (SELECT DISTINCT parcel_id, unnest(string_split(regexp_replace(upper(owner1), '[^A-Z0-9]+', ' ', 'g'), ' ')) AS w FROM parcels) SELECT DISTINCT parcel_id, w[1:n] AS prefix FROM w, range(2, 20) t(n) WHERE n <= len(w)",
    "assemblages": f"""WITH RECURSIVE {K.removeprefix("WITH ")},
big AS (SELECT parcel_id, acres, lat, lng, canonical_owner_id FROM parcels JOIN k USING (parcel_id) WHERE acres >= 25),
e AS (SELECT p.parcel_id AS a, i.parcel_id AS b FROM big p, big i WHERE abs(p.lat - i.lat) < 0.02 AND {HAVERSINE} <= 1), r(id, c) AS (SELECT parcel_id, parcel_id FROM big UNION SELECT b, c FROM r JOIN e ON a = id), l AS (SELECT id, min(c) AS component FROM r GROUP BY 1)
SELECT component, count(*) AS n_parcels, count(DISTINCT canonical_owner_id) AS n_owners, sum(acres) AS total_acres, avg(lat) AS centroid_lat, avg(lng) AS centroid_lng FROM big JOIN l ON l.id = parcel_id GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT canonical_owner_id) >= 2 AND sum(acres) >= 200""",
}
