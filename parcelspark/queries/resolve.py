"""Subjects found from numbers and typed addresses, with the SQL of the whole cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from parcelspark.plans import resolve
from parcelspark.sources.bridge import BRIDGE_SQL, PARCELS_SQL, listings, parcels

# Every twentieth parcel is asked for in one of eight ways; half of them are on no market. Written for both dialects.
ASKED = """CASE parcel_id % 160 WHEN 20 THEN concat(' ', site_address) WHEN 40 THEN concat(replace(replace(replace(upper(site_address), 'STREET', 'ST'), 'AVENUE', 'AVE'), 'LANE', 'LN'), ', VA 24060') WHEN 60 THEN concat(lower(site_address), ' boone va')
WHEN 80 THEN concat(split_part(site_address, ' ', 1), ' ', split_part(site_address, ' ', 2), ' Rd') WHEN 100 THEN 'zz 999 Nowhere Pike' WHEN 120 THEN concat(split_part(site_address, ' ', 1), ' ', lower(split_part(site_address, ' ', 2))) END"""
NUMBER = "CASE WHEN parcel_id % 160 IN (0, 140) THEN concat(' ', CAST(parcel_id AS STRING)) WHEN parcel_id % 160 = 80 THEN '000' END"


def _resolve(spark, d):
    p = parcels(spark, d)
    subjects = p.filter("parcel_id % 20 = 0").select(F.col("parcel_id").alias("subject_id"), F.expr(ASKED).alias("asked_address"), F.expr(NUMBER).alias("asked_parcel"))
    rows = listings(spark, d).filter("parcel_id % 8 <> 0").join(p.select("parcel_id", F.col("site_address").alias("address")), "parcel_id")
    some = lambda df, every, c: df.withColumns({x: F.when(F.col(c) % every > 0, F.col(x)) for x in ("lat", "lng")})
    return resolve.resolve(subjects, some(rows, 3, "listing_id"), some(p, 16, "parcel_id"))


QUERIES = {"resolved_subjects": _resolve}

_SHORT = reduce(lambda c, p: f"replace({c}, '{p[1]}', '{p[0]}')", resolve.SUFFIXES.items(), "norm")
_LONG = reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", resolve.SUFFIXES.items(), "norm")
_STREET = "trim(split_part(regexp_replace(trim(regexp_extract(upper(trim(address)), '^\\d+[A-Z]?\\s+(.*)$', 1)), '^(N|S|E|W|NE|NW|SE|SW)\\s+', ''), ',', 1))"
ORACLE = {
    "resolved_subjects": f"""{BRIDGE_SQL}, {PARCELS_SQL}, ls AS (SELECT listing_id, l.parcel_id, site_address AS address, upper(site_address) AS w, l.city, status, list_date, CASE WHEN listing_id % 3 > 0 THEN l.lat END AS lat, CASE WHEN listing_id % 3 > 0 THEN l.lng END AS lng FROM listings l JOIN parcels USING (parcel_id) WHERE l.parcel_id % 8 <> 0),
s AS (SELECT parcel_id AS sid, {ASKED} AS a, {NUMBER.replace("STRING", "VARCHAR")} AS num FROM parcels WHERE parcel_id % 20 = 0),
nm AS (SELECT sid, a, trim(regexp_replace(regexp_replace(upper(trim(a)), '\\b(VA|VIRGINIA|\\d{{5}}(?:-\\d{{4}})?)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM s WHERE a IS NOT NULL),
f AS (SELECT sid, 0 AS o, upper(trim(a)) AS form FROM nm UNION ALL SELECT sid, 1, norm FROM nm UNION ALL SELECT sid, 2, {_SHORT} FROM nm UNION ALL SELECT sid, 3, {_LONG} FROM nm
  UNION ALL SELECT sid, 4, array_to_string(string_split(norm, ' ')[1:2], ' ') FROM nm WHERE len(string_split(norm, ' ')) >= 2 UNION ALL SELECT sid, 5, array_to_string(string_split(norm, ' ')[:-2], ' ') FROM nm WHERE len(string_split(norm, ' ')) > 3),
g AS (SELECT sid, o, form, string_split(form, ' ') AS ws, regexp_full_match(string_split(form, ' ')[1], '\\d+') AS has FROM f WHERE o > 0 AND form <> ''), h AS (SELECT sid, o, ws[1] AS w1, has, CASE WHEN has THEN ws[2:] ELSE ws END AS rest FROM g),
k AS (SELECT h.*, (SELECT max(len(t.w)) FROM (SELECT unnest(rest) AS w) t) AS longest FROM h), pc AS (SELECT *, upper(site_address) AS w, upper(concat_ws(' ', site_address, county)) AS hay FROM parcels),
each AS (SELECT k.sid, k.o, k.w1, k.has, p.parcel_id, p.w, p.hay, p.last_sale_date, unnest(rest) AS word, len(rest) AS n FROM k JOIN pc p ON longest >= 3 AND (NOT has OR (starts_with(p.w, w1) AND NOT regexp_matches(p.w[len(w1) + 1:len(w1) + 1], '[0-9]')))),
fit AS (SELECT sid, o, w1, parcel_id, any_value(w) AS w, any_value(last_sale_date) AS d FROM each WHERE contains(hay, word) GROUP BY sid, o, w1, parcel_id HAVING count(*) = any_value(n)),
hit AS (
  SELECT sid, 1 AS step, listing_id, NULL::BIGINT AS pid FROM s JOIN ls ON upper(trim(num)) = CAST(parcel_id AS VARCHAR) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY status = 'Active' DESC, list_date DESC, listing_id) = 1
  UNION ALL SELECT sid, 2, listing_id, NULL FROM (SELECT sid, o, listing_id, status, list_date FROM f JOIN ls ON contains(w, form) WHERE o < 5 AND len(form) >= 3) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o, status = 'Active' DESC, list_date DESC, listing_id) = 1
  UNION ALL SELECT sid, 3, NULL, parcel_id FROM s JOIN parcels ON upper(trim(num)) = CAST(parcel_id AS VARCHAR)
  UNION ALL SELECT sid, 4, NULL, parcel_id FROM fit QUALIFY row_number() OVER (PARTITION BY sid ORDER BY o, starts_with(w, w1) DESC, d DESC, parcel_id) = 1),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY sid ORDER BY step) = 1),
r AS (SELECT sid, step, one.listing_id, coalesce(pid, ls.parcel_id) AS parcel_id, p.assessed, coalesce(ls.address, CASE WHEN one.listing_id IS NULL THEN p.site_address END) AS address, coalesce(ls.city, CASE WHEN one.listing_id IS NULL THEN p.city END) AS city,
  CASE WHEN one.listing_id IS NULL THEN CASE WHEN p.parcel_id % 16 > 0 THEN p.lat END ELSE ls.lat END AS lat, CASE WHEN one.listing_id IS NULL THEN CASE WHEN p.parcel_id % 16 > 0 THEN p.lng END ELSE ls.lng END AS lng FROM one LEFT JOIN ls ON ls.listing_id = one.listing_id LEFT JOIN parcels p ON p.parcel_id = coalesce(pid, ls.parcel_id)),
q AS (SELECT *, {_STREET} AS street, upper(trim(city)) AS pcity FROM r), want AS (SELECT DISTINCT street, pcity FROM q WHERE lat IS NULL AND street <> ''),
st AS (SELECT street, pcity, lat, lng FROM want JOIN ls ON contains(w, street) AND upper(city) = pcity WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY street, pcity ORDER BY listing_id) <= {resolve.STREET_ROWS}),
md AS (SELECT street, pcity, list_sort(list(lat))[len(list(lat)) // 2 + 1] AS mlat, list_sort(list(lng))[len(list(lng)) // 2 + 1] AS mlng FROM st GROUP BY 1, 2)
SELECT s.sid AS subject_id, CASE step WHEN 1 THEN 'listing_number' WHEN 2 THEN 'listing_address' WHEN 3 THEN 'parcel_number' WHEN 4 THEN 'parcel_address' ELSE 'none' END AS step, listing_id, parcel_id, assessed, address, city,
coalesce(lat, mlat) AS lat, coalesce(lng, mlng) AS lng, CASE WHEN lat IS NOT NULL THEN 'own' WHEN mlat IS NOT NULL THEN 'street' ELSE 'none' END AS place FROM s LEFT JOIN q ON q.sid = s.sid LEFT JOIN md ON md.street = q.street AND md.pcity = q.pcity""",
}
