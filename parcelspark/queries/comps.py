"""Comparables and valuations, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.plans import comps
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, PARCELS_SQL, listings, parcels

DAY = f"DATE '{AS_OF}'"


NEWEST = 200  # Fixed value: of each cohort, what a choice of comparables looks at


def _scored(spark, d, most=None):
    deeds = parcels(spark, d).select("parcel_id", F.col("last_sale_price").alias("deed_price"))
    return comps.scored_comps(comps.comp_pool(listings(spark, d), AS_OF, most=most, deeds=deeds), AS_OF)


QUERIES = {
    "comp_pool": lambda spark, d: comps.comp_pool(listings(spark, d), AS_OF).select("listing_id", "comp_id", "cohort", "c_price", "c_date"),
    "comp_ranking": lambda spark, d: _scored(spark, d).select("listing_id", "comp_id", "cohort", "price", "score", "atypical"),
    "comp_similarity": lambda spark, d: comps.similarity(_scored(spark, d), AS_OF),
    "selected_comps": lambda spark, d: comps.selected_comps(_scored(spark, d, NEWEST), together=True),
    "valuations": lambda spark, d: comps.valuations(comps.selected_comps(_scored(spark, d, NEWEST), together=True), AS_OF),
    "valuations_of_top_comps": lambda spark, d: comps.valuations(comps.top_comps(_scored(spark, d, NEWEST)), AS_OF, parcels(spark, d).join(comps.subjects(listings(spark, d)).select("listing_id", F.col("s_parcel").alias("parcel_id")), "parcel_id").select("listing_id", F.col("last_sale_price").alias("prior_price"), F.col("last_sale_date").alias("prior_date"))),
}

_BAND = " ".join(f"WHEN s_acres >= {lo} AND s_acres < {hi if hi < 1e300 else '1e300'} THEN c_acres >= {{low}} * {a} AND c_acres <= {{high}} * {b if b < 1e300 else '1e300'}" for lo, hi, a, b in comps.ACRE_BANDS)
STRICT, WIDE = (f"(CASE WHEN coalesce(s_acres, 0) <= 0 THEN true {_BAND.format(low=a, high=b)} END)" for a, b in ((1.0, 1.0), (0.5, 1.5)))
MILES = "2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))))"
POOL = f"""{BRIDGE_SQL}, {PARCELS_SQL}, s AS (SELECT listing_id, parcel_id AS s_parcel, class_id, county AS s_county, subdivision AS s_sub, sqft AS s_sqft, acres AS s_acres, year_built AS s_year, bedrooms AS s_beds, full_baths AS s_baths, lat, lng, list_price AS s_price FROM listings WHERE status = 'Active' AND class_id = 'RE_1'),
c AS (SELECT listing_id AS comp_id, parcel_id AS c_parcel, class_id AS c_class, county AS c_county, subdivision AS c_sub, status AS c_status, coalesce(sold_price, list_price) AS c_price, coalesce(close_date, list_date) AS c_date, list_price AS c_list, original_list_price AS c_original, sold_price, dom, sqft AS c_sqft, acres AS c_acres,
  year_built AS c_year, bedrooms AS c_beds, full_baths AS c_baths, lat AS lat2, lng AS lng2 FROM listings WHERE status IN ('Closed', 'Pending') AND coalesce(sold_price, list_price) > 25000 AND coalesce(close_date, list_date) >= {DAY} - 1459),
p AS (SELECT s.*, c.*, {MILES} AS d, c_sqft BETWEEN 0.4::DOUBLE * s_sqft AND 2.5::DOUBLE * s_sqft AS sized, c_price BETWEEN 0.4::DOUBLE * s_price AND 3.0::DOUBLE * s_price AND c_date >= {DAY} - 729 AS rest, CASE WHEN s_acres < 1 THEN [0.5, 1, 2] WHEN s_acres < 5 THEN [1, 3, 5] ELSE [3, 7, 12] END AS r FROM s JOIN c ON c_class = s.class_id),
g0 AS (SELECT *, 0 AS k, row_number() OVER (PARTITION BY listing_id ORDER BY c_date DESC, comp_id DESC) AS place FROM p WHERE s_sub = c_sub AND sized QUALIFY place <= 200), rich AS (SELECT listing_id FROM g0 GROUP BY 1 HAVING count(*) >= 5),
b AS (SELECT * FROM p WHERE sized AND rest AND listing_id NOT IN (SELECT listing_id FROM rich)),
u AS (SELECT *, unnest(list_filter([CASE WHEN s_sub = c_sub THEN 0 END, CASE WHEN d <= r[1] AND {STRICT} THEN 1 END, CASE WHEN d <= r[2] AND {STRICT} THEN 2 END, CASE WHEN d <= r[3] AND {STRICT} THEN 3 END, CASE WHEN s_county = c_county AND s_acres > 0 AND {STRICT} THEN 4 END,
  CASE WHEN s_county = c_county AND s_acres > 0 AND {WIDE} THEN 5 END, CASE WHEN s_acres > 0 AND {STRICT} THEN 6 END, CASE WHEN s_acres > 0 AND {WIDE} THEN 7 END, CASE WHEN s_county = c_county THEN 8 END, 9], lambda x: x IS NOT NULL)) AS k FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY listing_id, k ORDER BY c_date DESC, comp_id DESC) AS place FROM u QUALIFY place <= 200),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY listing_id, c_parcel ORDER BY k, place) = 1), q AS (SELECT listing_id, k, coalesce(sum(count(*)) OVER (PARTITION BY listing_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o GROUP BY 1, 2),
pool AS (SELECT * EXCLUDE (place) FROM (SELECT * FROM g0 WHERE listing_id IN (SELECT listing_id FROM rich) QUALIFY row_number() OVER (PARTITION BY listing_id, c_parcel ORDER BY place) = 1) WHERE c_parcel <> s_parcel
  UNION ALL BY NAME SELECT o.* EXCLUDE (place) FROM o JOIN q ON q.listing_id = o.listing_id AND q.k = o.k WHERE before < 30 AND c_parcel <> s_parcel)"""
COHORT = f"{comps.COHORTS!r}[k + 1]"
near = lambda a, b, scale: f"exp(-abs({a} - {b}) / {scale})"
ACRE_SCALE = "greatest(2.0::DOUBLE, (CASE WHEN s_acres <> 0 THEN s_acres ELSE 5.0::DOUBLE END) * 0.5::DOUBLE)"
SCORED = f"""{POOL}, rt AS (SELECT listing_id, list_sort(list(sold_price / c_original)) AS v FROM pool WHERE c_status = 'Closed' AND sold_price / c_original > 0.5 AND sold_price / c_original < 1.5 GROUP BY 1),
w AS (SELECT pool.*, {COHORT} AS cohort, CASE WHEN c_status = 'Pending' THEN round_even(c_list * coalesce(v[len(v) // 2 + 1], 0.98::DOUBLE), 0) ELSE sold_price END AS price, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (s_acres - 1) / 14)) AS lh FROM pool LEFT JOIN rt USING (listing_id)),
y AS (SELECT w.*, price / c_sqft AS c_ppsf, CASE WHEN price / c_original < 0.85 THEN 'below_list' WHEN price / c_original > 1.05 THEN 'above_list' WHEN last_sale_price > 1000 AND price / last_sale_price < 0.55 THEN 'below_deed' WHEN dom > 180 THEN 'long_marketing' END AS atypical FROM w LEFT JOIN (SELECT parcel_id, last_sale_price FROM parcels) x ON x.parcel_id = w.c_parcel),
sc AS (SELECT *, round((100 * (1 - 0.6::DOUBLE * lh) * {near("s_sqft", "c_sqft", "600.0::DOUBLE")} + 60 * (0.4::DOUBLE + 1.3::DOUBLE * lh) * {near("s_acres", "c_acres", ACRE_SCALE)} + 30 * {near("s_year", "c_year", "15.0::DOUBLE")} + 80 * exp(-d / 5) + 70 * exp(-greatest(0, {DAY} - c_date) / 180.0::DOUBLE)
  + 50 * (1 - 0.4::DOUBLE * lh) * {near("s_price / s_sqft", "c_ppsf", "80.0::DOUBLE")} + 25 * (1 - 0.4::DOUBLE * lh) * {near("s_beds", "c_beds", "1.0::DOUBLE")} + 15 * {near("s_baths", "c_baths", "1.0::DOUBLE")}) * CASE WHEN atypical IS NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END
  * CASE WHEN c_status = 'Pending' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN s_sub = c_sub THEN 50 ELSE 0 END, 6) AS score FROM y)"""
ALL, ALL_SCORED = (x.replace(" QUALIFY place <= 200", "") for x in (POOL, SCORED))  # every candidate, not the newest of each cohort alone
AXES = {"age": near("s_year", "c_year", "15.0::DOUBLE"), "land": near("s_acres", "c_acres", ACRE_SCALE), "place": "exp(-d / 5)", "rooms": near("s_beds", "c_beds", "1.0::DOUBLE"), "size": near("s_sqft", "c_sqft", "600.0::DOUBLE"), "time": f"exp(-greatest(0, {DAY} - c_date) / 180.0::DOUBLE)"}
EFF = lambda a: f"(CASE WHEN {a} <= 1 THEN {a} ELSE 1 + sqrt({a} - 1) END)"
TIER = lambda a, b, c: f"CASE WHEN s_acres < 2 THEN {a}::DOUBLE WHEN s_acres < 15 THEN {b}::DOUBLE ELSE {c}::DOUBLE END"
ORACLE = {
    "comp_pool": f"{ALL} SELECT listing_id, comp_id, {COHORT} AS cohort, c_price, c_date FROM pool",
    "comp_ranking": f"{ALL_SCORED} SELECT listing_id, comp_id, cohort, price, score, atypical FROM sc",
    "comp_similarity": f"""{ALL_SCORED}, ax AS (SELECT listing_id, comp_id, {", ".join(f"round(100 * {v}, 6) AS {k}" for k, v in AXES.items())} FROM sc),
l AS (SELECT listing_id, comp_id, unnest([{", ".join(f"(100 - {k}, '{k}')" for k in AXES)}]) AS z FROM ax), r AS (SELECT *, row_number() OVER (PARTITION BY listing_id, comp_id ORDER BY z[1] DESC, z[2]) AS i FROM l), t AS (SELECT listing_id, comp_id, string_agg(z[2], ';' ORDER BY i) AS drags FROM r WHERE i <= 3 GROUP BY 1, 2)
SELECT ax.*, ({" + ".join(AXES)}) / 6 AS similarity, drags FROM ax JOIN t USING (listing_id, comp_id)""",
    "valuations_of_top_comps": f"""{SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, comp_id) AS pick FROM sc QUALIFY pick <= 6),
h AS (SELECT *, greatest(0, ({DAY} - c_date) / 30.4::DOUBLE) AS age FROM k), h2 AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY age, comp_id) - 1 AS i, count(*) OVER (PARTITION BY listing_id) AS n FROM h),
gr AS (SELECT listing_id, any_value(n) AS n, median(c_ppsf) FILTER (i < n // 2) AS np, median(c_ppsf) FILTER (i >= n // 2) AS op, (median(age) FILTER (i >= n // 2) - median(age) FILTER (i < n // 2)) / 12 AS gap FROM h2 GROUP BY 1),
ra AS (SELECT listing_id, CASE WHEN n >= 4 AND gap > 0.1 THEN least(0.12::DOUBLE, greatest(0.0::DOUBLE, pow(np / op, 1 / gap) - 1)) ELSE 0.04::DOUBLE END AS rate FROM gr),
z AS (SELECT h.*, rate, c_ppsf * pow(1 + rate, age / 12) * pow(c_sqft / s_sqft, 0.25::DOUBLE) AS adj FROM h JOIN ra USING (listing_id)),
ba AS (SELECT listing_id, count(*) AS n_comps, any_value(s_parcel) AS s_parcel, any_value(s_sqft) AS s_sqft, any_value(s_acres) AS s_acres, any_value(rate) AS rate, median(adj) AS pp, median(adj) FILTER (pick <= 3) AS tp, median(c_acres) FILTER (pick <= 3) AS ta, median(c_ppsf) FILTER (c_acres > 0) AS built, min(price) AS lo, max(price) AS hi,
  median(price) AS md, max(c_sqft) AS largest, min(d) AS nearest, median(c_ppsf) AS ppsf FROM z GROUP BY 1),
re AS (SELECT listing_id, median((price - built * c_sqft) / {EFF("c_acres")}) * 0.5::DOUBLE AS lr FROM z JOIN (SELECT listing_id, built FROM ba) USING (listing_id) WHERE c_acres > 0 AND price - built * c_sqft > 0 GROUP BY 1),
m AS (SELECT ba.*, lr, tp * s_sqft AS sb, greatest(0, s_acres - ta) AS gap, {EFF("s_acres")} AS eff, greatest(0, ({DAY} - last_sale_date) / 30.4::DOUBLE) AS old, last_sale_price AS pr FROM ba LEFT JOIN re USING (listing_id) LEFT JOIN parcels ON parcels.parcel_id = s_parcel),
v AS (SELECT *, sb + gap * 5750 AS direct, pp * s_sqft AS per_sqft, CASE WHEN s_acres > 0 THEN built * s_sqft + lr * eff END AS residual, CASE WHEN old <= 84 AND exp(-old / 13) >= 0.02 THEN pr * pow(1 + rate, old / 12) END AS prior_sale FROM m),
x AS (SELECT *, {TIER(0.40, 0.45, 0.40)} AS wd, {TIER(0.50, 0.30, 0.15)} AS wp, CASE WHEN residual IS NULL THEN 0 ELSE {TIER(0.10, 0.25, 0.45)} END AS wr, CASE WHEN prior_sale IS NULL THEN 0 ELSE 3 * exp(-old / 13) END AS ws FROM v),
e AS (SELECT *, (direct * wd + per_sqft * wp + coalesce(residual * wr, 0) + coalesce(prior_sale * ws, 0)) / (wd + wp + wr + ws) AS m0, least(sb + gap * 5000, per_sqft * 0.93::DOUBLE, CASE WHEN residual IS NOT NULL THEN built * s_sqft + lr * 0.85::DOUBLE * eff END, prior_sale * 0.95::DOUBLE) AS l0,
  greatest(sb + gap * 6500, per_sqft * 1.07::DOUBLE, CASE WHEN residual IS NOT NULL THEN built * s_sqft + lr * 1.15::DOUBLE * eff END, prior_sale * 1.05::DOUBLE) AS h0, 0.4::DOUBLE * lo AS fl, least(1.75::DOUBLE * hi, 1.4::DOUBLE * md) AS rf, list_filter([direct, per_sqft, residual], lambda q: q IS NOT NULL) AS three FROM x),
f AS (SELECT *, least(greatest(m0, fl), rf) AS mid, least(greatest(l0, fl), rf) AS l1, least(greatest(h0, fl), rf) AS h1, (list_max(three) - list_min(three)) / list_median(three) * 100 AS divergence_pct FROM e)
SELECT listing_id, n_comps, rate, direct, per_sqft, residual, prior_sale, CAST(NULL AS DOUBLE) AS model, greatest(mid * 0.25::DOUBLE, mid - (mid - l1) * 2, mid * 0.85::DOUBLE) AS low, mid, least(mid + (h1 - mid) * 2, mid * 1.15::DOUBLE) AS high, ppsf, divergence_pct,
  CASE WHEN s_sqft > largest * 1.4::DOUBLE OR nearest > 40 OR divergence_pct > 25 OR n_comps < 3 THEN 'Low' WHEN divergence_pct > 12 OR n_comps < 5 OR nearest > 15 THEN 'Moderate' ELSE 'High' END AS confidence FROM f""",
}
