"""Seller scores, models, cohort valuations and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.functions import text
from parcelspark.plans import models, sellers
from parcelspark.queries.market import banded
from parcelspark.queries.owners import K, q, squeezed
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, PARCELS_SQL, listings, parcels, price_bands
from parcelspark.streaming import changes, windows

DAY = f"DATE '{AS_OF}'"
UNTIL = "2000-06-01"


def _weekly(spark):
    d = F.date_add(F.lit("1975-01-01").cast("date"), (F.col("id") * 7).cast("int"))
    return spark.range(1388).filter("id % 60 >= 6").select(d.alias("day"), (4 + (F.col("id") * 13 % 800) / 100.0 + (F.col("id") % 7) * 0.0013).alias("rate"))


_WEEKLY = "weekly AS (SELECT DATE '1975-01-01' + CAST(i * 7 AS INTEGER) AS day, 4 + (i * 13 % 800) / 100.0::DOUBLE + (i % 7) * 0.0013::DOUBLE AS rate FROM range(1388) t(i) WHERE i % 60 >= 6), rates AS (SELECT CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS m, round(avg(rate), 2) AS rate FROM weekly GROUP BY 1)"


def _seller(spark, d):
    p = parcels(spark, d)
    owed = p.filter("parcel_id % 17 = 0").select("parcel_id", (F.col("parcel_id") * 37 % 9000).cast("double").alias("amount"))
    return sellers.seller_scoring(p, listings(spark, d), sellers.monthly_rates(_weekly(spark)), owed, p.filter("parcel_id % 10 = 1"), AS_OF)


def _rates(spark, d):
    p = parcels(spark, d).select("parcel_id", "last_sale_date")
    return sellers.rate_at(p, "last_sale_date", sellers.monthly_rates(_weekly(spark)), "parcel_id", "rate")


def _quantiles(spark, d):
    return models.day_quantiles(listings(spark, d), price_bands(spark), UNTIL)


def _surface(spark, d):
    return models.pricing_surface(listings(spark, d), price_bands(spark), _quantiles(spark, d))


def observations(spark, d):
    """Each listing as seen on its list date, half way, and at its end."""
    rows = listings(spark, d)
    at = lambda day, status, price, sold: F.struct(day.cast("timestamp").alias("observed_at"), status.alias("status"), price.alias("list_price"), sold.alias("sold_price"))
    none = F.lit(None).cast("double")
    seen = F.array(at(F.col("list_date"), F.lit("Active"), F.col("original_list_price"), none), at(F.date_add("list_date", 300), F.lit("Active"), F.col("list_price"), none), at(F.date_add("list_date", 600), F.col("status"), F.col("list_price"), F.col("sold_price")))
    return rows.select("listing_id", F.explode(seen).alias("o")).select("listing_id", "o.*")


def _prices(spark, d):
    rows = listings(spark, d)
    return models.price_for_days(*models.day_model(rows, UNTIL), rows.filter("status = 'Active'"))


QUERIES = {
    "days_on_market_quartiles": lambda spark, d: models.day_predictions(listings(spark, d), UNTIL),
    "prices_for_days": _prices,
    "seller_scoring": _seller,
    "monthly_rates": lambda spark, d: sellers.monthly_rates(_weekly(spark)),
    "rates_at_purchase": _rates,
    "listing_changes": lambda spark, d: changes.batch_changes(observations(spark, d)),
    "event_sessions": lambda spark, d: windows.sessions(spark.read.parquet(f"{d}/events.parquet")),
    "value_model": lambda spark, d: models.value_model(listings(spark, d), UNTIL)[1],
    "cut_model": lambda spark, d: models.cut_metrics(models.cut_model(listings(spark, d), UNTIL)),
    "day_quantiles": _quantiles,
    "pinball_loss": lambda spark, d: models.pinball(listings(spark, d), price_bands(spark), _quantiles(spark, d), UNTIL),
    "pricing_surface": _surface,
    "sweet_spots": lambda spark, d: models.sweet_spots(_surface(spark, d)),
}

_Q = f"""{BRIDGE_SQL}, s AS (SELECT l.*, band FROM listings l {banded("list_price")} WHERE status = 'Closed' AND sold_price > 30000 AND sold_price < 3500000), e AS (SELECT * FROM s WHERE close_date < DATE '{UNTIL}'),
w AS (SELECT class_id, quantile_cont(dom::DOUBLE, 0.25) AS a, median(dom::DOUBLE) AS b, quantile_cont(dom::DOUBLE, 0.75) AS c FROM e GROUP BY 1), o AS (SELECT class_id, city, band, quantile_cont(dom::DOUBLE, 0.25) AS a, median(dom::DOUBLE) AS b, quantile_cont(dom::DOUBLE, 0.75) AS c FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 5),
k AS (SELECT DISTINCT l.class_id, city, bands.band FROM listings l JOIN bands USING (class_id)), dq AS (SELECT k.class_id, k.city, k.band, coalesce(o.a, w.a) AS p25, coalesce(o.b, w.b) AS p50, coalesce(o.c, w.c) AS p75 FROM k LEFT JOIN o USING (class_id, city, band) JOIN w ON w.class_id = k.class_id)"""
_SURFACE = f"""{_Q}, ps AS (SELECT listing_id, change, list_price * (1 + change) AS price, p50 * least(3.0::DOUBLE, greatest(0.4::DOUBLE, exp(4 * change))) AS days FROM (SELECT l.*, band FROM listings l {banded("list_price")} WHERE status = 'Active' AND list_price > 0) x JOIN dq USING (class_id, city, band), (SELECT round(-0.15::DOUBLE + 0.025::DOUBLE * i, 3) AS change FROM range(13) t(i)))"""
_GOOD = ["tenure", "equity", "estate_pattern", "absentee", "oos_mail", "expired", "investor_dispose", "hot_subdivision", "vintage_estate", "multi_prop", "intra_family", "mail_changed", "tax_delinquent", "price_cut", "serial_relister", "empty_nester", "forced_sale_alumni", "distressed", "neighbor_of_expired", "recent_purchase", "rate_locked"]
RATE = "arg_min(rate, (abs(m - (year(last_sale_date) * 12 + month(last_sale_date) - 1)), m))"
NEAR = "abs(m - (year(last_sale_date) * 12 + month(last_sale_date) - 1)) <= 3"
RECENT = lambda w: f"CASE WHEN off BETWEEN 0 AND {w - 1} THEN greatest(0.25::DOUBLE, 1 - off / {w}) ELSE 0 END"
_SELLER = f"""{BRIDGE_SQL}, {_WEEKLY}, {K.removeprefix("WITH ")}, cur AS (SELECT arg_max(rate, m) AS cr FROM rates), bought AS (SELECT parcel_id, {RATE} AS br FROM parcels, rates WHERE {NEAR} GROUP BY 1),
gone AS (SELECT l.*, p.last_sale_date AS lsd FROM listings l JOIN parcels p USING (parcel_id) WHERE status IN ('Expired/Cancelled', 'Withdrawn') AND off_market_date <= {DAY}),
h AS (SELECT parcel_id, count(*) AS ne, max(off_market_date) AS lo, arg_max((original_list_price - list_price) / original_list_price * 100, (off_market_date, listing_id)) AS cut, arg_max(remarks, (off_market_date, listing_id)) AS said FROM gone WHERE off_market_date > lsd GROUP BY 1),
ow AS (SELECT canonical_owner_id, count(*) AS np, count(*) FILTER (owner_type = 'entity' AND last_sale_date >= {DAY} - 1826) AS nb FROM k WHERE canonical_owner_id IS NOT NULL GROUP BY 1),
al AS (SELECT canonical_owner_id, count(DISTINCT l.parcel_id) AS nf, min(l.parcel_id) AS one FROM listings l JOIN k ON k.parcel_id = l.parcel_id WHERE status = 'Closed' AND dom >= 180 AND sold_price < l.assessed AND close_date >= {DAY} - 365 GROUP BY 1),
sd AS (SELECT county, subdivision, count(*) AS n FROM listings WHERE status = 'Closed' AND close_date >= {DAY} - INTERVAL 12 MONTH GROUP BY 1, 2), bar AS (SELECT county, list_sort(list(n)) AS v FROM sd GROUP BY 1), hot AS (SELECT county, subdivision FROM sd JOIN bar USING (county) WHERE n >= v[CAST(floor(len(v) * 0.75::DOUBLE) AS INT) + 1]),
an AS (SELECT DISTINCT parcel_id AS anchor, lat AS lat2, lng AS lng2 FROM gone WHERE off_market_date >= {DAY} - 30),
nb AS (SELECT parcel_id FROM parcels p, an WHERE abs(lat - lat2) < 0.01 AND 2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2)))) <= 0.5 GROUP BY 1 HAVING NOT bool_or(anchor = parcel_id)),
x AS (SELECT p.*, k.canonical_owner_id, coalesce(k.owner_type = 'entity', false) AS entity, ({DAY} - p.last_sale_date) / 365.25::DOUBLE AS t, br, cr, ne, cut, said, CAST({DAY} - lo AS INTEGER) AS off, np, nb.parcel_id IS NOT NULL AS beside, ow.nb AS nbuy, nf, one, hot.county IS NOT NULL AS hot, {squeezed("upper(site_address)")} <> {squeezed("upper(mail_address)")} AS absent,
  coalesce(last_sale_date2 AND p.last_sale_price <= 1000, false) AS fam FROM (SELECT *, last_sale_date >= {DAY} - 730 AS last_sale_date2 FROM parcels) p LEFT JOIN k ON k.parcel_id = p.parcel_id LEFT JOIN bought ON bought.parcel_id = p.parcel_id LEFT JOIN h ON h.parcel_id = p.parcel_id LEFT JOIN ow ON ow.canonical_owner_id = k.canonical_owner_id
  LEFT JOIN al ON al.canonical_owner_id = k.canonical_owner_id LEFT JOIN hot ON hot.county = p.county AND hot.subdivision = p.subdivision LEFT JOIN nb ON nb.parcel_id = p.parcel_id, cur WHERE p.parcel_id NOT IN (SELECT parcel_id FROM listings WHERE status IN ('Active', 'Pending'))),
y AS (SELECT *, entity AND coalesce(nbuy, 0) >= 3 AS is_flipper, CASE WHEN t < 2 THEN 0 WHEN t <= 8 THEN 25 * (t - 2) / 6 WHEN t <= 15 THEN 25 * (1 - (t - 8) / 14) WHEN t <= 25 THEN greatest(5, 25 * (1 - (t - 8) / 14)) ELSE 5 END AS tenure, CASE WHEN assessed > last_sale_price AND last_sale_price > 0 THEN least(15, (assessed - last_sale_price) / 200000 * 15) ELSE 0 END AS equity,
  CASE WHEN regexp_matches(owner1, {q(sellers.ESTATE_NAME)}) THEN 30 ELSE 0 END AS estate_pattern, CASE WHEN absent THEN 10 ELSE 0 END AS absentee, CASE WHEN absent AND mail_state <> 'VA' THEN 5 ELSE 0 END AS oos_mail, 20 * {RECENT(540)} AS expired, CASE WHEN entity AND t BETWEEN 3 AND 7 THEN 15 ELSE 0 END AS investor_dispose,
  CASE WHEN hot THEN 10 ELSE 0 END AS hot_subdivision, CASE WHEN year_built < 1960 AND assessed >= 300000 THEN 5 ELSE 0 END AS vintage_estate, CASE WHEN np >= 5 AND NOT (entity AND coalesce(nbuy, 0) >= 3) AND NOT regexp_matches(upper(owner1), {q(text.GOVERNMENT)}) THEN 5 ELSE 0 END AS multi_prop,
  CASE WHEN fam AND t < 2 THEN 25 WHEN fam THEN 10 ELSE 0 END AS intra_family, CASE WHEN parcel_id % 10 = 1 THEN 30 ELSE 0 END AS mail_changed, CASE WHEN parcel_id % 17 = 0 THEN 10 + least(20, (parcel_id * 37 % 9000) / 250) ELSE 0 END AS tax_delinquent, CASE WHEN cut >= 15 THEN 25 * {RECENT(365)} ELSE 0 END AS price_cut,
  CASE WHEN ne >= 3 THEN 25 ELSE 0 END AS serial_relister, CASE WHEN bedrooms >= 4 AND t >= 15 AND year_built < 1975 AND NOT entity THEN 15 ELSE 0 END AS empty_nester, CASE WHEN NOT entity AND (nf > 1 OR one <> parcel_id) THEN 15 ELSE 0 END AS forced_sale_alumni, CASE WHEN NOT entity AND regexp_matches(said, {q(text.DISTRESSED)}) THEN 15 ELSE 0 END AS distressed,
  CASE WHEN NOT entity AND beside THEN 10 ELSE 0 END AS neighbor_of_expired, CASE WHEN t < 1.5 THEN -25 ELSE 0 END AS recent_purchase, CASE WHEN round(cr - br, 2) >= 1 AND least(20, (round(cr - br, 2) - 1) * 10) >= 5 THEN -least(20, (round(cr - br, 2) - 1) * 10) ELSE 0 END AS rate_locked FROM x),
z AS (SELECT parcel_id, county, round(({" + ".join(_GOOD)})::DOUBLE, 6) AS score, is_flipper, concat_ws(';', {", ".join(f"CASE WHEN {g} <> 0 THEN '{g}' END" for g in _GOOD)}) AS signals FROM y) SELECT * FROM z WHERE score >= 40 OR is_flipper"""
ORACLE = {
    "seller_scoring": _SELLER,
    "monthly_rates": f"WITH {_WEEKLY} SELECT * FROM rates",
    "rates_at_purchase": f"WITH {PARCELS_SQL}, {_WEEKLY}, b AS (SELECT parcel_id, {RATE} AS rate FROM parcels, rates WHERE {NEAR} GROUP BY 1) SELECT parcel_id, last_sale_date, rate FROM parcels LEFT JOIN b USING (parcel_id)",
    "listing_changes": f"""{BRIDGE_SQL}, o AS (SELECT listing_id, list_date::TIMESTAMP AS t, 'Active' AS st, original_list_price AS p, NULL::DOUBLE AS sp FROM listings UNION ALL SELECT listing_id, (list_date + 300)::TIMESTAMP, 'Active', list_price, NULL FROM listings UNION ALL SELECT listing_id, (list_date + 600)::TIMESTAMP, status, list_price, sold_price FROM listings),
w AS (SELECT *, lag(st) OVER v AS fs, lag(p) OVER v AS fp, lag(sp) OVER v AS fsp, row_number() OVER v AS n FROM o WINDOW v AS (PARTITION BY listing_id ORDER BY t))
SELECT listing_id, 'new' AS kind, t AS observed_at, st AS status, NULL::VARCHAR AS from_status, p AS price, NULL::DOUBLE AS from_price FROM w WHERE n = 1 UNION ALL SELECT listing_id, 'status_change', t, st, fs, p, NULL FROM w WHERE n > 1 AND st <> fs UNION ALL SELECT listing_id, 'price_change', t, NULL, NULL, p, fp FROM w WHERE n > 1 AND p <> fp
UNION ALL SELECT listing_id, 'sold_price_set', t, NULL, NULL, sp, NULL FROM w WHERE n > 1 AND sp IS NOT NULL AND fsp IS NULL""",
    "event_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM y GROUP BY user_id, g""",
    "day_quantiles": f"{_Q} SELECT * FROM dq",
    "pinball_loss": f"{_Q} SELECT class_id, count(*) AS n, " + ", ".join(f"avg(greatest({p} / 100.0::DOUBLE * (dom - p{p}), ({p} / 100.0::DOUBLE - 1) * (dom - p{p}))) AS loss_{p}, count(*) FILTER (dom <= p{p}) / count(*) AS below_{p}" for p in (25, 50, 75)) + f" FROM s JOIN dq USING (class_id, city, band) WHERE close_date >= DATE '{UNTIL}' GROUP BY 1",
    "pricing_surface": f"{_SURFACE} SELECT * FROM ps",
    "sweet_spots": f"{_SURFACE} SELECT listing_id, max(price) AS price, arg_max(days, price) AS days FROM ps WHERE days <= 90 GROUP BY 1",
}
