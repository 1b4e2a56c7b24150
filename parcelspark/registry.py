"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelspark.plans import history, leads, valuation
from parcelspark.queries import comps as comp_queries
from parcelspark.queries import criteria as criteria_queries
from parcelspark.queries import feeds as feed_queries
from parcelspark.queries import market as market_queries
from parcelspark.queries import models as model_queries
from parcelspark.queries import owners as owner_queries
from parcelspark.queries import places as place_queries
from parcelspark.queries import regions as region_queries
from parcelspark.queries import resolve as resolve_queries
from parcelspark.queries import search as search_queries
from parcelspark.queries import terrain as terrain_queries
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, DEEDS_SQL, deeds, listings
from parcelspark.streaming import windows

B = BRIDGE_SQL
DAY = f"DATE '{AS_OF}'"
SOLD = "(SELECT * FROM listings WHERE status = 'Closed' AND sold_price > 0 AND list_price > 0 AND close_date IS NOT NULL)"


_on = market_queries.on


def _events(product) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: product(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _confidence(comps: DataFrame) -> DataFrame:
    return valuation.estimate_confidence(leads.comp_estimates(comps), comps)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "portfolios": _on(leads.portfolios),
    "prior_sales": _on(leads.prior_sales),
    "latest_per_parcel": _on(leads.latest_per_parcel),
    "status_delta": _on(leads.status_delta),
    "comp_scores": _on(leads.comp_scores, as_of=AS_OF),
    "comp_estimates": lambda spark, d: leads.comp_estimates(leads.comp_scores(listings(spark, d), AS_OF)),
    "neighbours_of_sales": _on(leads.neighbours_of_sales, as_of=AS_OF),
    "seller_scores": _on(leads.seller_scores, as_of=AS_OF),
    "expired_then_sold": lambda spark, d: history.expired_then_sold(listings(spark, d), deeds(spark, d)),
    "price_trends": lambda spark, d: history.price_trends(listings(spark, d), deeds(spark, d)),
    "sale_history": _on(history.sale_history),
    "expired_unrelisted": _on(history.expired_unrelisted, as_of=AS_OF),
    "saved_search_diff": _on(history.saved_search_diff, as_of=AS_OF, class_id="RE_1", least_price=50_000.0, most_price=300_000.0, least_beds=2),
    "neighbour_outreach": lambda spark, d: history.neighbour_outreach(listings(spark, d), leads.seller_scores(listings(spark, d), AS_OF), AS_OF),
    "adjusted_comps": lambda spark, d: valuation.adjusted_comps(leads.comp_scores(listings(spark, d), AS_OF), listings(spark, d), AS_OF),
    "pending_prices": _on(valuation.pending_prices),
    "backtest": _on(valuation.backtest),
    "size_factor_sweep": _on(valuation.size_factor_sweep),
    "market_context": _on(valuation.market_context, as_of=AS_OF),
    "estimate_confidence": lambda spark, d: _confidence(leads.comp_scores(listings(spark, d), AS_OF)),
    "events_tumbling": _events(windows.tumbling),
    "events_sliding": _events(windows.sliding),
}

_COMPS = f"""{B}, pairs AS (
  SELECT s.listing_id, c.listing_id AS comp_id, c.sold_price, c.sqft AS c_sqft, s.sqft,
    round(100 * exp(-abs(c.sqft - s.sqft) / 600.0::DOUBLE) + 30 * exp(-abs(c.year_built - s.year_built) / 15.0::DOUBLE) + 25 * exp(-abs(c.bedrooms - s.bedrooms) / 1.0::DOUBLE)
      + 70 * exp(-({DAY} - c.close_date) / 180.0::DOUBLE) + CASE WHEN c.subdivision = s.subdivision THEN 50 ELSE 0 END, 6) AS score
  FROM listings s JOIN listings c ON c.city = s.city
  WHERE s.status = 'Active' AND s.class_id = 'RE_1' AND c.status = 'Closed' AND c.class_id = 'RE_1' AND c.close_date >= {DAY} - INTERVAL 18 MONTH
    AND c.sqft BETWEEN 0.75 * s.sqft AND 1.25 * s.sqft AND abs(c.bedrooms - s.bedrooms) <= 1
), comps AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, comp_id) AS comp_rank FROM pairs QUALIFY comp_rank <= 6)"""


ORACLE: dict[str, str] = {
    "portfolios": f"{B} SELECT parcel_id, city, count(*) AS n_sales, sum(sold_price) AS volume, min(close_date) AS first_close, max(close_date) AS last_close FROM listings WHERE status = 'Closed' GROUP BY 1, 2 HAVING count(*) >= 2",
    "prior_sales": f"""{B}, s AS (SELECT listing_id, parcel_id, close_date, sold_price FROM listings WHERE status = 'Closed'),
j AS (SELECT a.listing_id, arg_max((p.close_date, p.sold_price), (p.close_date, p.listing_id)) AS q FROM s a JOIN s p ON p.parcel_id = a.parcel_id AND p.close_date < a.close_date GROUP BY 1),
k AS (SELECT s.*, q[1] AS prior_close_date, q[2] AS prior_sold_price FROM s LEFT JOIN j USING (listing_id))
SELECT *, CASE WHEN (close_date - prior_close_date) / 365.25::DOUBLE > 0.5 THEN pow(sold_price / prior_sold_price, 1 / ((close_date - prior_close_date) / 365.25::DOUBLE)) - 1 END AS growth FROM k""",
    "latest_per_parcel": f"{B} SELECT parcel_id, listing_id, status, list_price, list_date FROM listings QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY list_date DESC, listing_id DESC) = 1",
    "status_delta": f"""{B}, x AS (SELECT parcel_id, listing_id, status, list_price, lag(status) OVER w AS from_status, list_price - lag(list_price) OVER w AS delta FROM listings WINDOW w AS (PARTITION BY parcel_id ORDER BY list_date, listing_id))
SELECT * FROM x WHERE from_status <> status""",
    "comp_scores": f"{_COMPS} SELECT listing_id, CAST(comp_rank AS INTEGER) AS comp_rank, comp_id, sold_price, c_sqft, sqft, score FROM comps",
    "comp_estimates": f"""{_COMPS}, b AS (SELECT listing_id, count(*) AS n, median(sold_price / c_sqft) AS ppsf, max(sqft) AS sqft, min(sold_price) AS low, max(sold_price) AS high, median(sold_price) AS mid FROM comps GROUP BY 1 HAVING count(*) >= 3)
SELECT *, least(1.75::DOUBLE * high, 1.4::DOUBLE * mid, greatest(0.4::DOUBLE * low, ppsf * sqft)) AS estimate FROM b""",
    "neighbours_of_sales": f"""{B}, s AS (SELECT * FROM listings WHERE status = 'Closed' AND close_date > {DAY} - 60 AND close_date <= {DAY}), a AS (SELECT * FROM listings WHERE status = 'Active'),
p AS (SELECT a.listing_id, s.sold_price, 2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(s.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - a.lng) / 2), 2)))) AS miles FROM a, s)
SELECT listing_id, count(*) AS n_sales, min(miles) AS nearest, median(sold_price) AS median_sale FROM p WHERE miles <= 1 GROUP BY 1""",
    "seller_scores": f"""{B}, p AS (SELECT parcel_id, max(close_date) FILTER (status = 'Closed') AS owned_since, count(*) FILTER (status = 'Expired/Cancelled') AS n_expired, max(1 - list_price / original_list_price) AS deepest_cut, min(year_built) AS year_built, min(bedrooms) AS bedrooms FROM listings GROUP BY 1),
q AS (SELECT parcel_id, CASE WHEN ({DAY} - owned_since) / 365.25::DOUBLE < 1.5 THEN -25.0::DOUBLE ELSE least(25.0::DOUBLE, greatest(0.0::DOUBLE, ({DAY} - owned_since) / 365.25::DOUBLE * 5)) END AS t, CASE WHEN n_expired >= 3 THEN 25.0::DOUBLE WHEN n_expired >= 1 THEN 10 ELSE 0 END AS e,
  CASE WHEN deepest_cut >= 0.05 THEN 15.0::DOUBLE ELSE 0 END AS c, CASE WHEN year_built < 1960 THEN 5.0::DOUBLE ELSE 0 END AS o, CASE WHEN bedrooms >= 4 AND year_built < 1975 THEN 15.0::DOUBLE ELSE 0 END AS g FROM p WHERE owned_since IS NOT NULL)
SELECT parcel_id, t + e + c + o + g AS score, concat_ws(';', CASE WHEN t > 0 THEN 'tenure' END, CASE WHEN e > 0 THEN 'expired' END, CASE WHEN c > 0 THEN 'cut' END, CASE WHEN o > 0 THEN 'old_house' END, CASE WHEN g > 0 THEN 'large' END) AS signals FROM q WHERE t + e + c + o + g >= 30""",
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT (date_trunc('day', ts) - INTERVAL 1 DAY * i)::TIMESTAMP AS window_start, count(*) AS n FROM events, range(7) t(i) GROUP BY 1",
}

_PIT = f"""{B}, done AS (SELECT * FROM {SOLD.replace("AND list_price > 0 ", "")} WHERE sqft > 0),
pit AS (SELECT s.listing_id, s.county, s.sqft, s.sold_price, c.sold_price AS c_price, c.sqft AS c_sqft FROM done s JOIN done c ON c.city = s.city AND c.class_id = s.class_id AND c.parcel_id <> s.parcel_id
  AND c.close_date < s.close_date AND c.close_date >= s.close_date - INTERVAL 36 MONTH AND c.sqft >= 0.75::DOUBLE * s.sqft AND c.sqft <= 1.25::DOUBLE * s.sqft)"""

ORACLE |= {
    "expired_then_sold": f"""{B}, {DEEDS_SQL}, last AS (SELECT parcel_id, max(deed_date) AS deed_date, arg_max(deed_price, (deed_date, deed_id)) AS deed_price FROM deeds WHERE deed_price > 5000 GROUP BY 1)
SELECT listing_id, class_id, status, city, list_date, list_date + dom AS off_date, deed_date, deed_price, round(deed_price / original_list_price, 4) AS deed_to_original, CAST(deed_date - (list_date + dom) AS BIGINT) AS days_off_to_deed, CAST(deed_date - list_date AS BIGINT) AS days_listed_to_deed
FROM listings JOIN last USING (parcel_id) WHERE status IN ('Expired/Cancelled', 'Withdrawn') AND deed_date >= list_date + dom""",
    "price_trends": f"""{B}, {DEEDS_SQL}, m AS (SELECT CAST(year(close_date) AS INTEGER) AS year, parcel_id, city, class_id, sold_price AS price FROM listings WHERE status = 'Closed' AND sold_price > 0),
d AS (SELECT CAST(year(deed_date) AS INTEGER) AS year, parcel_id, county AS city, 'DEED' AS class_id, deed_price AS price FROM deeds WHERE arms_length AND deed_price > 5000),
u AS (SELECT *, 'mls' AS source FROM m UNION ALL SELECT *, 'deed' FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.parcel_id = d.parcel_id AND m.year = d.year))
SELECT year, city, class_id, source, count(*) AS n, round(median(price), 0) AS median_sold, round(quantile_cont(price, 0.25), 0) AS p25_sold, round(quantile_cont(price, 0.75), 0) AS p75_sold FROM u GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    "sale_history": f"""{B}, x AS (SELECT DISTINCT parcel_id, CAST(trunc(sold_price) AS BIGINT) AS price, close_date AS sale_date FROM listings WHERE status = 'Closed' AND sold_price > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY sale_date DESC NULLS LAST, price DESC) AS INTEGER) AS place FROM x""",
    "expired_unrelisted": f"""{B}, g AS (SELECT *, list_date + dom AS off_date FROM listings WHERE status = 'Expired/Cancelled' AND list_date + dom <= {DAY} AND list_date + dom > {DAY} - 365)
SELECT parcel_id, listing_id, off_date, list_price, original_list_price, count(*) OVER (PARTITION BY parcel_id) AS n_expired FROM g
WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.parcel_id = g.parcel_id AND l.status IN ('Active', 'Pending')) QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY off_date DESC, listing_id DESC) = 1
  AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.parcel_id = g.parcel_id AND l.list_date > g.off_date)""",
    "saved_search_diff": f"""{B}, f AS (SELECT * FROM listings WHERE class_id = 'RE_1' AND list_price BETWEEN 50000 AND 300000 AND bedrooms >= 2),
cur AS (SELECT listing_id FROM f WHERE list_date <= {DAY} AND list_date + dom > {DAY}), prev AS (SELECT listing_id FROM f WHERE list_date <= {DAY} - 30 AND list_date + dom > {DAY} - 30),
c AS (SELECT listing_id, 'NEW' AS change FROM (SELECT * FROM cur EXCEPT SELECT * FROM prev) UNION ALL SELECT listing_id, 'DROPPED' FROM (SELECT * FROM prev EXCEPT SELECT * FROM cur))
SELECT listing_id, parcel_id, city, list_price, change FROM c JOIN f USING (listing_id)""",
    "neighbour_outreach": f"""{B}, ss AS ({ORACLE["seller_scores"]}), s AS (SELECT * FROM listings WHERE status = 'Closed' AND sold_price > 0 AND close_date BETWEEN {DAY} - 14 AND {DAY}),
n AS (SELECT DISTINCT ss.parcel_id AS neighbour, ss.score, l.subdivision FROM ss JOIN listings l USING (parcel_id) WHERE ss.score >= 30 AND ss.parcel_id NOT IN (SELECT parcel_id FROM listings WHERE status IN ('Active', 'Pending')))
SELECT s.listing_id, s.close_date, s.sold_price, neighbour, n.score, 0.0::DOUBLE AS miles, CAST(row_number() OVER (PARTITION BY s.listing_id ORDER BY n.score DESC, neighbour) AS INTEGER) AS place FROM s JOIN n ON n.subdivision = s.subdivision AND neighbour <> s.parcel_id QUALIFY place <= 5""",
    "adjusted_comps": f"""{_COMPS}, rates AS (SELECT city, class_id, round(median(sold_price / sqft), 2) AS ps, round(median(sold_price) * 0.004::DOUBLE, 0) AS py, round(median(sold_price / nullif(acres, 0)), 0) AS pa FROM listings WHERE status = 'Closed' AND sold_price > 0 AND sqft > 0 AND close_date >= {DAY} - 1095 GROUP BY 1, 2),
a AS (SELECT k.listing_id, k.comp_id, k.sold_price, (s.sqft - c.sqft) * coalesce(ps, 200) AS adj_sqft, (s.year_built - c.year_built) * coalesce(py, 1200) AS adj_age, CASE WHEN s.acres <> 0 AND c.acres <> 0 THEN (s.acres - c.acres) * coalesce(pa, 50000) ELSE 0 END AS adj_acres
  FROM comps k JOIN listings s ON s.listing_id = k.listing_id JOIN listings c ON c.listing_id = k.comp_id LEFT JOIN rates r ON r.city = s.city AND r.class_id = s.class_id),
g AS (SELECT *, adj_sqft + adj_age + adj_acres AS gross FROM a) SELECT *, abs(gross) > sold_price * 0.2::DOUBLE AS capped, sold_price + least(sold_price * 0.2::DOUBLE, greatest(-sold_price * 0.2::DOUBLE, gross)) AS adjusted_price FROM g""",
    "pending_prices": f"""{B}, c AS (SELECT city, class_id, list_sort(list(sold_price / original_list_price)) AS r FROM listings WHERE status = 'Closed' AND sold_price > 0 AND original_list_price > 0 AND sold_price / original_list_price > 0.5 AND sold_price / original_list_price < 1.5 GROUP BY 1, 2),
p AS (SELECT l.*, coalesce(r[len(r) // 2 + 1], 0.98::DOUBLE) AS pool_ratio FROM listings l LEFT JOIN c USING (city, class_id) WHERE status = 'Pending' AND list_price > 0)
SELECT listing_id, city, class_id, list_price, pool_ratio, list_price * pool_ratio AS expected_price, list_date AS as_close_date FROM p""",
    "backtest": f"""{_PIT}, per AS (SELECT listing_id, county, sold_price, median(c_price / c_sqft) * sqft AS e, min(c_price / c_sqft) * sqft AS lo, max(c_price / c_sqft) * sqft AS hi FROM pit GROUP BY listing_id, county, sold_price, sqft),
x AS (SELECT *, (e - sold_price) / sold_price AS signed, abs(e - sold_price) AS off FROM per)
SELECT county, count(*) AS n, median(abs(signed)) AS median_ape, avg(abs(signed)) AS mape, avg(off) AS mae, median(off) AS median_abs_error, count(*) FILTER (abs(signed) <= 0.10) / count(*) AS ppe10, count(*) FILTER (abs(signed) <= 0.20) / count(*) AS ppe20,
  count(*) FILTER (sold_price BETWEEN lo AND hi) / count(*) AS coverage, median(signed) AS median_signed, avg(signed) AS mean_signed FROM x GROUP BY ROLLUP (county)""",
    "size_factor_sweep": f"""{_PIT}, e AS (SELECT listing_id, county, sold_price, factor, median(c_price / c_sqft * pow(c_sqft / sqft, factor)) * sqft AS e FROM pit, (SELECT i / 8.0::DOUBLE AS factor FROM range(5) t(i)) GROUP BY listing_id, county, sold_price, factor, sqft)
SELECT county, factor, count(*) AS n, round(median(abs(e / sold_price - 1)), 9) AS median_ape FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY county ORDER BY median_ape, factor) = 1""",
    "market_context": f"""{B}, x AS (SELECT *, coalesce(status = 'Closed' AND sold_price > 0 AND close_date BETWEEN {DAY} - INTERVAL 12 MONTH AND {DAY}, false) AS y FROM listings),
s AS (SELECT county, subdivision, count(*) FILTER (y) AS n, count(*) FILTER (status = 'Active') AS a, median(sold_price) FILTER (y) AS m FROM x GROUP BY 1, 2), w AS (SELECT county, count(*) FILTER (y) AS n, count(*) FILTER (status = 'Active') AS a, median(sold_price) FILTER (y) AS m FROM x GROUP BY 1),
p AS (SELECT s.county, s.subdivision, 'subdivision' AS scope, s.n, s.a, s.m FROM s WHERE s.n >= 5 UNION ALL SELECT s.county, s.subdivision, 'county', w.n, w.a, w.m FROM s JOIN w USING (county) WHERE s.n < 5)
SELECT county, subdivision, scope, n AS closed_12m, a AS active, m AS median_sold, a::DOUBLE / nullif(n / 12.0::DOUBLE, 0) AS months_of_inventory FROM p""",
    "estimate_confidence": f"""WITH e AS ({ORACLE["comp_estimates"]}), c AS ({ORACLE["comp_scores"]}), q AS (SELECT listing_id, (quantile_cont(sold_price / c_sqft, 0.75) - quantile_cont(sold_price / c_sqft, 0.25)) / median(sold_price / c_sqft) AS spread FROM c GROUP BY 1),
h AS (SELECT listing_id, n, estimate, spread, estimate * least(0.15::DOUBLE, greatest(0.03::DOUBLE, spread / 2)) AS half FROM e JOIN q USING (listing_id))
SELECT listing_id, n, estimate, spread, CASE WHEN n >= 5 AND spread <= 0.25 THEN 'high' WHEN n >= 3 AND spread <= 0.6 THEN 'medium' ELSE 'low' END AS confidence, estimate - half AS band_low, estimate + half AS band_high FROM h""",
}

for group in (market_queries, owner_queries, comp_queries, place_queries, model_queries, search_queries, terrain_queries, criteria_queries, region_queries, resolve_queries, feed_queries):
    QUERIES |= group.QUERIES
    ORACLE |= group.ORACLE
ORACLE |= terrain_queries.with_comps(_PIT)
ORACLE |= owner_queries.scored(ORACLE["seller_scores"])
