"""Market reports over the bridge view, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.plans import leads, market
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, listings, price_bands

B = BRIDGE_SQL
DAY = f"DATE '{AS_OF}'"
SOLD = "(SELECT * FROM listings WHERE status = 'Closed' AND sold_price > 0 AND list_price > 0 AND close_date IS NOT NULL)"


def banded(price: str) -> str:
    return f"LEFT JOIN bands b ON b.class_id = l.class_id AND l.{price} >= b.lo AND l.{price} < b.hi"


def on(product, bands: bool = False, **more) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return product(listings(spark, sf_dir), *([price_bands(spark)] if bands else []), **more)

    return run


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents from the suppliers, offices from the nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    agents = read("supplier").select(F.col("s_suppkey").alias("agent_key"), F.trim("s_name").alias("agent_name"), F.col("s_nationkey").alias("office_key"))
    offices = read("nation").select(F.col("n_nationkey").alias("office_key"), F.trim("n_name").alias("office_name"))
    return market.agent_directory(market.ranking(listings(spark, sf_dir), AS_OF, "agent_id", 10), agents, offices)


QUERIES = {
    "dom_by_cohort": on(market.dom_by_cohort, True),
    "dom_by_subdivision": on(market.dom_by_subdivision),
    "spread": on(market.spread, True, year_min=1995),
    "velocity": on(market.velocity, as_of=AS_OF),
    "price_cuts": on(market.price_cuts, year_min=1998),
    "cut_waterfall": on(market.cut_waterfall, True, year_min=1998),
    "laggards": on(market.laggards, True, year_min=1997),
    "fast_sellers": on(market.fast_sellers, True, year_min=1995),
    "office_ranking": on(market.ranking, as_of=AS_OF, who="office_id", least=20),
    "agent_ranking": on(market.ranking, as_of=AS_OF, who="agent_id", least=10),
    "agent_directory": _directory,
    "neighborhoods": on(market.neighborhoods, as_of=AS_OF),
    "market_index": on(market.market_index),
    "market_index_ratio": lambda spark, d: market.index_ratio(market.market_index(listings(spark, d)), 12, 4),
    "market_index_as_of": on(market.market_index, as_of="2000-06-15"),
    "heatmap": on(market.heatmap, as_of=AS_OF),
    "prior_period_kpis": on(market.prior_period_kpis, start="2001-04-01", end="2001-07-01", before="2001-01-01"),
    "filled_prices": on(market.fixed_spine, as_of=AS_OF),
    "price_histogram": on(market.histogram),
    "price_percentile": on(market.percent_rank),
    "expiring_soon": on(market.expiring_soon, as_of=AS_OF),
    "buyer_portal": on(market.buyer_portal),
    "subdivision_pages": on(market.subdivision_pages, as_of=AS_OF),
    "price_trend": on(market.price_trend, as_of=AS_OF),
    "expired_watchlist": on(leads.expired_watchlist, as_of=AS_OF),
}


def _ranking(who: str, least: int) -> str:
    classes = ", ".join(f"count(*) FILTER (sale AND class_id = '{c}') AS n_{c[:2].lower()}" for c in ("RE_1", "LD_3", "MF_2", "CM_4", "FM_5", "RN_6"))
    return f"""{B}, base AS (SELECT *, coalesce(CAST({who} AS VARCHAR), '(unknown)') AS grp, status = 'Closed' AND sold_price > 0 AS sale FROM listings WHERE (status = 'Closed' AND close_date >= {DAY} - 730) OR (status IN ('Expired/Cancelled', 'Withdrawn') AND off_market_date >= {DAY} - 730)),
modes AS (SELECT grp, city, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, city) AS r FROM base WHERE status = 'Closed' GROUP BY grp, city),
a AS (SELECT grp, count(*) FILTER (sale) AS closed_n, sum(sold_price) FILTER (sale) AS dollar_volume, avg(sold_price) FILTER (sale) AS avg_sold, median(sold_price) FILTER (sale) AS median_sold, median(dom::DOUBLE) FILTER (sale) AS dom_median,
  quantile_cont(dom::DOUBLE, 0.25) FILTER (sale) AS dom_p25, median(100 * sold_price / original_list_price) FILTER (sale) AS pct_of_orig_list, count(*) FILTER (status <> 'Closed') AS expired_n, {classes} FROM base GROUP BY 1)
SELECT a.*, m.city AS top_city, expired_n / (closed_n + expired_n) AS expiry_rate FROM a LEFT JOIN modes m ON m.grp = a.grp AND m.r = 1 WHERE closed_n >= {least}"""


_MONTHLY = f"""{B}, m AS (SELECT county, CAST(year(close_date) * 12 + month(close_date) - 1 AS INTEGER) AS m, median(sold_price / sqft) AS median_ppsf, count(*) AS n_sales FROM listings
  WHERE status = 'Closed' AND class_id = 'RE_1' AND sqft > 200 AND sold_price >= 80000 AND close_date < DATE '{{end}}' GROUP BY 1, 2),
idx AS (SELECT *, sum(median_ppsf * n_sales) OVER w / sum(n_sales) OVER w AS smoothed_ppsf FROM (SELECT * FROM m WHERE m.m > (SELECT max(m) FROM m) - 48) WINDOW w AS (PARTITION BY county ORDER BY m RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""

ORACLE = {
    "dom_by_cohort": f"""{B} SELECT CAST(year(close_date) AS INTEGER) AS sale_year, l.class_id, city, band, count(*) AS n, median(dom::DOUBLE) AS median_dom, quantile_cont(dom::DOUBLE, 0.25) AS p25_dom,
  quantile_cont(dom::DOUBLE, 0.75) AS p75_dom, median(sold_price) AS median_sold FROM {SOLD} l {banded("list_price")} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    "dom_by_subdivision": f"{B} SELECT city, subdivision, class_id, count(*) AS n, median(dom::DOUBLE) AS median_dom, median(sold_price) AS median_sold FROM {SOLD} GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "spread": f"""{B}, x AS (SELECT l.*, band, CAST(year(close_date) AS INTEGER) AS close_year, (sold_price - original_list_price) / original_list_price * 100 AS gap FROM listings l {banded("original_list_price")}
  WHERE status = 'Closed' AND sold_price > 0 AND original_list_price > 0 AND close_date IS NOT NULL)
SELECT close_year, class_id, city, band, count(*) AS n, median(gap) AS median_spread_pct, quantile_cont(gap, 0.25) AS p25_spread_pct, quantile_cont(gap, 0.75) AS p75_spread_pct, median(original_list_price) AS median_original_price, median(sold_price) AS median_sold_price,
  sum(CASE WHEN sold_price >= original_list_price THEN 1 ELSE 0 END) / count(*) AS pct_at_or_over_ask FROM x WHERE close_year >= 1995 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""",
    "velocity": f"""{B}, active AS (SELECT class_id, city, count(*) AS active_n FROM listings WHERE status = 'Active' GROUP BY 1, 2),
y AS (SELECT class_id, city, count(*) AS closed_12mo, median(dom::DOUBLE) AS dom_median_12mo FROM listings WHERE status = 'Closed' AND close_date >= {DAY} - INTERVAL 365 DAY GROUP BY 1, 2),
q AS (SELECT class_id, city, count(*) AS closed_90d, median(dom::DOUBLE) AS dom_median_90d, median(sold_price / nullif(original_list_price, 0) * 100) AS pct_of_orig_list_90d FROM listings WHERE status = 'Closed' AND close_date >= {DAY} - INTERVAL 90 DAY GROUP BY 1, 2),
e AS (SELECT class_id, city, count(*) AS expired_12mo FROM listings WHERE status IN ('Expired/Cancelled', 'Withdrawn') AND off_market_date >= {DAY} - INTERVAL 365 DAY GROUP BY 1, 2),
j AS (SELECT *, active_n / nullif(closed_12mo / 12.0::DOUBLE, 0) AS months_of_inventory, expired_12mo / nullif(expired_12mo + closed_12mo, 0) AS expiry_rate_12mo FROM active LEFT JOIN y USING (class_id, city) LEFT JOIN q USING (class_id, city) LEFT JOIN e USING (class_id, city) WHERE coalesce(closed_12mo, 0) >= 5)
SELECT *, CASE WHEN months_of_inventory < 1.5 THEN 'extreme seller' WHEN months_of_inventory < 3 THEN 'strong seller' WHEN months_of_inventory < 6 THEN 'balanced' WHEN months_of_inventory < 9 THEN 'soft buyer' ELSE 'strong buyer' END AS market_label FROM j""",
    "price_cuts": f"""{B} SELECT listing_id, class_id, city, subdivision, original_list_price, list_price, sold_price, list_price - original_list_price AS list_cut_dollars, (list_price - original_list_price) / original_list_price * 100 AS list_cut_pct,
  sold_price - original_list_price AS net_total_cut, (sold_price - original_list_price) / original_list_price * 100 AS net_total_cut_pct, list_date, close_date, dom, office_id FROM listings
WHERE status = 'Closed' AND close_date >= DATE '1998-01-01' AND original_list_price > 0 AND list_price < original_list_price""",
    "cut_waterfall": f"""{B}, x AS (SELECT l.*, band, list_price < original_list_price AS cut FROM listings l {banded("original_list_price")} WHERE status = 'Closed' AND sold_price > 0 AND close_date >= DATE '1998-01-01' AND original_list_price > 0)
SELECT class_id, city, band, count(*) AS n, count(*) FILTER (cut) AS n_with_list_cut, count(*) FILTER (cut) / count(*) AS pct_with_list_cut, median(list_price - original_list_price) FILTER (cut) AS median_list_cut_dollars,
  median((list_price - original_list_price) / original_list_price * 100) FILTER (cut) AS median_list_cut_pct, median(dom::DOUBLE) FILTER (cut) AS median_dom_with_cut, median(dom::DOUBLE) FILTER (NOT cut) AS median_dom_no_cut,
  median((sold_price - original_list_price) / original_list_price * 100) AS median_net_off_orig_pct FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
    "laggards": f"""{B}, x AS (SELECT l.*, band, CAST(year(coalesce(close_date, off_market_date, list_date)) AS INTEGER) AS year_event FROM listings l {banded("original_list_price")} WHERE list_date >= DATE '1997-01-01'),
c AS (SELECT year_event, class_id, city, band, count(*) AS cohort_n, quantile_cont(dom::DOUBLE, 0.75) AS cohort_p75_dom, median(dom::DOUBLE) AS cohort_median_dom FROM x WHERE status = 'Closed' AND sold_price > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
SELECT listing_id, x.year_event, x.class_id, x.city, x.band, status, list_date, list_price, original_list_price, sold_price, dom, sold_price / nullif(original_list_price, 0) AS sold_to_original, cohort_p75_dom, cohort_median_dom, cohort_n,
  CASE WHEN status IN ('Expired/Cancelled', 'Withdrawn') THEN 'didnt_sell' WHEN sold_price < 0.95::DOUBLE * original_list_price THEN 'price_cut_5pct' ELSE 'over_p75_dom' END AS reason
FROM x LEFT JOIN c USING (year_event, class_id, city, band) WHERE status IN ('Expired/Cancelled', 'Withdrawn') OR (status = 'Closed' AND sold_price < 0.95::DOUBLE * original_list_price) OR (status = 'Closed' AND cohort_p75_dom IS NOT NULL AND dom > cohort_p75_dom)""",
    "fast_sellers": f"""{B}, x AS (SELECT l.*, band, CAST(year(close_date) AS INTEGER) AS close_year FROM listings l {banded("list_price")} WHERE status = 'Closed' AND sold_price > 0 AND close_date IS NOT NULL),
c AS (SELECT close_year, class_id, city, band, count(*) AS cohort_n, quantile_cont(dom::DOUBLE, 0.25) AS cohort_p25_dom, median(dom::DOUBLE) AS cohort_median_dom, median(sold_price / nullif(original_list_price, 0)) AS cohort_median_sold_to_orig FROM x WHERE close_year >= 1995 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
SELECT listing_id, x.close_year, x.class_id, x.city, x.band, list_date, close_date, dom, list_price, original_list_price, sold_price, sold_price / nullif(original_list_price, 0) AS sold_to_original, cohort_p25_dom, cohort_median_dom, cohort_n, cohort_median_sold_to_orig
FROM x JOIN c USING (close_year, class_id, city, band) WHERE dom <= cohort_p25_dom""",
    "office_ranking": _ranking("office_id", 20),
    "agent_ranking": _ranking("agent_id", 10),
    "agent_directory": f"""SELECT r.*, trim(s_name) AS agent_name, trim(n_name) AS office_name FROM ({_ranking("agent_id", 10)}) r LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = r.grp LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = CAST(s_nationkey AS VARCHAR)""",
    "neighborhoods": f"""{B}, c AS (SELECT *, close_date >= {DAY} - INTERVAL 12 MONTH AS y, close_date >= {DAY} - INTERVAL 6 MONTH AS h FROM listings WHERE status = 'Closed'),
s AS (SELECT city, subdivision, count(*) FILTER (y) AS closes_12mo, count(*) FILTER (h) AS closes_6mo, count(*) FILTER (y AND NOT h) AS closes_prior_6mo, count(*) AS closes_all_time, sum(sold_price) FILTER (y) AS volume_12mo, avg(dom) FILTER (y) AS avg_dom,
  median(sold_price) FILTER (y) AS median_price, avg(sold_price * 100 / nullif(original_list_price, 0)) FILTER (y) AS avg_list_to_sale_pct, avg(lat) AS centroid_lat, avg(lng) AS centroid_lng FROM c GROUP BY 1, 2 HAVING closes_12mo >= 3 OR closes_all_time >= 10),
p AS (SELECT city, list_sort(list(closes_12mo)) AS l FROM s GROUP BY 1),
o AS (SELECT city, subdivision, office_id AS top_office, count(*) AS top_office_closes, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY city, subdivision) AS top_office_share_pct, row_number() OVER (PARTITION BY city, subdivision ORDER BY count(*) DESC, office_id) AS r FROM c WHERE y GROUP BY 1, 2, 3),
a AS (SELECT city, subdivision, agent_id, count(*) AS k, row_number() OVER (PARTITION BY city, subdivision ORDER BY count(*) DESC, agent_id) AS r FROM c WHERE y GROUP BY 1, 2, 3),
t AS (SELECT city, subdivision, string_agg(agent_id || ':' || k, ',' ORDER BY r) AS top_agents FROM a WHERE r <= 3 GROUP BY 1, 2)
SELECT s.*, CASE WHEN closes_prior_6mo > 0 THEN closes_6mo / closes_prior_6mo WHEN closes_6mo > 0 THEN 99.0::DOUBLE ELSE 0.0::DOUBLE END AS velocity_trend, closes_12mo >= greatest(l[CAST(floor(len(l) * 0.75::DOUBLE) AS INT) + 1], 3) AS is_hot,
  top_office, top_office_closes, top_office_share_pct::DOUBLE AS top_office_share_pct, top_agents FROM s JOIN p USING (city) LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (city, subdivision) LEFT JOIN t USING (city, subdivision)""".replace("o.r", "r"),
    "market_index": _MONTHLY.format(end="9999-01-01") + " SELECT * FROM idx",
    "market_index_as_of": _MONTHLY.format(end="2000-06-15") + " SELECT * FROM idx",
    "market_index_ratio": _MONTHLY.format(end="9999-01-01") + " SELECT a.county, a.m, CASE WHEN a.n_sales >= 4 AND b.n_sales >= 4 THEN a.smoothed_ppsf / b.smoothed_ppsf END AS ratio FROM idx a LEFT JOIN idx b ON b.county = a.county AND b.m = a.m - 12",
    "heatmap": f"""{B}, c AS (SELECT * FROM listings WHERE status = 'Closed' AND close_date >= {DAY} - INTERVAL 12 MONTH AND sold_price > 0), a AS (SELECT city, class_id, count(*) AS n_active FROM listings WHERE status = 'Active' GROUP BY 1, 2)
SELECT city, class_id, count(*) AS n_closed, median(sold_price) AS med_sold, median(dom::DOUBLE) AS med_dom, median(sold_price / nullif(original_list_price, 0) * 100) AS sold_pct, sum(CASE WHEN list_price < original_list_price * 0.97::DOUBLE THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS cut_pct,
  coalesce(any_value(n_active), 0) AS n_active, coalesce(any_value(n_active), 0) / (count(*) / 12.0::DOUBLE) AS months_inv FROM c LEFT JOIN a USING (city, class_id) GROUP BY 1, 2 HAVING count(*) >= 5""",
    "prior_period_kpis": f"""{B}, x AS (SELECT *, close_date >= DATE '2001-04-01' AND close_date < DATE '2001-07-01' AS cur, close_date >= DATE '2001-01-01' AND close_date < DATE '2001-04-01' AS old FROM {SOLD})
SELECT county, count(*) FILTER (cur) AS sales, count(*) FILTER (old) AS prior_sales, sum(sold_price) FILTER (cur) AS volume, median(sold_price) FILTER (cur) AS median_sold, median(sold_price) FILTER (old) AS prior_median_sold FROM x GROUP BY 1 HAVING count(*) FILTER (cur OR old) > 0""",
    "filled_prices": f"""{B}, z AS (SELECT county, CAST(year(close_date) * 12 + month(close_date) - 1 AS INTEGER) AS m, sold_price FROM {SOLD}), k AS (SELECT * FROM z WHERE m BETWEEN 2001 * 12 + 7 - 11 AND 2001 * 12 + 7),
r AS (SELECT county, m, median(sold_price) AS median_sold FROM k GROUP BY 1, 2), o AS (SELECT county, median(sold_price) AS overall FROM k GROUP BY 1),
s AS (SELECT county, CAST(i AS INTEGER) AS m FROM (SELECT DISTINCT county FROM listings), range(2001 * 12 + 7 - 11, 2001 * 12 + 7 + 1) t(i)),
f AS (SELECT s.county, s.m, r.median_sold, coalesce(last_value(r.median_sold IGNORE NULLS) OVER (PARTITION BY s.county ORDER BY s.m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), overall) AS filled FROM s LEFT JOIN r ON r.county = s.county AND r.m = s.m LEFT JOIN o ON o.county = s.county)
SELECT *, avg(filled) OVER (PARTITION BY county ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM f""",
    "price_histogram": f"""{B}, x AS (SELECT county, sold_price AS x FROM {SOLD} WHERE class_id = 'RE_1'), l AS (SELECT county, list_sort(list(x)) AS v FROM x GROUP BY 1), e AS (SELECT county, v[CAST(floor(len(v) * 0.01::DOUBLE) AS INT) + 1] AS lo, v[CAST(floor(len(v) * 0.99::DOUBLE) AS INT) + 1] AS hi FROM l)
SELECT county, CAST(CASE WHEN hi > lo THEN least(23, greatest(0, floor((x - lo) / ((hi - lo) / 24)))) ELSE 0 END AS INTEGER) AS bin, lo, hi, count(*) AS n FROM x JOIN e USING (county) GROUP BY ALL""",
    "price_percentile": f"""{B}, s AS (SELECT city, class_id, list(sold_price) AS v FROM {SOLD} GROUP BY 1, 2)
SELECT listing_id, city, class_id, CAST(CASE WHEN v IS NULL THEN 50 ELSE (200 * len(list_filter(v, lambda x: x < list_price)) + len(v)) // (2 * len(v)) END AS INTEGER) AS percentile FROM listings LEFT JOIN s USING (city, class_id) WHERE status = 'Active'""",
    "expiring_soon": f"{B} SELECT listing_id, city, class_id, list_price, list_date + 180 AS expiration_date, CAST(list_date + 180 - {DAY} AS BIGINT) AS days_until_expiry FROM listings WHERE status = 'Active' AND list_date + 180 BETWEEN {DAY} AND {DAY} + 60",
    "buyer_portal": f"{B} SELECT listing_id, status, city, class_id, list_price, bedrooms, full_baths, sqft, acres FROM listings WHERE status IN ('Active', 'Pending') AND list_price > 0",
    "subdivision_pages": f"""{B}, x AS (SELECT *, coalesce(status = 'Closed' AND sold_price > 0 AND close_date >= {DAY} - INTERVAL 36 MONTH, false) AS d FROM listings)
SELECT county, subdivision, count(*) FILTER (d) AS sales, median(sold_price) FILTER (d) AS median_sold, min(sold_price) FILTER (d) AS least_sold, max(sold_price) FILTER (d) AS most_sold, median(sold_price / nullif(sqft, 0)) FILTER (d) AS median_ppsf, count(*) FILTER (status = 'Active') AS active,
  median(list_price) FILTER (status = 'Active') AS median_asked, median(dom::DOUBLE) FILTER (d) AS median_dom FROM x GROUP BY 1, 2 HAVING count(*) FILTER (d OR status = 'Active') > 0""",
    "price_trend": f"""{B}, x AS (SELECT city, sold_price, close_date >= {DAY} - INTERVAL 6 MONTH AS new FROM {SOLD} WHERE close_date >= {DAY} - INTERVAL 12 MONTH AND close_date < {DAY}),
a AS (SELECT city, count(*) FILTER (new) AS n_recent, count(*) FILTER (NOT new) AS n_older, median(sold_price) FILTER (new) AS recent, median(sold_price) FILTER (NOT new) AS older FROM x GROUP BY 1),
c AS (SELECT *, CASE WHEN n_recent >= 3 AND n_older >= 3 THEN recent / older - 1 END AS change FROM a) SELECT *, CASE WHEN change IS NULL THEN NULL WHEN change > 0.01 THEN 'up' WHEN change < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM c""",
    "expired_watchlist": f"""{B}, g AS (SELECT *, coalesce(off_market_date, list_date) AS ev FROM listings WHERE status IN ('Expired/Cancelled', 'Withdrawn') AND coalesce(off_market_date, list_date) <= {DAY}),
p AS (SELECT parcel_id, max(city) AS city, max(owner1) AS owner1, max(assessed) AS assessed, count(*) AS n_expirations, max(ev) AS last_off_date, arg_max(list_price, (ev, listing_id)) AS final_list_price, arg_max(original_list_price, (ev, listing_id)) AS final_original_price,
  arg_max(list_date, (ev, listing_id)) AS final_list_date, arg_max(office_id, (ev, listing_id)) AS final_office, arg_max(listing_id, (ev, listing_id)) AS final_listing_id FROM g GROUP BY 1),
s AS (SELECT *, CAST({DAY} - last_off_date AS BIGINT) AS days_off, CAST(last_off_date - final_list_date AS BIGINT) AS days_on_market, (final_original_price - final_list_price) / nullif(final_original_price, 0) * 100 AS pct_cut_off_orig FROM p WHERE last_off_date >= {DAY} - 30),
t AS (SELECT *, CAST(CASE WHEN days_off <= 7 THEN 20 WHEN days_off <= 30 THEN 10 ELSE 0 END + CASE WHEN n_expirations >= 2 THEN 15 ELSE 0 END + CASE WHEN round(pct_cut_off_orig, 6) >= 10 THEN 10 ELSE 0 END + CASE WHEN final_list_price - assessed >= 100000 THEN 10 ELSE 0 END + CASE WHEN days_off BETWEEN 10 AND 21 THEN 5 ELSE 0 END AS INTEGER) AS score FROM s)
SELECT *, CASE WHEN days_off <= 7 AND score >= 30 THEN 'call_within_72hr' WHEN n_expirations >= 2 THEN 'send_relist_pitch_letter' WHEN days_off <= 30 THEN 'send_followup_postcard' ELSE 'add_to_quarterly_drip' END AS next_step
FROM t WHERE score >= 10 AND parcel_id NOT IN (SELECT parcel_id FROM listings WHERE status IN ('Active', 'Pending'))""",
}
