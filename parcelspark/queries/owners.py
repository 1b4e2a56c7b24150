"""Owner and parcel products, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import text
from parcelspark.plans import leads as lead_plans
from parcelspark.plans import owners
from parcelspark.sources.bridge import AS_OF, BRIDGE_SQL, PARCELS_SQL, listings, parcels

P = f"WITH {PARCELS_SQL}"
B = BRIDGE_SQL
DAY = f"DATE '{AS_OF}'"
TALK = "2024-01-31"
OUTCOMES = ["left_voicemail", "interested", "not_interested", "signed", "hot", "callback", "cold", "no"]


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with parcels' owners, derived from the events."""
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(e % 5 == 0).select(
        e.alias("contact_id"), F.col("user_id").alias("parcel_id"), F.to_date("ts").alias("contact_date"), F.element_at(F.array(*map(F.lit, OUTCOMES)), (e % 8 + 1).cast("int")).alias("outcome"),
        F.concat(F.lit("mail_"), F.col("event_type")).alias("campaign"),
    )


CONTACTS_SQL = f"contacts AS (SELECT event_id AS contact_id, user_id AS parcel_id, CAST(ts AS DATE) AS contact_date, {OUTCOMES!r}[CAST(event_id % 8 + 1 AS INT)] AS outcome, 'mail_' || event_type AS campaign FROM events WHERE event_id % 5 = 0)"


def over_parcels(product, **more):
    return lambda spark, d: product(parcels(spark, d), **more)


def over_listings(product, **more):
    return lambda spark, d: product(listings(spark, d), **more)


def _scores(spark, d):
    return lead_plans.seller_scores(listings(spark, d), AS_OF)


def _queue(spark, d):
    return owners.call_queue(_scores(spark, d), parcels(spark, d), contacts(spark, d), TALK, 30, ["tenure"])


def _conditions(spark, d):
    return text.with_condition(listings(spark, d).select("listing_id", "remarks"), "remarks").drop("remarks")


def _keys(spark, d):
    names = spark.createDataFrame([("Fiddler's Green",), ("The Villas at Fiddlers Green",), ("N/A",), (" the  Oaks. ",), ("ESTATES AT X-Y",), ("None",)], "name string")
    return names.select("name", text.subdivision_key(F.col("name")).alias("subdivision_key"))


QUERIES = {
    "owner_keys": over_parcels(owners.owner_keys),
    "owner_portfolios": over_parcels(owners.owner_portfolios),
    "investor_portfolios": over_listings(owners.investor_portfolios, as_of=AS_OF),
    "new_builders": over_listings(owners.new_builders, as_of=AS_OF),
    "deed_signals": over_parcels(owners.deed_signals, as_of=AS_OF),
    "flippers": over_parcels(owners.flippers, as_of=AS_OF),
    "probate_signals": over_parcels(owners.probate_signals, year_min=1999),
    "parcel_profile": over_parcels(owners.parcel_profile, as_of=AS_OF),
    "threshold_matrix": over_parcels(owners.threshold_matrix, as_of=AS_OF),
    "top_owners": over_parcels(owners.top_owners),
    "top_mailers": over_parcels(owners.top_mailers),
    "new_investors": over_parcels(owners.new_investors, as_of=AS_OF, years=26, least=2),
    "absentee_leads": over_parcels(owners.absentee_leads, as_of=AS_OF),
    "expired_leads": lambda spark, d: owners.expired_leads(listings(spark, d), listings(spark, d).filter("listing_id % 3 = 0")),
    "detector_leads": over_parcels(owners.leads, as_of=AS_OF),
    "home_inventory": over_parcels(owners.home_inventory),
    "subdivision_report": over_parcels(owners.subdivision_report, as_of=AS_OF),
    "outreach_status": lambda spark, d: owners.annotate_outreach(_scores(spark, d), contacts(spark, d), TALK),
    "campaign_performance": lambda spark, d: owners.campaign_performance(contacts(spark, d)),
    "call_queue": _queue,
    "door_knock_groups": lambda spark, d: owners.door_knock_groups(_queue(spark, d), AS_OF),
    "hot_prospects": lambda spark, d: owners.hot_prospects(contacts(spark, d), TALK),
    "condition_scores": _conditions,
    "subdivision_keys": _keys,
}


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_SUFFIX = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SUFFIXES.items()) + " ELSE w END"
_MAIL = f"regexp_replace(array_to_string(list_filter(list_transform(string_split({squeezed("regexp_replace(upper(coalesce(mail_address, '')), '[.,#]', ' ', 'g')")}, ' '), lambda w: {_SUFFIX}), lambda w: w <> ''), ' '), '-\\d{{4}}\\b', '', 'g')"
_CLASS = f"CASE WHEN coalesce(owner1, '') = '' THEN 'unknown' WHEN regexp_matches(upper(owner1), {q(text.GOVERNMENT)}) THEN 'govt_or_institution' WHEN regexp_matches(upper(owner1), {q(text.BUSINESS)}) THEN 'entity' ELSE 'person' END"
D = f"""{P}, d0 AS (SELECT *, {_CLASS} AS owner_class, {_MAIL} AS mail_key, {squeezed("upper(site_address)")} AS site_key, {squeezed("upper(mail_address)")} AS mail_line, CAST(floor(({DAY} - last_sale_date) / 365) AS INTEGER) AS t FROM parcels),
d AS (SELECT *, CASE WHEN site_key <> '' AND mail_line <> '' THEN site_key = mail_line END AS owner_occupied FROM d0)"""
K = f"""{P}, n AS (SELECT parcel_id, county, owner1, last_sale_date, last_sale_price, {squeezed("regexp_replace(regexp_replace(replace(upper(owner1), '&', ' AND '), '^\\s*C\\s*/\\s*O\\s+', ''), '[^A-Z0-9\\s-]', ' ', 'g')")} AS s FROM parcels),
c AS (SELECT *, CASE WHEN regexp_matches(s, {q(text.ENTITY)}) THEN 'entity' WHEN regexp_matches(s, {q(text.ESTATE)}) THEN 'estate' WHEN contains(' ' || s || ' ', ' TRUST ') THEN 'trust' ELSE 'person' END AS owner_type, trim({squeezed(f"regexp_replace(s, {q(text.ROLES)}, '', 'g')")}, ' -') AS cl FROM n WHERE len(s) >= 3 AND s NOT IN {names(text.NO_OWNER)}),
k AS (SELECT *, CASE owner_type WHEN 'estate' THEN 'EST:' || string_split(regexp_replace(regexp_replace(cl, '^(ESTATE|HEIRS)\\s+OF\\s+', ''), '\\s+(ESTATE|HEIRS)$', ''), ' ')[1] WHEN 'entity' THEN 'ENT:' || {squeezed(f"regexp_replace(cl, {q(text.ENTITY_SUFFIX)}, '', 'g')")}
  WHEN 'trust' THEN 'TRU:' || {squeezed("regexp_replace(cl, '\\bTRUST\\b', '', 'g')")} ELSE 'PER:' || CASE WHEN len(list_filter(string_split(cl, ' '), lambda w: len(w) > 1)) >= 2 THEN array_to_string(list_filter(string_split(cl, ' '), lambda w: len(w) > 1)[1:2], ' ') ELSE cl END END AS canonical_owner_id FROM c)"""


def steps(c: str, *of) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {a} THEN {b}" for a, b in of) + " ELSE 0 END"


_MONEY = steps("sum(assessed)", (2000000, 10), (1000000, 5))
_SCORES = "(SELECT * FROM scores)"

ORACLE = {
    "owner_keys": f"{K} SELECT p.parcel_id, p.county, p.owner1, canonical_owner_id, owner_type, {_CLASS.replace('owner1', 'p.owner1')} AS owner_class FROM parcels p LEFT JOIN k USING (parcel_id)",
    "owner_portfolios": f"""{K}, r AS (SELECT *, row_number() OVER (PARTITION BY canonical_owner_id ORDER BY county, parcel_id) AS r FROM k WHERE canonical_owner_id IS NOT NULL)
SELECT canonical_owner_id, min(owner_type) AS owner_type, min(owner1) AS sample_owner, count(*) AS n_parcels, count(DISTINCT county) AS n_counties, string_agg(DISTINCT county, ';' ORDER BY county) AS counties, string_agg(county || '/' || parcel_id, ';' ORDER BY r) FILTER (r <= 50) AS parcel_ids,
  greatest(0, count(*) - 50) AS parcel_overflow FROM r GROUP BY 1 HAVING count(*) >= 2""",
    "investor_portfolios": f"""{B}, x AS (SELECT *, upper(trim(owner1)) AS owner, coalesce(status = 'Closed' AND close_date >= {DAY} - INTERVAL 24 MONTH, false) AS d FROM listings WHERE owner1 IS NOT NULL AND trim(owner1) <> '')
SELECT owner, count(*) AS total_listings, count(*) FILTER (status = 'Active') AS n_active, count(*) FILTER (status = 'Pending') AS n_pending, count(*) FILTER (d) AS n_closed_24mo, count(*) FILTER (status IN ('Expired/Cancelled', 'Withdrawn')) AS n_expired, sum(sold_price) FILTER (d) AS sold_volume_24mo,
  median(list_price) FILTER (status IN ('Active', 'Pending')) AS active_median_price, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities, string_agg(DISTINCT class_id, ', ' ORDER BY class_id) AS classes_mix,
  CASE WHEN regexp_matches(owner, {q(text.LISTED_ENTITY)}) THEN 'entity' WHEN regexp_matches(owner, '\\b(TRUST|FAMILY|LIVING)\\b') THEN 'trust_or_family' ELSE 'person' END AS owner_type FROM x GROUP BY owner HAVING count(*) >= 2""",
    "new_builders": f"""{B}, x AS (SELECT *, upper(trim(owner1)) AS owner, coalesce(status = 'Closed' AND close_date >= {DAY} - INTERVAL 24 MONTH, false) AS d FROM listings WHERE trim(owner1) <> '')
SELECT owner, count(*) FILTER (d) AS n_closed_24mo, count(*) FILTER (status IN ('Active', 'Pending')) AS n_active_now, median(dom::DOUBLE) FILTER (status = 'Closed') AS dom_median, sum(sold_price) FILTER (d) AS sold_volume, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities,
  string_agg(DISTINCT class_id, ', ' ORDER BY class_id) AS classes FROM x GROUP BY 1 HAVING count(*) FILTER (d) >= 3""",
    "deed_signals": f"{P} SELECT parcel_id, county, last_sale_date >= {DAY} - 730 AS acquisition_within_24mo, last_sale_date >= {DAY} - 730 AND coalesce(last_sale_price BETWEEN 0 AND 1000, false) AS intra_family_transfer_recent_24mo, ({DAY} - last_sale_date) / 365.25::DOUBLE AS tenure_years FROM parcels",
    "flippers": f"""{K}, x AS (SELECT * FROM k WHERE owner_type = 'entity' AND last_sale_date >= {DAY} - 1826), l AS (SELECT canonical_owner_id, list_sort(list(last_sale_price) FILTER (last_sale_price IS NOT NULL)) AS v FROM x GROUP BY 1)
SELECT canonical_owner_id, count(*) AS n_acquisitions_5yr, max(last_sale_date) AS most_recent_acquisition, string_agg(DISTINCT county, ';' ORDER BY county) AS counties, any_value(v[len(v) // 2 + 1]) AS median_acquisition_price FROM x JOIN l USING (canonical_owner_id) GROUP BY 1 HAVING count(*) >= 3""",
    "probate_signals": f"""{P}, x AS (SELECT *, upper(nullif(regexp_extract(owner1, {q(text.PROBATE)}, 0), '')) AS nm, coalesce(last_sale_price <= 1000 AND year(last_sale_date) >= 1999, false) AS z, year_built < 1960 AND assessed >= 200000 AS v FROM parcels)
SELECT parcel_id, county, owner1, year_built, assessed, CAST(CASE WHEN nm IS NULL THEN 0 ELSE 1 END + CASE WHEN z THEN 1 ELSE 0 END + CASE WHEN v THEN 1 ELSE 0 END AS BIGINT) AS score,
  concat_ws(';', 'name:' || nm, CASE WHEN z THEN 'zero_xfer:' || last_sale_date || '@$' || CAST(last_sale_price AS BIGINT) END, CASE WHEN v THEN 'vintage:' || year_built END) AS signals FROM x WHERE nm IS NOT NULL OR z""",
    "parcel_profile": f"""{D}, x AS (SELECT 'owner_class' AS dimension, owner_class AS bucket FROM d UNION ALL SELECT 'occupancy', CASE WHEN site_key = '' THEN 'no_site_addr' WHEN mail_line = '' THEN 'no_mail_addr' WHEN owner_occupied THEN 'owner_occupied' ELSE 'absentee' END FROM d
  UNION ALL SELECT 'sale_decade', coalesce(CAST(year(last_sale_date) // 10 * 10 AS VARCHAR), 'no_sale') FROM d UNION ALL SELECT 'assessed', CAST(CAST(floor(assessed / 100000) AS BIGINT) * 100000 AS VARCHAR) FROM d WHERE assessed <> 0 UNION ALL SELECT 'tenure', CAST(least(t // 5 * 5, 50) AS VARCHAR) FROM d)
SELECT dimension, bucket, count(*) AS n FROM x GROUP BY 1, 2""",
    "threshold_matrix": f"""{D}, x AS (SELECT t, (1 - last_sale_price / assessed) * 100 AS equity FROM d WHERE NOT owner_occupied AND owner_class = 'person' AND last_sale_price > 0 AND assessed > last_sale_price)
SELECT a AS least_tenure, b AS least_equity, count(*) FILTER (t >= a AND equity >= b) AS n FROM x, (VALUES (5, 40), (5, 60), (10, 40), (10, 60), (10, 80), (20, 40), (20, 60)) v(a, b) GROUP BY 1, 2""",
    "top_owners": f"""{D}, r AS (SELECT * FROM d WHERE owner_class = 'person'), m AS (SELECT owner1, mail_address AS primary_mail FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY owner1 ORDER BY count(*) DESC, mail_address) = 1)
SELECT owner1, count(*) AS parcels, sum(assessed) AS total_assessed, count(*) FILTER (owner_occupied) AS owner_occupied, count(*) FILTER (NOT owner_occupied) AS absentee, max(last_sale_date) AS last_acquired, any_value(primary_mail) AS primary_mail FROM r JOIN m USING (owner1) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25""",
    "top_mailers": f"{D} SELECT mail_key, count(*) AS parcels, sum(assessed) AS total_assessed, count(DISTINCT owner1) AS distinct_owner_names, count(*) FILTER (owner_occupied) AS owner_occupied, max(last_sale_date) AS last_acquired FROM d WHERE mail_key <> '' AND owner_class <> 'govt_or_institution' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 30",
    "new_investors": f"""{D}, r AS (SELECT * FROM d WHERE NOT owner_occupied AND mail_key <> '' AND owner_class <> 'govt_or_institution' AND last_sale_date IS NOT NULL), paid AS (SELECT mail_key, sum(last_sale_price) AS total_paid FROM (SELECT DISTINCT mail_key, last_sale_date, last_sale_price FROM r) GROUP BY 1)
SELECT mail_key, count(*) AS parcels, count(DISTINCT site_key) AS sites, count(DISTINCT last_sale_date) AS purchase_dates, min(last_sale_date) AS first_bought, max(last_sale_date) AS last_bought, any_value(total_paid) AS total_paid FROM r JOIN paid USING (mail_key) GROUP BY 1 HAVING count(*) >= 2 AND min(last_sale_date) >= {DAY} - INTERVAL 312 MONTH""",
    "absentee_leads": f"""{D}, x AS (SELECT parcel_id, owner1, assessed, last_sale_price, t AS tenure_years, CASE WHEN assessed > last_sale_price THEN 1 - last_sale_price / assessed ELSE 0.0::DOUBLE END AS equity_ratio FROM d WHERE NOT owner_occupied AND assessed > 0 AND last_sale_price > 0)
SELECT *, CAST(floor(least(tenure_years, 40) + least(1, greatest(0, equity_ratio)) * 60) AS INTEGER) AS score FROM x WHERE tenure_years >= 7 AND equity_ratio >= 0.4""",
    "expired_leads": f"""{B} SELECT listing_id, parcel_id, city, dom, CAST(50 + {steps("dom", (180, 20), (90, 10))} + CASE WHEN list_price < original_list_price THEN 10 ELSE 0 END AS INTEGER) AS score FROM listings l
WHERE status IN ('Expired/Cancelled', 'Withdrawn') AND NOT EXISTS (SELECT 1 FROM listings k WHERE k.listing_id = l.listing_id AND k.listing_id % 3 = 0)""",
    "detector_leads": f"""{D}, con AS (SELECT mail_key || ' @ ' || subdivision AS key, CAST(least(100, 40 + least(40, 8 * count(DISTINCT nullif(site_key, ''))) + CASE WHEN count(*) FILTER (NOT owner_occupied) > count(*) FILTER (owner_occupied) THEN 10 ELSE 0 END + {_MONEY}) AS BIGINT) AS score, count(*) AS parcel_count, sum(assessed) AS total_assessed
  FROM d WHERE owner_class = 'person' AND mail_key <> '' GROUP BY mail_key, subdivision HAVING count(*) >= 3),
ten AS (SELECT CAST(parcel_id AS VARCHAR), CAST(least(100, 40 + greatest(0, 30 - abs(t - 6) * 5) + {steps("assessed", (750000, 20), (500000, 15), (300000, 10), (150000, 5))}) AS BIGINT), 1, assessed FROM d WHERE owner_occupied AND t BETWEEN 3 AND 7),
inh AS (SELECT mail_key || ' @ ' || last_sale_date, CAST(least(100, 40 + least(20, 4 * count(*)) + {steps("sum(assessed)", (2000000, 15), (1000000, 10), (500000, 5))} + CASE WHEN bool_or(contains(upper(owner1), 'ESTATE')) THEN 20 ELSE 0 END + CASE WHEN bool_or(regexp_matches(upper(owner1), 'ETAL|ET AL')) THEN 10 ELSE 0 END
  + CASE WHEN count(DISTINCT nullif(site_key, '')) >= 3 THEN 10 ELSE 0 END) AS BIGINT), count(*), sum(assessed) FROM d WHERE owner_class = 'person' AND coalesce(last_sale_price, 0) = 0 AND mail_key <> '' AND last_sale_date >= {DAY} - INTERVAL 24 MONTH GROUP BY mail_key, last_sale_date HAVING count(*) >= 2),
stu0 AS (SELECT mail_key, site_key, count(*) AS n, sum(assessed) AS a, arg_max((owner1, t, coalesce(last_sale_price, 0)), (last_sale_date, parcel_id)) AS h FROM d WHERE owner_class = 'entity' AND NOT owner_occupied AND t >= 7 AND mail_key <> '' GROUP BY 1, 2),
stu1 AS (SELECT *, CASE WHEN h[3] > 0 AND a > h[3] THEN (1 - h[3] / a) * 100 ELSE 0.0::DOUBLE END AS e FROM stu0), stu AS (SELECT h[1] || ' @ ' || site_key, CAST(least(100, 40 + least(20, h[2]) + floor(least(50, e) / 2) + {steps("a", (500000, 10))} + CASE WHEN n > 1 THEN 5 ELSE 0 END) AS BIGINT), n, a FROM stu1 WHERE e >= 40 OR h[3] <= 0),
emp AS (SELECT CAST(parcel_id AS VARCHAR), CAST(least(100, 30 + {steps("acres", (10, 60), (5, 45), (1, 30), (0.5, 20), (0.25, 10))}) AS BIGINT), 1, assessed FROM d WHERE building_value = 0 AND assessed > 0 AND owner_class = 'person' AND acres >= 0.05)
SELECT *, 'CONCENTRATION' AS category FROM con UNION ALL SELECT *, 'TENURE_SWEET_SPOT' FROM ten UNION ALL SELECT *, 'INHERITANCE_MULTI' FROM inh UNION ALL SELECT *, 'STUDENT_RENTAL_LLC' FROM stu UNION ALL SELECT *, 'EMPTY_LOTS' FROM emp""",
    "home_inventory": f"""{D}, o AS (SELECT parcel_id, mail_key, upper(trim(owner1)) AS o FROM d) SELECT d.parcel_id, owner_class, (SELECT count(*) FROM o WHERE o.mail_key = d.mail_key) - 1 AS same_mail, (SELECT count(*) FROM o WHERE o.o = upper(trim(d.owner1))) - 1 AS same_name,
  (SELECT count(*) FROM o WHERE o.mail_key = d.mail_key OR o.o = upper(trim(d.owner1))) - 1 AS other_properties FROM d WHERE building_value > 0 AND owner_class <> 'govt_or_institution'""",
    "subdivision_report": f"""{D}, m AS (SELECT subdivision, mail_key, count(*) AS k FROM d GROUP BY 1, 2) SELECT d.subdivision, count(*) AS parcels, count(*) FILTER (owner_occupied) AS owner_occupied, count(*) FILTER (NOT owner_occupied) AS absentee, count(*) FILTER (owner_class = 'entity') AS entities, sum(assessed) AS total_assessed,
  median(assessed) AS median_assessed, avg(t) AS mean_tenure, count(*) FILTER (k > 1) AS in_portfolios FROM d JOIN m ON m.subdivision = d.subdivision AND m.mail_key = d.mail_key GROUP BY 1""",
    "campaign_performance": f"""WITH {CONTACTS_SQL} SELECT campaign, count(*) AS contacts, count(DISTINCT parcel_id) AS parcels, count(*) FILTER (outcome IN {names(owners.ANSWERED)}) AS responses, count(*) FILTER (outcome IN {names(owners.WON)}) AS wins, min(contact_date) AS first_contact, max(contact_date) AS last_contact,
  count(*) FILTER (outcome IN {names(owners.ANSWERED)}) / count(*) AS response_rate, count(*) FILTER (outcome IN {names(owners.WON)}) / count(*) AS win_rate FROM contacts GROUP BY 1""",
    "hot_prospects": f"WITH {CONTACTS_SQL} SELECT parcel_id, contact_date, outcome FROM (SELECT * FROM contacts WHERE contact_date BETWEEN DATE '{TALK}' - 30 AND DATE '{TALK}' QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY contact_date DESC, contact_id DESC) = 1) WHERE outcome IN {names(owners.HOT)}",
    "condition_scores": f"""{B}, x AS (SELECT listing_id, remarks, 2.5::DOUBLE + {" + ".join(f"CASE WHEN regexp_matches(remarks, {q('(?i)' + p)}) THEN {w}::DOUBLE ELSE 0 END" for p, w in text.CONDITION.values())} AS s, concat_ws(';', {", ".join(f"CASE WHEN regexp_matches(remarks, {q('(?i)' + p)}) THEN '{k}' END" for k, (p, _) in text.CONDITION.items())}) AS condition_flags FROM listings),
y AS (SELECT *, CASE WHEN remarks <> '' THEN round(least(5, greatest(0, s)), 2) END AS condition_score FROM x)
SELECT listing_id, condition_score, condition_flags, regexp_matches(remarks, {q(text.MANUFACTURED)}) AS is_manufactured, regexp_matches(remarks, {q(text.DISTRESSED)}) AS is_distressed, CASE WHEN condition_score IS NULL THEN '(no remarks)' WHEN condition_score >= 4.5 THEN 'fully renovated' WHEN condition_score >= 3.5 THEN 'well-updated'
  WHEN condition_score >= 2.5 THEN 'average / well-maintained' WHEN condition_score >= 1.5 THEN 'dated / needs cosmetic' ELSE 'distressed / needs work' END AS condition_label FROM y""",
    "subdivision_keys": "SELECT * FROM (VALUES ('Fiddler''s Green', 'FIDDLERS GREEN'), ('The Villas at Fiddlers Green', 'FIDDLERS GREEN'), ('N/A', NULL), (' the  Oaks. ', 'OAKS'), ('ESTATES AT X-Y', 'XY'), ('None', NULL)) t(name, subdivision_key)",
}


def scored(seller_scores: str) -> dict[str, str]:
    """SQL of the products over the seller scores."""
    last = f"last AS (SELECT parcel_id, max(contact_date) AS last_contact_date, arg_max(outcome, (contact_date, contact_id)) AS last_outcome FROM contacts GROUP BY 1)"
    dead = f"(SELECT parcel_id FROM contacts WHERE outcome IN {names([*owners.COLD, *owners.WON])} OR contact_date >= DATE '{TALK}' - 60)"
    queue = f"q AS (SELECT s.*, d.county, d.subdivision, owner_occupied, last_sale_date FROM s JOIN d USING (parcel_id) WHERE s.score >= 30 AND list_contains(string_split(s.signals, ';'), 'tenure') AND owner_class = 'person' AND parcel_id NOT IN {dead})"
    head = f"{D}, s AS ({seller_scores}), {CONTACTS_SQL}"
    return {
        "outreach_status": f"""{head}, {last} SELECT parcel_id, CAST(round_even(score + CASE WHEN last_outcome IS NULL THEN 0 WHEN last_outcome IN {names(owners.HOT)} THEN 15 WHEN last_outcome IN {names(owners.COLD)} THEN -50 WHEN DATE '{TALK}' - last_contact_date < 90 THEN -50 ELSE -5 END, 0) AS BIGINT) AS score,
  CASE WHEN last_outcome IS NULL THEN 'never_contacted' WHEN last_outcome IN {names(owners.HOT)} THEN 'hot:' || last_outcome WHEN last_outcome IN {names(owners.COLD)} THEN 'cold' ELSE 'contacted_' || (DATE '{TALK}' - last_contact_date) || 'd_ago' END AS outreach_status, last_contact_date, last_outcome FROM s LEFT JOIN last USING (parcel_id)""",
        "call_queue": f"{head}, {queue} SELECT * FROM q",
        "door_knock_groups": f"{head}, {queue} SELECT subdivision, count(*) AS n, avg(score) AS avg_score, max(score) AS top_score FROM q WHERE owner_occupied AND ({DAY} - last_sale_date) / 365.25::DOUBLE >= 3 GROUP BY 1",
    }
