"""Ranked search over listings and parcels, asked with the beginnings of addresses, owners and places that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelspark.plans import search
from parcelspark.sources.bridge import BRIDGE_SQL, PARCELS_SQL, listings, parcels

# For every fiftieth parcel: the house number and the beginning of the street; its owner's first letters; or town and subdivision.
ASKED = """CASE parcel_id % 150 WHEN 0 THEN concat(split_part(site_address, ' ', 1), ' ', substring(site_address, 5, 2)) WHEN 50 THEN concat(substring(site_address, 5, 3), ' ', substring(owner1, 1, 3)) ELSE concat(substring(city, 1, 3), ' ', subdivision, ' x') END"""


def _properties(spark, d):
    p = parcels(spark, d)
    return search.properties(listings(spark, d).join(p.select("parcel_id", F.col("site_address").alias("address")), "parcel_id"), p)


def _search(spark, d):
    asked = parcels(spark, d).filter("parcel_id % 50 = 0").select(F.col("parcel_id").alias("query_id"), F.expr(ASKED).alias("query"))
    return search.ranked_search(asked, _properties(spark, d))


QUERIES = {"ranked_search": _search}

_RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in search.STATUS_RANKS.items())
ORACLE = {
    "ranked_search": f"""{BRIDGE_SQL}, {PARCELS_SQL},
ml AS (SELECT l.*, site_address AS address FROM listings l JOIN parcels USING (parcel_id)),
prop AS (SELECT concat('L', listing_id) AS id, 'mls' AS source, CASE lower(status) {_RANKS} ELSE 3 END AS rank0, address, city, county, CAST(parcel_id AS VARCHAR) AS parcel_id, subdivision, NULL AS owner, lower(status) AS status, list_price, CAST(listing_id AS VARCHAR) AS listing_id FROM ml
  UNION ALL SELECT concat('P', parcel_id), 'parcel', 4, site_address, NULL, county, CAST(parcel_id AS VARCHAR), subdivision, owner1, 'off-market', NULL, NULL FROM parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM ml)),
toks AS (SELECT id, source, word FROM (SELECT id, source, unnest(string_split(regexp_replace(lower(concat_ws(' ', address, city, county, subdivision, owner, parcel_id)), '[^a-z0-9]+', ' ', 'g'), ' ')) AS word FROM prop) WHERE word <> ''),
post AS (SELECT id, source, word, count(*) AS tf FROM toks GROUP BY ALL), lens AS (SELECT id, source = 'mls' AS m, count(*) AS n FROM toks GROUP BY ALL),
stats AS (SELECT true AS m, count(*) AS rows, avg(n) AS mean FROM lens WHERE m UNION ALL SELECT false, count(*), avg(n) FROM lens),
t0 AS (SELECT parcel_id AS query_id, unnest(string_split(regexp_replace(lower({ASKED}), '[^a-z0-9]+', ' ', 'g'), ' ')) AS term FROM parcels WHERE parcel_id % 50 = 0),
t AS (SELECT query_id, count(*) OVER (PARTITION BY query_id) AS nt, row_number() OVER () AS i, term FROM t0 WHERE len(term) >= 2),
hit AS (SELECT query_id, nt, i, id, source = 'mls' AS m, sum(tf) AS f FROM t JOIN post ON starts_with(word, term) GROUP BY ALL),
held AS (SELECT query_id, i, count(*) FILTER (m) AS hm, count(*) AS ha FROM hit GROUP BY ALL),
part AS (SELECT query_id, id, nt, f, n, mean, ln((rows - h + 0.5::DOUBLE) / (h + 0.5::DOUBLE)) AS idf FROM (SELECT hit.query_id, hit.id, nt, f, n, mean, rows, CASE WHEN hit.m THEN hm ELSE ha END AS h FROM hit JOIN held USING (query_id, i) JOIN stats ON stats.m = hit.m JOIN lens USING (id))),
sc AS (SELECT query_id, id, round(sum((CASE WHEN idf > 0 THEN idf ELSE 0.000001::DOUBLE END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score FROM part GROUP BY query_id, id, nt HAVING count(*) = nt),
a AS (SELECT query_id, score, prop.* FROM sc JOIN prop USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank0, score DESC, id) <= 32),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, lower(address), lower(county) ORDER BY rank0, score DESC, id) = 1)
SELECT query_id, score, id, source, rank0, address, city, county, parcel_id, status, list_price, listing_id, row_number() OVER (PARTITION BY query_id ORDER BY rank0, score DESC, id) AS place FROM b QUALIFY place <= 8""",
}
