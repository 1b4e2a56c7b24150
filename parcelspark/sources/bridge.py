"""Listings derived from the order tables by fixed integer arithmetic, and the price-band dimension.

Every product takes a listings DataFrame; this one stands in for a feed where only the order tables exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-02"
OPEN = 1e15
# Lower bounds of the price bands of each class, in thousands of dollars.
HOMES = [0, 100, 150, 200, 250, 300, 350, 400, 500, 600, 750, 1000, 1500]
LAND = [0, 25, 50, 75, 100, 150, 200, 300, 500, 1000]
BUSINESS = [0, 100, 250, 500, 1000, 2500, 5000]
BANDS = {"RE_1": HOMES, "MF_2": HOMES, "LD_3": LAND, "CM_4": BUSINESS, "FM_5": BUSINESS, "RN_6": HOMES}


def band_rows() -> list[tuple[str, float, float, str]]:
    """(class, lower bound, upper bound, label); the top band is open."""
    out = []
    for name, lows in BANDS.items():
        for low, high in zip(lows, [*lows[1:], None], strict=True):
            out.append((name, low * 1000.0, OPEN if high is None else high * 1000.0, f"${low}k+" if high is None else f"${low}-${high}k"))
    return out


# Text of the bridge, written for both dialects: c is the customer's key.
OWNER = """CASE {c} % 12 WHEN 0 THEN concat(split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)), ' PROPERTIES LLC')
  WHEN 1 THEN concat(split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)), ' FAMILY TRUST')
  WHEN 2 THEN concat('ESTATE OF ', split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)), ' MARY')
  WHEN 3 THEN concat('County of ', split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)))
  WHEN 4 THEN concat(split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)), ' JOHN ETAL')
  ELSE concat(split_part('SMITH,JONES,MILLER,DAVIS,WILSON,CLARK,LEWIS,HALL', ',', CAST(({c} % 80 - {c} % 10) / 10 + 1 AS INT)), ' ', split_part('JOHN,MARY,ROBERT,ANNA,JAMES,LINDA,PAUL', ',', CAST({c} % 7 + 1 AS INT)), CASE WHEN {c} % 3 = 0 THEN ' & ANNE' ELSE ' Q. JR' END) END"""
SITE = "concat(c_custkey % 900 + 100, ' ', split_part('Oak,Main,Mill,Church,Ridge,Valley,Spring,Lake,Hill', ',', CAST(c_custkey % 9 + 1 AS INT)), ' ', split_part('Street,AVENUE,Rd.,Lane', ',', CAST(c_custkey % 4 + 1 AS INT)))"
REMARKS = """split_part('Fully renovated home with new kitchen and granite countertops|Sold as-is, needs TLC, investor special|Well-maintained, new roof, hardwood floors throughout|Mobile home on a large lot, priced to sell|Estate sale, original condition, tons of potential|Luxury custom built home, solar panels, smart home|Cash only, foreclosure, needs work|', '|', CAST(o_orderkey % 8 + 1 AS INT))"""


def price_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(band_rows(), "class_id string, lo double, hi double, band string")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("c_custkey").alias("o_custkey"), F.upper(F.trim("n_name")).alias("city"), F.upper(F.trim("r_name")).alias("county"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Closed")
        .when((F.col("o_orderstatus") == "P") & (o % 4 == 0), "Withdrawn")
        .when(F.col("o_orderstatus") == "P", "Expired/Cancelled")
        .when(o % 5 == 0, "Pending")
        .otherwise("Active")
    )
    kinds = F.array(*[F.lit(x) for x in ("RE_1", "MF_2", "LD_3", "CM_4", "FM_5", "RN_6")])
    rows = read("orders").join(places, "o_custkey").select(
        o.alias("listing_id"), c.alias("parcel_id"), "city", "county",
        F.element_at(kinds, (o % 6 + 1).cast("int")).alias("class_id"), status.alias("status"),
        F.col("o_totalprice").alias("original_list_price"),
        (F.col("o_totalprice") * (1 - 0.02 * (o % 5))).alias("list_price"),
        ((o * 37) % 240).cast("int").alias("dom"), F.to_date("o_orderdate").alias("list_date"),
        (600 + (c * 37) % 3400).cast("double").alias("sqft"), (((c * 13) % 400) / 10.0).alias("acres"),
        (1 + c % 5).cast("int").alias("bedrooms"), (1930 + c % 90).cast("int").alias("year_built"),
        F.concat(F.lit("SUB "), (c % 40).cast("string")).alias("subdivision"), (o % 50).alias("agent_id"), (o % 12).alias("office_id"),
        (37.0 + ((c * 7) % 1000) / 1000.0).alias("lat"), (-81.0 + ((c * 11) % 1000) / 1000.0).alias("lng"),
        (1 + c % 3).cast("int").alias("full_baths"), (50_000 + (c * 7919) % 400_000).cast("double").alias("assessed"), F.expr(OWNER.format(c="o_custkey")).alias("owner1"), F.expr(REMARKS).alias("remarks"),
    )
    sold = F.when(F.col("status") == "Closed", F.col("list_price") * (0.80 + 0.01 * (F.col("parcel_id") % 30)))
    ended = lambda *names: F.when(F.col("status").isin(*names), F.date_add("list_date", F.col("dom")))
    return rows.withColumn("sold_price", sold).withColumn("close_date", ended("Closed")).withColumn("off_market_date", ended("Expired/Cancelled", "Withdrawn"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax parcels, derived from the customers: owner, site and mailing address, assessment, last recorded sale, land."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = F.col("c_custkey")
    return places.select(
        c.alias("parcel_id"), F.upper(F.trim("r_name")).alias("county"), F.upper(F.trim("n_name")).alias("city"), F.expr(OWNER.format(c="c_custkey")).alias("owner1"),
        F.expr(SITE).alias("site_address"), F.expr(f"CASE WHEN c_custkey % 4 = 0 THEN concat('P.O. Box ', c_custkey % 60, ', Boone') ELSE {SITE} END").alias("mail_address"),
        F.when(c % 9 == 0, "NC").otherwise("VA").alias("mail_state"), (50_000 + (c * 7919) % 400_000).cast("double").alias("assessed"), (((c * 13) % 400) / 10.0).alias("acres"),
        (1930 + c % 90).cast("int").alias("year_built"), (1 + c % 5).cast("int").alias("bedrooms"), F.date_add(F.lit("1975-01-01").cast("date"), ((c * 481) % 9600).cast("int")).alias("last_sale_date"),
        F.when(c % 11 == 0, F.lit(500.0)).when(c % 13 == 0, F.lit(None)).otherwise((20_000 + (c * 631) % 400_000).cast("double")).alias("last_sale_price"),
        F.concat(F.lit("SUB "), (c % 40).cast("string")).alias("subdivision"), F.when(c % 7 == 0, F.lit(0.0)).otherwise((c * 7919 % 300_000).cast("double")).alias("building_value"),
        (37.0 + ((c * 7) % 1000) / 1000.0).alias("lat"), (-81.0 + ((c * 11) % 1000) / 1000.0).alias("lng"),
    )


def infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substations, fibre points and water works, derived from the suppliers."""
    s = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("substation", "fibre", "water"))), (s % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        s.alias("infra_id"), kind.alias("kind"), F.element_at(F.array(*map(F.lit, (69, 115, 230))), (s % 9 / 3 + 1).cast("int")).alias("kv"), ((s * 37) % 200 / 10.0).alias("capacity"),
        (37.0 + ((s * 13) % 1000) / 1000.0).alias("lat"), (-81.0 + ((s * 17) % 1000) / 1000.0).alias("lng"),
    )


def deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded deeds, derived from the same tables."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("c_custkey").alias("o_custkey"), F.upper(F.trim("r_name")).alias("county"))
    o = F.col("o_orderkey")
    day = F.date_add(F.to_date("o_orderdate"), (20 + (o * 53) % 300).cast("int"))
    return read("orders").filter(o % 3 == 1).join(places, "o_custkey").select(o.alias("deed_id"), F.col("o_custkey").alias("parcel_id"), "county", day.alias("deed_date"), (F.col("o_totalprice") * 0.9).alias("deed_price"), (o % 4 != 0).alias("arms_length"))


DEEDS_SQL = """deeds AS (SELECT o_orderkey AS deed_id, o_custkey AS parcel_id, upper(trim(r_name)) AS county, CAST(o_orderdate AS DATE) + CAST(20 + (o_orderkey * 53) % 300 AS INTEGER) AS deed_date,
  o_totalprice * CAST(0.9 AS DOUBLE) AS deed_price, o_orderkey % 4 <> 0 AS arms_length FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 3 = 1)"""

BRIDGE_SQL = """
WITH l0 AS (
  SELECT o_orderkey AS listing_id, o_custkey AS parcel_id, upper(trim(n_name)) AS city, upper(trim(r_name)) AS county,
    CASE o_orderkey % 6 WHEN 0 THEN 'RE_1' WHEN 1 THEN 'MF_2' WHEN 2 THEN 'LD_3' WHEN 3 THEN 'CM_4' WHEN 4 THEN 'FM_5' ELSE 'RN_6' END AS class_id,
    CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'Withdrawn' WHEN o_orderstatus = 'P' THEN 'Expired/Cancelled'
      WHEN o_orderkey % 5 = 0 THEN 'Pending' ELSE 'Active' END AS status,
    o_totalprice AS original_list_price, o_totalprice * (1 - CAST(0.02 AS DOUBLE) * (o_orderkey % 5)) AS list_price,
    CAST((o_orderkey * 37) % 240 AS INTEGER) AS dom, CAST(o_orderdate AS DATE) AS list_date,
    CAST(600 + (o_custkey * 37) % 3400 AS DOUBLE) AS sqft, ((o_custkey * 13) % 400) / CAST(10 AS DOUBLE) AS acres,
    CAST(1 + o_custkey % 5 AS INTEGER) AS bedrooms, CAST(1930 + o_custkey % 90 AS INTEGER) AS year_built,
    'SUB ' || CAST(o_custkey % 40 AS VARCHAR) AS subdivision, o_orderkey % 50 AS agent_id, o_orderkey % 12 AS office_id,
    CAST(37 AS DOUBLE) + ((o_custkey * 7) % 1000) / CAST(1000 AS DOUBLE) AS lat, CAST(-81 AS DOUBLE) + ((o_custkey * 11) % 1000) / CAST(1000 AS DOUBLE) AS lng,
    CAST(1 + o_custkey % 3 AS INTEGER) AS full_baths, CAST(50000 + (o_custkey * 7919) % 400000 AS DOUBLE) AS assessed, """ + OWNER.format(c="o_custkey") + """ AS owner1, """ + REMARKS + """ AS remarks
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), listings AS (
  SELECT *, CASE WHEN status = 'Closed' THEN list_price * (CAST(0.80 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (parcel_id % 30)) END AS sold_price,
    CASE WHEN status = 'Closed' THEN list_date + dom END AS close_date, CASE WHEN status IN ('Expired/Cancelled', 'Withdrawn') THEN list_date + dom END AS off_market_date FROM l0
), bands(class_id, lo, hi, band) AS (VALUES
  """ + ",\n  ".join(f"('{c}', CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE), '{b}')" for c, lo, hi, b in band_rows()) + "\n)"

PARCELS_SQL = f"""parcels AS (SELECT c_custkey AS parcel_id, upper(trim(r_name)) AS county, upper(trim(n_name)) AS city, {OWNER.format(c="c_custkey")} AS owner1, {SITE} AS site_address,
  CASE WHEN c_custkey % 4 = 0 THEN concat('P.O. Box ', c_custkey % 60, ', Boone') ELSE {SITE} END AS mail_address, CASE WHEN c_custkey % 9 = 0 THEN 'NC' ELSE 'VA' END AS mail_state,
  CAST(50000 + (c_custkey * 7919) % 400000 AS DOUBLE) AS assessed, ((c_custkey * 13) % 400) / CAST(10 AS DOUBLE) AS acres, CAST(1930 + c_custkey % 90 AS INTEGER) AS year_built, CAST(1 + c_custkey % 5 AS INTEGER) AS bedrooms,
  DATE '1975-01-01' + CAST((c_custkey * 481) % 9600 AS INTEGER) AS last_sale_date, CASE WHEN c_custkey % 11 = 0 THEN CAST(500 AS DOUBLE) WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(20000 + (c_custkey * 631) % 400000 AS DOUBLE) END AS last_sale_price,
  'SUB ' || CAST(c_custkey % 40 AS VARCHAR) AS subdivision, CASE WHEN c_custkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((c_custkey * 7919) % 300000 AS DOUBLE) END AS building_value,
  CAST(37 AS DOUBLE) + ((c_custkey * 7) % 1000) / CAST(1000 AS DOUBLE) AS lat, CAST(-81 AS DOUBLE) + ((c_custkey * 11) % 1000) / CAST(1000 AS DOUBLE) AS lng
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

INFRA_SQL = """infra AS (SELECT s_suppkey AS infra_id, CASE s_suppkey % 3 WHEN 0 THEN 'substation' WHEN 1 THEN 'fibre' ELSE 'water' END AS kind, CASE (s_suppkey % 9) // 3 WHEN 0 THEN 69 WHEN 1 THEN 115 ELSE 230 END AS kv,
  ((s_suppkey * 37) % 200) / CAST(10 AS DOUBLE) AS capacity, CAST(37 AS DOUBLE) + ((s_suppkey * 13) % 1000) / CAST(1000 AS DOUBLE) AS lat, CAST(-81 AS DOUBLE) + ((s_suppkey * 17) % 1000) / CAST(1000 AS DOUBLE) AS lng FROM supplier)"""
