"""Products over tax parcels and their owners: portfolios, profiles, signals, detectors, outreach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.functions import text
from parcelspark.functions.columns import clamp, ratio
from parcelspark.operators.relational import first_per
from parcelspark.operators.stages import settled

DETECTORS: dict[str, Callable[..., DataFrame]] = {}
# Outcomes of a contact.
HOT, COLD = ["interested", "hot", "warm"], ["not_interested", "cold", "do_not_call", "dnc"]
WON = ["listing_signed", "signed", "won", "listing_won"]
ANSWERED = [*HOT, "callback", "meeting_scheduled", *WON, "not_interested", "no", "decline"]


def detector(name: str):
    """Adds a product (parcels, as_of) -> leads to the registry of detectors."""

    def add(product):
        DETECTORS[name] = product
        return product

    return add


def tenure(as_of: str, sold: str = "last_sale_date") -> Column:
    """Whole years of 365 days since a sale."""
    return F.floor(F.datediff(F.lit(as_of).cast("date"), F.col(sold)) / 365).cast("int")


def described(parcels: DataFrame) -> DataFrame:
    """Parcels with their keys: owner class, mailbox, site, and whether the owner lives there (null where an address is missing)."""
    site, mail = text.address_key(F.col("site_address")), text.address_key(F.col("mail_address"))
    lives = F.when((site != "") & (mail != ""), site == mail)
    return parcels.select("*", text.owner_class(F.col("owner1")).alias("owner_class"), text.mail_key(F.col("mail_address")).alias("mail_key"), site.alias("site_key"), mail.alias("mail_line"), lives.alias("owner_occupied"))


def with_owner_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with canonical_owner_id, owner_type and owner_class of their owner1: worked out once for each way of writing, from a cleaned name that is written first, so no pattern is tried again."""
    name = F.col("_name")
    names = settled(rows.select(F.col("owner1").alias("_owner1")).distinct().withColumn("_name", text.owner_name(F.col("_owner1"))))
    keys = settled(names.select("_owner1", text.owner_key(name).alias("canonical_owner_id"), text.owner_type(name).alias("owner_type"), text.owner_class(F.col("_owner1")).alias("owner_class")))
    return rows.join(keys, F.col("owner1").eqNullSafe(F.col("_owner1")), "left").drop("_owner1")


def owner_keys(parcels: DataFrame) -> DataFrame:
    return with_owner_keys(parcels.select("parcel_id", "county", "owner1"))


def owner_portfolios(parcels: DataFrame, least: int = 2, listed: int = 50) -> DataFrame:
    """Owners of several parcels under any spelling: how many, where, the first ``listed`` of them and how many more."""
    rows = owner_keys(parcels).filter("canonical_owner_id IS NOT NULL")
    per = rows.groupBy("canonical_owner_id").agg(F.min("owner_type").alias("owner_type"), F.min("owner1").alias("sample_owner"), F.count("*").alias("n_parcels"), F.count_distinct("county").alias("n_counties"), F.array_join(F.array_sort(F.collect_set("county")), ";").alias("counties"))
    some = first_per(rows, ["canonical_owner_id"], [F.asc("county"), F.asc("parcel_id")], listed, "r")
    ids = some.groupBy("canonical_owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "county", "parcel_id"))), lambda x: F.concat_ws("/", x["county"], x["parcel_id"])), ";").alias("parcel_ids"))
    return per.filter(F.col("n_parcels") >= least).join(ids, "canonical_owner_id").withColumn("parcel_overflow", F.greatest(F.lit(0), F.col("n_parcels") - listed).cast("long"))


def investor_portfolios(listings: DataFrame, as_of: str, least: int = 2) -> DataFrame:
    """Owners with several listings: what is active, sold in 24 months, expired; entity, trust or person."""
    live, done = F.col("status").isin("Active", "Pending"), (F.col("status") == "Closed") & (F.col("close_date") >= F.add_months(F.lit(as_of).cast("date"), -24))
    joined = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(name)
    rows = listings.filter("trim(owner1) <> ''").withColumn("owner", F.upper(F.trim("owner1")))
    out = rows.groupBy("owner").agg(
        F.count("*").alias("total_listings"), F.count_if(F.col("status") == "Active").alias("n_active"), F.count_if(F.col("status") == "Pending").alias("n_pending"), F.count_if(done).alias("n_closed_24mo"),
        F.count_if(F.col("status").isin("Expired/Cancelled", "Withdrawn")).alias("n_expired"), F.sum(F.when(done, F.col("sold_price"))).alias("sold_volume_24mo"), F.median(F.when(live, F.col("list_price"))).alias("active_median_price"),
        joined("city", "cities"), joined("class_id", "classes_mix"),
    )
    return out.filter(F.col("total_listings") >= least).withColumn("owner_type", text.listed_owner_class(F.col("owner")))


def new_builders(listings: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Owners who sold ``least`` listings within 24 months."""
    closed = F.col("status") == "Closed"
    recent = closed & (F.col("close_date") >= F.add_months(F.lit(as_of).cast("date"), -24))
    joined = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(name)
    return listings.filter("trim(owner1) <> ''").groupBy(F.upper(F.trim("owner1")).alias("owner")).agg(
        F.count_if(recent).alias("n_closed_24mo"), F.count_if(F.col("status").isin("Active", "Pending")).alias("n_active_now"), F.median(F.when(closed, F.col("dom"))).alias("dom_median"),
        F.sum(F.when(recent, F.col("sold_price"))).alias("sold_volume"), joined("city", "cities"), joined("class_id", "classes"),
    ).filter(F.col("n_closed_24mo") >= least)


def deed_signals(parcels: DataFrame, as_of: str, least_price: float = 1000.0, days: int = 730) -> DataFrame:
    """Recent acquisitions, and recent transfers at a token price (within a family)."""
    day = F.lit(as_of).cast("date")
    recent = F.coalesce(F.col("last_sale_date") >= F.date_sub(day, days), F.lit(False))
    return parcels.select("parcel_id", "county", recent.alias("acquisition_within_24mo"), (recent & F.coalesce((F.col("last_sale_price") >= 0) & (F.col("last_sale_price") <= least_price), F.lit(False))).alias("intra_family_transfer_recent_24mo"), (F.datediff(day, "last_sale_date") / 365.25).alias("tenure_years"))


def flippers(parcels: DataFrame, as_of: str, least: int = 3, days: int = 1826) -> DataFrame:
    """Entities that acquired ``least`` parcels within five years; the price is the member at n // 2 of the sorted ones."""
    rows = owner_keys(parcels).join(parcels.select("parcel_id", "last_sale_date", "last_sale_price"), "parcel_id").filter("owner_type = 'entity' AND canonical_owner_id IS NOT NULL").filter(F.col("last_sale_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    place = Window.partitionBy("canonical_owner_id").orderBy(F.col("last_sale_price").asc_nulls_last(), "parcel_id")
    ranked = rows.withColumn("i", F.row_number().over(place) - 1).withColumn("priced", F.count("last_sale_price").over(Window.partitionBy("canonical_owner_id")))
    return ranked.groupBy("canonical_owner_id").agg(F.count("*").alias("n_acquisitions_5yr"), F.max("last_sale_date").alias("most_recent_acquisition"), F.array_join(F.array_sort(F.collect_set("county")), ";").alias("counties"), F.max(F.when(F.col("i") == F.floor(F.col("priced") / 2), F.col("last_sale_price"))).alias("median_acquisition_price")).filter(F.col("n_acquisitions_5yr") >= least)


def probate_signals(parcels: DataFrame, year_min: int) -> DataFrame:
    """Names of estates, heirs and trusts, and transfers at 1,000 or less; an old house of value adds a signal but does not qualify alone."""
    name = F.upper(F.nullif(F.regexp_extract("owner1", text.PROBATE, 0), F.lit("")))
    xfer = (F.col("last_sale_price") <= 1000) & (F.year("last_sale_date") >= year_min)
    strong = F.array_compact(F.array(F.concat(F.lit("name:"), name), F.when(xfer, F.concat(F.lit("zero_xfer:"), F.col("last_sale_date").cast("string"), F.lit("@$"), F.col("last_sale_price").cast("long").cast("string")))))
    old = F.when((F.col("year_built") < 1960) & (F.col("assessed") >= 200_000), F.concat(F.lit("vintage:"), F.col("year_built").cast("string")))
    rows = parcels.withColumn("strong", strong).filter(F.size("strong") > 0).withColumn("all", F.array_compact(F.concat("strong", F.array(old))))
    return rows.select("parcel_id", "county", "owner1", "year_built", "assessed", F.size("all").cast("long").alias("score"), F.array_join("all", ";").alias("signals"))


def parcel_profile(parcels: DataFrame, as_of: str) -> DataFrame:
    """Counts by owner class, occupancy, sale decade, assessment and tenure, in one pass: (dimension, bucket, n)."""
    rows = described(parcels)
    occupancy = F.when(F.col("site_key") == "", "no_site_addr").when(F.col("mail_line") == "", "no_mail_addr").when(F.col("owner_occupied"), "owner_occupied").otherwise("absentee")
    word = lambda c: c.cast("string")
    low = F.floor(F.col("assessed") / 100_000) * 100_000
    pairs = {
        "owner_class": F.col("owner_class"), "occupancy": occupancy, "sale_decade": F.coalesce(word((F.floor(F.year("last_sale_date") / 10) * 10)), F.lit("no_sale")),
        "assessed": F.when(F.col("assessed") != 0, word(low)), "tenure": word(F.least(F.floor(tenure(as_of) / 5) * 5, F.lit(50))),
    }
    many = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in pairs.items()))).alias("x")).select("x.*")
    return many.filter("bucket IS NOT NULL").groupBy("dimension", "bucket").agg(F.count("*").alias("n"))


def threshold_matrix(parcels: DataFrame, as_of: str) -> DataFrame:
    """How many absentee persons' parcels reach each pair of tenure and equity."""
    pairs = [(5, 40), (5, 60), (10, 40), (10, 60), (10, 80), (20, 40), (20, 60)]
    rows = described(parcels).filter("owner_occupied = false AND owner_class = 'person' AND last_sale_price > 0 AND assessed > last_sale_price").select(tenure(as_of).alias("years"), ((1 - F.col("last_sale_price") / F.col("assessed")) * 100).alias("equity"))
    counted = rows.agg(*(F.count_if((F.col("years") >= t) & (F.col("equity") >= e)).alias(f"{t}_{e}") for t, e in pairs))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(t).alias("least_tenure"), F.lit(e).alias("least_equity"), F.col(f"{t}_{e}").alias("n")) for t, e in pairs))).alias("x")).select("x.*")


def top_owners(parcels: DataFrame, owner_class: str = "person", n: int = 25) -> DataFrame:
    """The owners of one class with most parcels, then most assessed value."""
    rows = described(parcels).filter((F.col("owner_class") == owner_class) & F.col("owner1").isNotNull())
    mail = first_per(rows.groupBy("owner1", "mail_address").agg(F.count("*").alias("k")), ["owner1"], [F.desc("k"), F.asc("mail_address")]).select("owner1", F.col("mail_address").alias("primary_mail"))
    per = rows.groupBy("owner1").agg(F.count("*").alias("parcels"), F.sum("assessed").alias("total_assessed"), F.count_if("owner_occupied").alias("owner_occupied"), F.count_if(~F.col("owner_occupied")).alias("absentee"), F.max("last_sale_date").alias("last_acquired"))
    return per.orderBy(F.desc("parcels"), F.desc("total_assessed"), F.asc("owner1")).limit(n).join(mail, "owner1")  # the report is a top n


def top_mailers(parcels: DataFrame, n: int = 30) -> DataFrame:
    """The mailboxes with most parcels, governments left out."""
    rows = described(parcels).filter("mail_key <> '' AND owner_class <> 'govt_or_institution'")
    return rows.groupBy("mail_key").agg(F.count("*").alias("parcels"), F.sum("assessed").alias("total_assessed"), F.count_distinct("owner1").alias("distinct_owner_names"), F.count_if("owner_occupied").alias("owner_occupied"), F.max("last_sale_date").alias("last_acquired")).orderBy(F.desc("parcels"), F.desc("total_assessed"), F.asc("mail_key")).limit(n)


def new_investors(parcels: DataFrame, as_of: str, years: int = 3, least: int = 2) -> DataFrame:
    """Mailboxes whose absentee purchases all lie within ``years``: parcels, purchase dates, and what was paid, each transaction (date, price) once."""
    rows = described(parcels).filter("owner_occupied = false AND mail_key <> '' AND owner_class <> 'govt_or_institution' AND last_sale_date IS NOT NULL").filter(~F.col("mail_key").isin(text.NO_MAILBOX))
    paid = rows.select("mail_key", "last_sale_date", "last_sale_price").distinct().groupBy("mail_key").agg(F.sum("last_sale_price").alias("total_paid"))
    per = rows.groupBy("mail_key").agg(F.count("*").alias("parcels"), F.count_distinct("site_key").alias("sites"), F.count_distinct("last_sale_date").alias("purchase_dates"), F.min("last_sale_date").alias("first_bought"), F.max("last_sale_date").alias("last_bought"))
    return per.filter((F.col("parcels") >= least) & (F.col("first_bought") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))).join(paid, "mail_key")


def absentee_leads(parcels: DataFrame, as_of: str, least_tenure: int = 7, least_equity: float = 0.4) -> DataFrame:
    """Absentee owners of long tenure and high equity: up to 40 points for years, 60 for equity."""
    years = tenure(as_of)
    equity = F.when(F.col("assessed") > F.col("last_sale_price"), 1 - F.col("last_sale_price") / F.col("assessed")).otherwise(0.0)
    rows = described(parcels).filter("owner_occupied = false AND assessed > 0 AND last_sale_price > 0").select("parcel_id", "owner1", "assessed", "last_sale_price", years.alias("tenure_years"), equity.alias("equity_ratio"))
    rows = rows.filter((F.col("tenure_years") >= least_tenure) & (F.col("equity_ratio") >= least_equity))
    return rows.withColumn("score", F.floor(F.least("tenure_years", F.lit(40)) + clamp(F.col("equity_ratio"), 0.0, 1.0) * 60).cast("int"))


def expired_leads(listings: DataFrame, known: DataFrame) -> DataFrame:
    """Listings that ended without a sale and are no lead yet (``known``: listing_id): inserted once, never updated."""
    rows = listings.filter("status IN ('Expired/Cancelled', 'Withdrawn')").join(known.select("listing_id"), "listing_id", "left_anti")
    score = 50 + F.when(F.col("dom") >= 180, 20).when(F.col("dom") >= 90, 10).otherwise(0) + F.when(F.col("list_price") < F.col("original_list_price"), 10).otherwise(0)
    return rows.select("listing_id", "parcel_id", "city", "dom", score.alias("score"))


def _steps(c: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first threshold that is reached."""
    out = F.when(c >= steps[0][0], steps[0][1])
    for least, points in steps[1:]:
        out = out.when(c >= least, points)
    return out.otherwise(0)


@detector("CONCENTRATION")
def concentration(parcels: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Persons' mailboxes with several parcels in one subdivision."""
    rows = described(parcels).filter("trim(subdivision) <> '' AND mail_key <> '' AND owner_class = 'person'").filter(~F.col("mail_key").isin(text.NO_MAILBOX))
    per = rows.groupBy("mail_key", "subdivision").agg(F.count("*").alias("parcel_count"), F.count_distinct(F.nullif("site_key", F.lit(""))).alias("distinct_sites"), F.count_if("owner_occupied").alias("lived_in"), F.count_if(~F.col("owner_occupied")).alias("absentee"), F.sum("assessed").alias("total_assessed")).filter(F.col("parcel_count") >= least)
    score = 40 + F.least(F.col("distinct_sites") * 8, F.lit(40)) + F.when(F.col("absentee") > F.col("lived_in"), 10).otherwise(0) + _steps(F.col("total_assessed"), (2_000_000, 10), (1_000_000, 5))
    return per.select(F.concat_ws(" @ ", "mail_key", "subdivision").alias("key"), F.least(score, F.lit(100)).cast("long").alias("score"), "parcel_count", "total_assessed")


@detector("TENURE_SWEET_SPOT")
def tenure_sweet_spot(parcels: DataFrame, as_of: str, least: int = 3, most: int = 7) -> DataFrame:
    """Owners who live there and bought three to seven years ago."""
    rows = described(parcels).filter("owner_occupied").withColumn("t", tenure(as_of)).filter(F.col("t").between(least, most))
    score = 40 + F.greatest(F.lit(0), 30 - F.abs(F.col("t") - 6) * 5) + _steps(F.col("assessed"), (750_000, 20), (500_000, 15), (300_000, 10), (150_000, 5))
    return rows.select(F.col("parcel_id").cast("string").alias("key"), F.least(score, F.lit(100)).cast("long").alias("score"), F.lit(1).cast("long").alias("parcel_count"), F.col("assessed").alias("total_assessed"))


@detector("INHERITANCE_MULTI")
def inheritance(parcels: DataFrame, as_of: str, years: int = 2, least: int = 2) -> DataFrame:
    """Parcels that reached one person's mailbox on one day without a price."""
    rows = described(parcels).filter("owner_class = 'person' AND coalesce(last_sale_price, 0) = 0 AND last_sale_date IS NOT NULL AND mail_key <> ''").filter(~F.col("mail_key").isin(text.NO_MAILBOX))
    rows = rows.filter(F.col("last_sale_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    per = rows.groupBy("mail_key", "last_sale_date").agg(F.count("*").alias("parcel_count"), F.count_distinct(F.nullif("site_key", F.lit(""))).alias("sites"), F.sum("assessed").alias("total_assessed"), F.bool_or(F.upper("owner1").contains("ESTATE")).alias("estate"), F.bool_or(F.upper("owner1").rlike("ETAL|ET AL")).alias("etal")).filter(F.col("parcel_count") >= least)
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = 40 + F.least(F.col("parcel_count") * 4, F.lit(20)) + _steps(F.col("total_assessed"), (2_000_000, 15), (1_000_000, 10), (500_000, 5)) + flag(F.col("estate"), 20) + flag(F.col("etal"), 10) + flag(F.col("sites") >= 3, 10)
    return per.select(F.concat_ws(" @ ", "mail_key", F.col("last_sale_date").cast("string")).alias("key"), F.least(score, F.lit(100)).cast("long").alias("score"), "parcel_count", "total_assessed")


@detector("STUDENT_RENTAL_LLC")
def student_rental(parcels: DataFrame, as_of: str, least_tenure: int = 7, least_equity: float = 40.0) -> DataFrame:
    """Entities' rented buildings of long tenure; equity from the latest sale of the building."""
    rows = described(parcels).filter("owner_class = 'entity' AND owner_occupied = false AND mail_key <> '' AND site_key <> ''").withColumn("t", tenure(as_of)).filter(F.col("t") >= least_tenure)
    head = F.max_by(F.struct("owner1", "t", F.coalesce("last_sale_price", F.lit(0.0)).alias("paid")), F.struct("last_sale_date", "parcel_id")).alias("h")
    per = rows.groupBy("mail_key", "site_key").agg(F.count("*").alias("parcel_count"), F.sum("assessed").alias("total_assessed"), head)
    paid = F.col("h.paid")
    per = per.withColumn("equity", F.when((paid > 0) & (F.col("total_assessed") > paid), (1 - paid / F.col("total_assessed")) * 100).otherwise(0.0)).filter((F.col("equity") >= least_equity) | (paid <= 0))
    score = 40 + F.least(F.col("h.t"), F.lit(20)) + F.floor(F.least("equity", F.lit(50.0)) / 2) + _steps(F.col("total_assessed"), (500_000, 10)) + F.when(F.col("parcel_count") > 1, 5).otherwise(0)
    return per.select(F.concat_ws(" @ ", "h.owner1", "site_key").alias("key"), F.least(score, F.lit(100)).cast("long").alias("score"), "parcel_count", "total_assessed")


@detector("EMPTY_LOTS")
def empty_lots(parcels: DataFrame, as_of: str, least_acres: float = 0.05) -> DataFrame:
    """Persons' parcels without a building, by size."""
    rows = described(parcels).filter("coalesce(building_value, 0) = 0 AND assessed > 0 AND owner_class = 'person'").filter(F.col("acres") >= least_acres)
    score = 30 + _steps(F.col("acres"), (10, 60), (5, 45), (1, 30), (0.5, 20), (0.25, 10))
    return rows.select(F.col("parcel_id").cast("string").alias("key"), F.least(score, F.lit(100)).cast("long").alias("score"), F.lit(1).cast("long").alias("parcel_count"), F.col("assessed").alias("total_assessed"))


def leads(parcels: DataFrame, as_of: str) -> DataFrame:
    """The leads of every registered detector."""
    out = None
    for name, product in DETECTORS.items():
        found = product(parcels, as_of).withColumn("category", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def home_inventory(parcels: DataFrame) -> DataFrame:
    """Homes with how many other parcels share their mailbox, their owner's name, or either (mailbox and name counted by windows, not joined)."""
    rows = described(parcels).withColumn("owner", F.upper(F.trim("owner1")))
    count = lambda *by: F.count("*").over(Window.partitionBy(*by))
    rows = rows.withColumn("m", count("mail_key")).withColumn("o", count("owner")).withColumn("b", count("mail_key", "owner"))
    homes = rows.filter("building_value > 0 AND owner_class <> 'govt_or_institution'")
    return homes.select("parcel_id", "owner_class", (F.col("m") - 1).alias("same_mail"), (F.col("o") - 1).alias("same_name"), (F.col("m") + F.col("o") - F.col("b") - 1).alias("other_properties"))


def subdivision_report(parcels: DataFrame, as_of: str) -> DataFrame:
    """Each subdivision's parcels: occupancy, owner classes, assessment, tenure, owners of several."""
    rows = described(parcels).filter("trim(subdivision) <> ''").withColumn("t", tenure(as_of))
    shared = rows.withColumn("k", F.count("*").over(Window.partitionBy("subdivision", "mail_key")))
    return shared.groupBy("subdivision").agg(
        F.count("*").alias("parcels"), F.count_if("owner_occupied").alias("owner_occupied"), F.count_if(~F.col("owner_occupied")).alias("absentee"), F.count_if(F.col("owner_class") == "entity").alias("entities"), F.sum("assessed").alias("total_assessed"),
        F.median("assessed").alias("median_assessed"), F.avg("t").alias("mean_tenure"), F.count_if(F.col("k") > 1).alias("in_portfolios"),
    )


def annotate_outreach(scores: DataFrame, contacts: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Scores with the status of their latest contact: hot ones rise, cold and recent ones are held back."""
    last = contacts.filter("contact_date IS NOT NULL").groupBy("parcel_id").agg(F.max_by(F.struct("contact_date", F.lower(F.trim("outcome")).alias("outcome")), F.struct("contact_date", "contact_id")).alias("c")).select("parcel_id", F.col("c.contact_date").alias("last_contact_date"), F.col("c.outcome").alias("last_outcome"))
    ago = F.datediff(F.lit(as_of).cast("date"), "last_contact_date")
    status = F.when(ago.isNull(), "never_contacted").when(F.col("last_outcome").isin(HOT), F.concat(F.lit("hot:"), F.col("last_outcome"))).when(F.col("last_outcome").isin(COLD), "cold").otherwise(F.concat(F.lit("contacted_"), ago.cast("string"), F.lit("d_ago")))
    change = F.when(ago.isNull(), 0).when(F.col("last_outcome").isin(HOT), 15).when(F.col("last_outcome").isin(COLD), -50).when(ago < days, -50).otherwise(-5)
    return scores.join(last, "parcel_id", "left").select("parcel_id", F.bround(F.col("score") + change, 0).cast("long").alias("score"), status.alias("outreach_status"), "last_contact_date", "last_outcome")


def campaign_performance(contacts: DataFrame) -> DataFrame:
    """Contacts, parcels reached, answers and wins of each campaign."""
    out = F.lower(F.trim("outcome"))
    rows = contacts.groupBy(F.coalesce(F.nullif(F.trim("campaign"), F.lit("")), F.lit("(none)")).alias("campaign")).agg(F.count("*").alias("contacts"), F.count_distinct("parcel_id").alias("parcels"), F.count_if(out.isin(ANSWERED)).alias("responses"), F.count_if(out.isin(WON)).alias("wins"), F.min("contact_date").alias("first_contact"), F.max("contact_date").alias("last_contact"))
    return rows.withColumn("response_rate", ratio(F.col("responses"), F.col("contacts"))).withColumn("win_rate", ratio(F.col("wins"), F.col("contacts")))


def call_queue(scores: DataFrame, parcels: DataFrame, contacts: DataFrame, as_of: str, least: int = 30, signals: list[str] = (), days: int = 60) -> DataFrame:
    """Whom to call: persons with the score and all wanted signals who were not touched within ``days`` and never said no."""
    dead = contacts.withColumn("o", F.lower(F.trim("outcome"))).filter(F.col("o").isin([*COLD, *WON]) | (F.col("contact_date") >= F.date_sub(F.lit(as_of).cast("date"), days))).select("parcel_id").distinct()
    rows = scores.filter(F.col("score") >= least).filter(F.size(F.array_except(F.array(*map(F.lit, signals)).cast("array<string>"), F.split("signals", ";"))) == 0)
    people = described(parcels).filter("owner_class = 'person'").select("parcel_id", "county", "subdivision", "owner_occupied", "last_sale_date")
    return rows.join(people, "parcel_id").join(dead, "parcel_id", "left_anti")


def door_knock_groups(queue: DataFrame, as_of: str, least_tenure: float = 3.0) -> DataFrame:
    """The queue's owners who live there, three years at least, by subdivision: how many, mean and best score."""
    rows = queue.filter("owner_occupied").filter(F.datediff(F.lit(as_of).cast("date"), "last_sale_date") / 365.25 >= least_tenure)
    return rows.groupBy(F.coalesce(F.nullif(F.trim("subdivision"), F.lit("")), F.lit("(no subdivision)")).alias("subdivision")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("top_score"))


def hot_prospects(contacts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Parcels whose latest contact within ``days`` was hot."""
    day = F.lit(as_of).cast("date")
    recent = contacts.filter((F.col("contact_date") >= F.date_sub(day, days)) & (F.col("contact_date") <= day))
    last = first_per(recent, ["parcel_id"], [F.desc("contact_date"), F.desc("contact_id")])
    return last.filter(F.lower(F.trim("outcome")).isin(HOT)).select("parcel_id", "contact_date", "outcome")
