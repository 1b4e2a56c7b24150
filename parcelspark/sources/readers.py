"""Readers of loosely typed feeds: typed once here, so that products need no casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from parcelspark.functions.text import alnum

# What a listing has, and the words of remarks that tell garages and basements.
_TYPES = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "date": DateType()}
_LISTING = (
    "listing_id string, class_id string, status string, parcel_id string, address string, city string, county string, subdivision string, list_price double, original_list_price double, sold_price double, "
    "dom int, list_date date, close_date date, off_market_date date, sqft double, acres double, bedrooms int, full_baths int, year_built int, lat double, lng double, agent_id string, office_id string, remarks string"
)
LISTING = StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in _LISTING.split(", "))])
DATE_LAYOUTS = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMddyyyy", "dd-MMM-yy", "dd-MMM-yyyy"]
DELINQUENT = r"(?m)^\s*(?<pid>[A-Z0-9][A-Z0-9 \-.]{2,24}?)\s{2,}(?<rest>.+?)\s+\$?(?<amount>[\d,]+\.\d{2})\s*$"


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``: missing ones null, others cast where they can be; an integer comes by way of a rounded double."""

    def column(f):
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "integer":
            return F.round(c.try_cast("double")).cast("int").alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return rows.select(*map(column, schema))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType = LISTING) -> DataFrame:
    """Newline JSON of any mix of columns, by name: values are read as text and conformed, so one bad value makes a null and not a lost row."""
    text = StructType([StructField(f.name, StringType()) for f in schema])
    return conform(spark.read.schema(text).json(path), schema)


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: StructType = LISTING) -> DataFrame:
    """Newline JSON without the lines that are no JSON."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """A CSV with a header whose columns are found by name; short and long lines are taken as far as they go."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return conform(raw, schema)


def sale_date(value: Column, as_of: str) -> Column:
    """A date of any known layout or milliseconds since 1970; a two-digit year that would lie ahead belongs to the century before."""
    s = F.regexp_replace(F.trim(value), r"T\d.*$", "")
    millis = F.when(s.rlike(r"^-?\d{9,14}$"), F.to_date(F.timestamp_millis(s.try_cast("long"))))
    tried = [F.when(F.length(s) == len(layout) if layout in ("yyyyMMdd", "MMddyyyy") else F.lit(True), F.try_to_timestamp(F.replace(F.initcap(F.replace(s, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-")) if "MMM" in layout else s, F.lit(layout)).cast("date")) for layout in DATE_LAYOUTS]
    day = F.coalesce(*tried, millis)
    return F.when(F.year(day) > F.year(F.lit(as_of).cast("date")), F.add_months(day, -1200)).otherwise(day)


def delinquencies(pages: DataFrame, county: str, least: float = 50.0, shortest: int = 4) -> DataFrame:
    """Parcel ids and amounts from the text of tax rolls (source, page, text): a line with an id, words and an amount."""
    lines = pages.select("source", "page", F.explode(F.split("text", "\n")).alias("line"))
    got = lambda i: F.regexp_extract("line", DELINQUENT, i)
    rows = lines.select("source", "page", F.lit(county).alias("county"), F.upper(F.trim(F.regexp_replace(got(1), r"\s+", " "))).alias("parcel_id_raw"), F.substring(F.trim(got(2)), 1, 200).alias("owner_or_addr_raw"), F.regexp_replace(got(3), ",", "").try_cast("double").alias("delinquent_amount"))
    return rows.filter((F.col("delinquent_amount") >= least) & (F.length("parcel_id_raw") >= shortest))


def capacity_table(raw: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """A feed's columns under our names: for each, the first header of its list that the feed has (letters and digits alone count)."""
    plain = {"".join(ch for ch in c.upper() if ch.isalnum()): c for c in raw.columns}

    def pick(options):
        return next((F.col(f"`{plain[k]}`") for k in ("".join(ch for ch in o.upper() if ch.isalnum()) for o in options) if k in plain), F.lit(None).cast("string"))

    return raw.select(*(pick(options).alias(name) for name, options in names.items()))


def supplemental_pool(raw: DataFrame, classes: dict[str, str], size_factor: float = 1.0) -> DataFrame:
    """Sales of another source as listings: class by its own words, size by a factor, lots from square feet to acres, the rest null."""
    kind = F.coalesce(*(F.when(F.lower("property_type").contains(k), F.lit(v)) for k, v in classes.items()), F.lit("RE_1"))
    rows = raw.withColumns({"class_id": kind, "status": F.lit("Closed"), "sqft": F.col("sqft").try_cast("double") * size_factor, "acres": F.col("lot_sqft").try_cast("double") / 43_560.0})
    return conform(rows, LISTING)


def scraped_pool(raw: DataFrame) -> DataFrame:
    """Scraped sales as listings: the sold price stands for the list prices that the source lacks."""
    return conform(raw.withColumns({"status": F.lit("Closed"), "list_price": F.col("sold_price"), "original_list_price": F.col("sold_price")}), LISTING)


def slim_listings(raw: DataFrame) -> DataFrame:
    """The pool that products read: conformed columns, extras out of the raw map, garage bays and basement (true, false, unknown) from text."""
    extra = lambda k: F.element_at("extras", F.lit(k))
    garage = F.lower(F.coalesce(extra("garage"), F.lit("")))
    bays = F.when(garage.rlike(r"\b(3|three)\b"), 3).when(garage.rlike(r"\b(2|two|double)\b"), 2).when(garage.rlike(r"\b(1|one|single)\b"), 1).when(garage.rlike(r"\b(no|none)\b"), 0)
    basement = F.lower(extra("basement"))
    has = F.when(basement.rlike(r"\b(no|none|crawl|slab)\b"), False).when(basement.rlike(r"[a-z]"), True)
    return conform(raw, LISTING).join(raw.select(F.col("listing_id").cast("string").alias("listing_id"), bays.alias("garage_bays"), has.alias("has_basement")), "listing_id", "left")


def parcel_union(counties: list[DataFrame], statewide: DataFrame, schema: StructType) -> DataFrame:
    """Parcels of the counties' own feeds, and the statewide ones of counties without a feed."""
    own = reduce(DataFrame.unionByName, [conform(x, schema) for x in counties])
    covered = own.select(F.upper(F.trim("county")).alias("_c")).distinct()
    rest = conform(statewide, schema).withColumn("_c", F.upper(F.trim("county")))
    return own.unionByName(rest.join(covered, "_c", "left_anti").drop("_c"))


def search_index(listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """What can be searched: listings (live ones first), then parcels that no listing has; one text of all names."""
    text = lambda *c: F.upper(F.concat_ws(" ", *c))
    rank = F.when(F.col("status") == "Active", 0).when(F.col("status") == "Pending", 1).when(F.col("status") == "Closed", 2).otherwise(3)
    mls = listings.select(F.lit("mls").alias("source"), F.col("listing_id").cast("string").alias("id"), alnum(F.col("parcel_id").cast("string")).alias("parcel"), rank.alias("rank0"), text("address", "city", "subdivision").alias("text"))
    land = parcels.select(F.lit("parcel").alias("source"), F.col("parcel_id").cast("string").alias("id"), alnum(F.col("parcel_id").cast("string")).alias("parcel"), F.lit(9).alias("rank0"), text("site_address", "city", "owner1").alias("text"))
    return mls.unionByName(land.join(mls.filter("parcel IS NOT NULL").select("parcel").distinct(), "parcel", "left_anti").select(*mls.columns))


def history_backfill(listings: DataFrame) -> DataFrame:
    """Events that a listing's present state implies: new, a price change from the original price, a sale; one row makes up to three."""
    change = F.col("list_price") - F.col("original_list_price")
    event = lambda kind, day, price: F.struct(F.lit(kind).alias("kind"), F.col(day).alias("observed_at"), price.cast("double").alias("price"))
    events = F.array_compact(F.array(
        F.when(F.col("list_date").isNotNull(), event("new", "list_date", F.coalesce("original_list_price", "list_price"))), F.when(change != 0, event("price_change", "list_date", F.col("list_price"))),
        F.when((F.col("sold_price") > 0) & F.col("close_date").isNotNull(), event("sold_price_set", "close_date", F.col("sold_price"))),
    ))
    return listings.select("listing_id", "class_id", "city", F.explode(events).alias("e")).select("listing_id", "class_id", "city", "e.*")
