"""Subjects of a valuation found among listings and parcels, from a parcel number or an address as it is typed; places from the same street.

Each step of the cascade sees only the subjects that the steps before left: listings by parcel number, listings by the typed address, parcels by number, parcels by address. Texts are found
inside others by a join on three letters in a row: of each text asked the triple that the fewest rows hold, so a common street or number is no hot key. Distinct texts meet distinct addresses:
an address sends its first row (for places its first STREET_ROWS), so pairs don't grow with the rows of one address.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions.text import squeeze
from parcelspark.operators.stages import settled

GRAM = 3
STREET_ROWS = 20  # of a street, for its place
# Street suffixes, short and long, in the order in which they are put in place; what is cut from the end of typed addresses.
SUFFIXES = {" RD": " ROAD", " ST": " STREET", " AVE": " AVENUE", " DR": " DRIVE", " HWY": " HIGHWAY", " LN": " LANE", " CT": " COURT", " BLVD": " BOULEVARD", " PKWY": " PARKWAY", " PL": " PLACE", " TER": " TERRACE", " CIR": " CIRCLE", " TRL": " TRAIL", " PT": " POINT", " SQ": " SQUARE"}
STATE_AND_ZIP = r"(?i)\b(VA|VIRGINIA|\d{5}(?:-\d{4})?)\b"
DIRECTION = r"^(N|S|E|W|NE|NW|SE|SW)\s+"


def normalised(query: Column) -> Column:
    """Upper case, without state and postal code, single blanks."""
    return squeeze(F.regexp_replace(F.upper(F.trim(query)), STATE_AND_ZIP, " "))


def contracted(query: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), SUFFIXES.items(), query)


def expanded(query: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SUFFIXES.items(), query)


def street_of(address: Column) -> Column:
    """Street and suffix of an address that begins with a house number, without direction and what follows a comma; null of others."""
    rest = F.regexp_extract(F.upper(F.trim(address)), r"^\d+[A-Z]?\s+(.*)$", 1)
    name = F.trim(F.split_part(F.regexp_replace(F.trim(rest), DIRECTION, ""), F.lit(","), F.lit(1)))
    return F.when(F.length(name) > 0, name)


def grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))))


def containing(asked: DataFrame, text: str, rows: DataFrame, within: str) -> DataFrame:
    """Pairs of ``asked`` and ``rows`` where ``within`` holds ``text`` (three letters at least). Columns of both must differ in name."""
    index = rows.withColumn("_gram", F.explode(grams(F.col(within))))
    held = index.groupBy("_gram").agg(F.count("*").alias("_held"))
    each = asked.withColumn("_ask", F.monotonically_increasing_id()) if "_ask" not in asked.columns else asked
    each = settled(each)  # numbered once
    found = each.select("_ask", F.explode(grams(F.col(text))).alias("_gram")).join(held, "_gram", "left").groupBy("_ask").agg(F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("_held"), "_gram")).alias("_rare"))
    rare = found.filter("_rare._held > 0").select("_ask", F.col("_rare._gram").alias("_gram"))
    return each.join(rare, "_ask").join(index, "_gram").filter(F.contains(F.col(within), F.col(text))).drop("_gram", "_ask")


def forms(address: Column, tail: bool) -> Column:
    """(order, form) of a typed address: as it is, normalised, with short and long suffixes, number and street alone and, with ``tail``, all but the last word. Each once."""
    norm = normalised(address)
    words = F.split(norm, " ")
    out = [F.upper(F.trim(address)), norm, contracted(norm), expanded(norm), F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))]
    if tail:
        out = [*out[1:], F.when(F.size(words) > 3, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))]
    return F.array_compact(F.array(*(F.when(F.length(f) > 0, F.struct(F.lit(i).alias("order"), f.alias("form"))) for i, f in enumerate(out))))


def _first(pairs: DataFrame, order: list[Column], keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def by_address_of_listings(asked: DataFrame, listings: DataFrame) -> DataFrame:
    """subject_id, found (listing_id): the first form that some listing's address holds; of its listings an active one first, then the latest, then the smaller number."""
    order = [(F.col("status") == "Active").desc_nulls_last(), F.col("list_date").desc_nulls_last(), F.col("listing_id")]
    each = settled(asked.select("subject_id", F.explode(forms(F.col("asked_address"), tail=False)).alias("f")).select("subject_id", "f.*"))
    places = settled(_first(listings.select("listing_id", F.upper("address").alias("_where"), "status", "list_date").filter("_where IS NOT NULL"), order, ("_where",)))
    found = _first(containing(each.select("form").distinct(), "form", places, "_where"), order, ("form",))
    return _first(each.join(found, "form"), [F.col("order"), *order]).select("subject_id", F.col("listing_id").alias("found"))


def by_address_of_parcels(asked: DataFrame, parcels: DataFrame) -> DataFrame:
    """subject_id, found (parcel_id): every word of the form is in the parcel's address and county, a house number at the front of the address; ties to the latest sale, then the smaller number."""
    each = settled(asked.select("subject_id", F.explode(forms(F.col("asked_address"), tail=True)).alias("f")).select("subject_id", "f.*"))
    words = F.split("form", " ")
    house = F.when(F.element_at(words, 1).rlike(r"^\d+$"), F.element_at(words, 1))
    rest = F.when(house.isNotNull(), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
    longest = F.element_at(F.array_sort(F.transform(rest, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]  # one word finds the rows, all are compared
    texts = each.select("form").distinct().withColumns({"house": house, "rest": rest}).filter(F.size("rest") > 0).withColumn("longest", longest)
    rows = parcels.filter(F.length("site_address") > 0).select("parcel_id", "last_sale_date", F.upper("site_address").alias("_site"), F.upper(F.concat_ws(" ", "site_address", "county")).alias("_where"))
    latest = [F.col("last_sale_date").desc_nulls_last(), F.col("parcel_id")]
    places = settled(_first(rows, latest, ("_site", "_where")))
    pairs = containing(texts, "longest", places, "_where").filter(F.forall("rest", lambda w: F.contains(F.col("_where"), w)))
    pairs = pairs.filter(F.col("house").isNull() | (F.col("_site").startswith(F.col("house")) & ~F.substring(F.col("_site"), F.length("house") + 1, F.lit(1)).rlike("[0-9]")))
    order = [F.col("_site").startswith(F.element_at(F.split("form", " "), 1)).desc(), *latest]
    found = _first(pairs, order, ("form",))
    return _first(each.join(found, "form"), [F.col("order"), *order]).select("subject_id", F.col("parcel_id").alias("found"))


def by_number(asked: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    number = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    pairs = asked.filter("asked_parcel IS NOT NULL").select("subject_id", number("asked_parcel").alias("_number")).join(rows.withColumn("_number", number("parcel_id")), "_number")
    return _first(pairs, order).select("subject_id", F.col(key).alias("found"))


def street_places(listings: DataFrame, asked: DataFrame) -> DataFrame:
    """street, city, lat, lng for each street and city of ``asked``: the upper middle of latitude and of longitude of the first STREET_ROWS listings whose address holds the street."""
    want = asked.select("street", "place_city").distinct()
    rows = listings.filter("lat IS NOT NULL AND lng IS NOT NULL").select("listing_id", F.upper("address").alias("_where"), F.upper("city").alias("_city"), "lat", "lng").filter("_where IS NOT NULL AND _city IS NOT NULL")
    some = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("listing_id"))).filter(F.col("_n") <= STREET_ROWS).drop("_n")
    rows = settled(some(rows, "_where", "_city"))
    near = containing(want, "street", rows.select("_where", "_city").distinct(), "_where").filter("_city = place_city")
    first = some(near.join(rows, ["_where", "_city"]), "street", "place_city")
    middle = lambda c: F.element_at(F.array_sort(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int") + 1).alias(c)
    return first.groupBy("street", "place_city").agg(middle("lat"), middle("lng"))


def resolve(subjects: DataFrame, listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """subject_id, step (listing_number, listing_address, parcel_number, parcel_address, none), listing_id, parcel_id, address, city, lat, lng and place (own, street or none) of each of ``subjects`` (subject_id, asked_address, asked_parcel).

    ``listings`` has address besides the usual columns; parcels' own coordinates may be null. Listings win over parcels; what only the parcel knows (assessed) comes along for both.
    """
    active = [(F.col("status") == "Active").desc_nulls_last(), F.col("list_date").desc_nulls_last(), F.col("listing_id")]
    steps = [
        ("listing_number", "listing_id", lambda left: by_number(left, listings, "listing_id", active)),
        ("listing_address", "listing_id", lambda left: by_address_of_listings(left.filter("asked_address IS NOT NULL"), listings)),
        ("parcel_number", "parcel_id", lambda left: by_number(left, parcels, "parcel_id", [F.col("parcel_id")])),
        ("parcel_address", "parcel_id", lambda left: by_address_of_parcels(left.filter("asked_address IS NOT NULL"), parcels)),
    ]
    left, hits = settled(subjects.select("subject_id", "asked_address", "asked_parcel")), []
    for name, kind, find in steps:
        got = settled(find(left).select("subject_id", F.lit(name).alias("step"), *(F.col("found").alias(k) if k == kind else F.lit(None).cast(listings.schema[k].dataType).alias(k) for k in ("listing_id", "parcel_id"))))
        hits.append(got)
        left = settled(left.join(got, "subject_id", "left_anti"))
    every = reduce(DataFrame.unionByName, hits)
    of_listing = listings.select("listing_id", F.col("parcel_id").alias("l_parcel"), F.col("address").alias("l_address"), F.col("city").alias("l_city"), F.col("lat").alias("l_lat"), F.col("lng").alias("l_lng"))
    rows = every.join(of_listing, "listing_id", "left").withColumn("parcel_id", F.coalesce("parcel_id", "l_parcel")).drop("l_parcel")
    of_parcel = parcels.select("parcel_id", "assessed", F.col("site_address").alias("p_address"), F.col("city").alias("p_city"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    rows = settled(rows.join(of_parcel, "parcel_id", "left").select("subject_id", "step", "listing_id", "parcel_id", "assessed", *(F.coalesce(f"l_{c}", F.when(F.col("listing_id").isNull(), F.col(f"p_{c}"))).alias(c) for c in ("address", "city", "lat", "lng"))))
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    asked = rows.filter(~known).withColumns({"street": street_of(F.col("address")), "place_city": F.upper(F.trim("city"))}).drop("lat", "lng")
    places = street_places(listings, asked.filter("street IS NOT NULL AND place_city IS NOT NULL"))
    placed = asked.join(places, ["street", "place_city"], "left").withColumn("place", F.when(F.col("lat").isNotNull(), "street").otherwise("none"))
    fields = ["subject_id", "step", "listing_id", "parcel_id", "assessed", "address", "city", "lat", "lng", "place"]
    done = rows.filter(known).withColumn("place", F.lit("own")).select(*fields).unionByName(placed.select(*fields))
    none = left.select("subject_id", F.lit("none").alias("step"), F.lit("none").alias("place"))
    return done.unionByName(none, allowMissingColumns=True)
