"""Market products over a listings DataFrame. Each takes ``as_of`` where the present matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.functions.columns import month_index, ratio
from parcelspark.operators.relational import first_per, mode_per, quantiles, range_join

COHORT = ["class_id", "city", "band"]


def pct(x: str, p: float, name: str):
    return F.percentile(F.col(x), p).alias(name)


def sold(listings: DataFrame) -> DataFrame:
    return listings.filter("status = 'Closed' AND sold_price > 0 AND list_price > 0 AND close_date IS NOT NULL")


def dom_by_cohort(listings: DataFrame, bands: DataFrame, least: int = 3) -> DataFrame:
    rows = range_join(sold(listings), bands, "list_price").withColumn("sale_year", F.year("close_date"))
    return rows.groupBy("sale_year", *COHORT).agg(F.count("*").alias("n"), F.median("dom").alias("median_dom"), pct("dom", 0.25, "p25_dom"), pct("dom", 0.75, "p75_dom"), F.median("sold_price").alias("median_sold")).filter(F.col("n") >= least)


def dom_by_subdivision(listings: DataFrame, least: int = 3) -> DataFrame:
    return sold(listings).groupBy("city", "subdivision", "class_id").agg(F.count("*").alias("n"), F.median("dom").alias("median_dom"), F.median("sold_price").alias("median_sold")).filter(F.col("n") >= least)


def spread(listings: DataFrame, bands: DataFrame, year_min: int = 2018, least: int = 5) -> DataFrame:
    """Sold over original list price by close year and cohort; bands go by the original price."""
    done = listings.filter("status = 'Closed' AND sold_price > 0 AND original_list_price > 0").withColumn("close_year", F.year("close_date")).filter(F.col("close_year") >= year_min)
    rows = range_join(done, bands, "original_list_price").withColumn("gap", 100 * (F.col("sold_price") - F.col("original_list_price")) / F.col("original_list_price"))
    return rows.groupBy("close_year", *COHORT).agg(
        F.count("*").alias("n"), F.median("gap").alias("median_spread_pct"), pct("gap", 0.25, "p25_spread_pct"), pct("gap", 0.75, "p75_spread_pct"), F.median("original_list_price").alias("median_original_price"),
        F.median("sold_price").alias("median_sold_price"), (F.count_if(F.col("sold_price") >= F.col("original_list_price")) / F.count("*")).alias("pct_at_or_over_ask"),
    ).filter(F.col("n") >= least)


def velocity(listings: DataFrame, as_of: str, least_active: int = 1, least_closed: int = 5) -> DataFrame:
    """Active stock over monthly sales, expiry share and a five-way label for each city and class."""
    day, by = F.lit(as_of).cast("date"), ["city", "class_id"]
    closed = F.col("status") == "Closed"
    year, quarter = closed & (F.col("close_date") >= F.date_sub(day, 365)), closed & (F.col("close_date") >= F.date_sub(day, 90))
    lost = F.col("status").isin("Expired/Cancelled", "Withdrawn") & (F.col("off_market_date") >= F.date_sub(day, 365))
    share = 100 * ratio(F.col("sold_price"), F.col("original_list_price"))
    some = lambda cond, name: F.nullif(F.count_if(cond), F.lit(0)).alias(name)  # noqa: E731  (a cohort without any has none, not 0)
    rows = listings.groupBy(*by).agg(
        F.count_if(F.col("status") == "Active").alias("active_n"), some(year, "closed_12mo"), some(quarter, "closed_90d"), some(lost, "expired_12mo"),
        F.median(F.when(quarter, F.col("dom"))).alias("dom_median_90d"), F.median(F.when(year, F.col("dom"))).alias("dom_median_12mo"), F.median(F.when(quarter, share)).alias("pct_of_orig_list_90d"),
    ).filter((F.col("active_n") >= least_active) & (F.coalesce("closed_12mo", F.lit(0)) >= least_closed))
    months = ratio(F.col("active_n").cast("double"), F.col("closed_12mo") / 12.0)
    label = F.when(months < 1.5, "extreme seller").when(months < 3, "strong seller").when(months < 6, "balanced").when(months < 9, "soft buyer").otherwise("strong buyer")
    return rows.select("*", months.alias("months_of_inventory"), (F.col("expired_12mo") / F.nullif(F.col("expired_12mo") + F.col("closed_12mo"), F.lit(0))).alias("expiry_rate_12mo"), label.alias("market_label"))


def price_cuts(listings: DataFrame, year_min: int = 2023) -> DataFrame:
    """Sales whose list price came down, with the cut of the list price and of the sale."""
    cut = lambda c: F.col(c) - F.col("original_list_price")
    rows = listings.filter((F.col("status") == "Closed") & (F.year("close_date") >= year_min) & (F.col("original_list_price") > 0) & (F.col("list_price") < F.col("original_list_price")))
    return rows.select(
        "listing_id", "class_id", "city", "subdivision", "original_list_price", "list_price", "sold_price", cut("list_price").alias("list_cut_dollars"), (100 * cut("list_price") / F.col("original_list_price")).alias("list_cut_pct"),
        cut("sold_price").alias("net_total_cut"), (100 * cut("sold_price") / F.col("original_list_price")).alias("net_total_cut_pct"), "list_date", "close_date", "dom", "office_id",
    )


def cut_waterfall(listings: DataFrame, bands: DataFrame, year_min: int = 2023, least: int = 10) -> DataFrame:
    """Share of sales with a list cut, the median cut, days on market with and without; bands go by the original price."""
    done = listings.filter((F.col("status") == "Closed") & (F.col("sold_price") > 0) & (F.year("close_date") >= year_min) & (F.col("original_list_price") > 0))
    original, cut = F.col("original_list_price"), F.col("list_price") < F.col("original_list_price")
    when = lambda c, x: F.median(F.when(c, x))
    return range_join(done, bands, "original_list_price").groupBy(*COHORT).agg(
        F.count("*").alias("n"), F.count_if(cut).alias("n_with_list_cut"), (F.count_if(cut) / F.count("*")).alias("pct_with_list_cut"), when(cut, F.col("list_price") - original).alias("median_list_cut_dollars"),
        when(cut, 100 * (F.col("list_price") - original) / original).alias("median_list_cut_pct"), when(cut, F.col("dom")).alias("median_dom_with_cut"), when(~cut, F.col("dom")).alias("median_dom_no_cut"),
        F.median(100 * (F.col("sold_price") - original) / original).alias("median_net_off_orig_pct"),
    ).filter(F.col("n") >= least)


def laggards(listings: DataFrame, bands: DataFrame, year_min: int = 2020, least: int = 5) -> DataFrame:
    """Listings that did not sell, sold under 95 % of the original price or took longer than the third quartile of their year's cohort.

    Bands go by the original price; a listing whose cohort has a null in its key has no quartile.
    """
    rows = range_join(listings.filter(F.year("list_date") >= year_min), bands, "original_list_price").withColumn("year_event", F.year(F.coalesce("close_date", "off_market_date", "list_date")))
    by = ["year_event", *COHORT]
    cohorts = rows.filter("status = 'Closed' AND sold_price > 0").groupBy(*by).agg(F.count("*").alias("cohort_n"), pct("dom", 0.75, "cohort_p75_dom"), F.median("dom").alias("cohort_median_dom")).filter(F.col("cohort_n") >= least)
    closed = F.col("status") == "Closed"
    reason = F.when(F.col("status").isin("Expired/Cancelled", "Withdrawn"), "didnt_sell").when(closed & (F.col("sold_price") < 0.95 * F.col("original_list_price")), "price_cut_5pct").when(closed & (F.col("dom") > F.col("cohort_p75_dom")), "over_p75_dom")
    out = rows.join(cohorts, by, "left").withColumn("reason", reason).filter("reason IS NOT NULL")
    return out.select("listing_id", *by, "status", "list_date", "list_price", "original_list_price", "sold_price", "dom", ratio(F.col("sold_price"), F.col("original_list_price")).alias("sold_to_original"), "cohort_p75_dom", "cohort_median_dom", "cohort_n", "reason")


def fast_sellers(listings: DataFrame, bands: DataFrame, year_min: int = 2018, least: int = 5) -> DataFrame:
    """Sales within the first quartile of days of their year's cohort; bands go by the list price."""
    done = listings.filter("status = 'Closed' AND sold_price > 0 AND close_date IS NOT NULL").withColumn("close_year", F.year("close_date")).filter(F.col("close_year") >= year_min)
    rows = range_join(done, bands, "list_price").withColumn("sold_to_original", ratio(F.col("sold_price"), F.col("original_list_price")))
    by = ["close_year", *COHORT]
    cohorts = rows.groupBy(*by).agg(F.count("*").alias("cohort_n"), pct("dom", 0.25, "cohort_p25_dom"), F.median("dom").alias("cohort_median_dom"), F.median("sold_to_original").alias("cohort_median_sold_to_orig")).filter(F.col("cohort_n") >= least)
    out = rows.join(cohorts, by).filter("dom <= cohort_p25_dom")
    return out.select("listing_id", *by, "list_date", "close_date", "dom", "list_price", "original_list_price", "sold_price", "sold_to_original", "cohort_p25_dom", "cohort_median_dom", "cohort_n", "cohort_median_sold_to_orig")


def ranking(listings: DataFrame, as_of: str, who: str, least: int, days: int = 730) -> DataFrame:
    """Sales, volume, expiry rate, most frequent city (ties to the first name) and class mix of each office or agent over two years."""
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    gone = F.col("status").isin("Expired/Cancelled", "Withdrawn") & (F.col("off_market_date") >= since)
    closed = (F.col("status") == "Closed") & (F.col("close_date") >= since)
    sale = closed & (F.col("sold_price") > 0)
    recent = listings.filter(closed | gone).withColumn("grp", F.coalesce(F.col(who).cast("string"), F.lit("(unknown)")))
    of = lambda x: F.when(sale, F.col(x))
    agg = recent.groupBy("grp").agg(
        F.count_if(sale).alias("closed_n"), F.sum(of("sold_price")).alias("dollar_volume"), F.avg(of("sold_price")).alias("avg_sold"), F.median(of("sold_price")).alias("median_sold"), F.median(of("dom")).alias("dom_median"),
        F.percentile(of("dom"), 0.25).alias("dom_p25"), F.median(F.when(sale, 100 * ratio(F.col("sold_price"), F.col("original_list_price")))).alias("pct_of_orig_list"), F.count_if(gone).alias("expired_n"),
        *(F.count_if(sale & (F.col("class_id") == c)).alias(f"n_{c[:2].lower()}") for c in ("RE_1", "LD_3", "MF_2", "CM_4", "FM_5", "RN_6")),
    ).filter(F.col("closed_n") >= least)
    top = mode_per(recent.filter(closed), ["grp"], "city").select("grp", F.col("city").alias("top_city"))
    return agg.join(top, "grp", "left").withColumn("expiry_rate", F.col("expired_n") / F.nullif(F.col("closed_n") + F.col("expired_n"), F.lit(0)))


def agent_directory(ranked: DataFrame, agents: DataFrame, offices: DataFrame) -> DataFrame:
    """Rankings with names from the directories; keys of other types meet as text. Both directories are dimensions, joined as Spark sees fit."""
    a = agents.select(F.col("agent_key").cast("string").alias("grp"), "agent_name", F.col("office_key").cast("string").alias("office_key"))
    o = offices.select(F.col("office_key").cast("string").alias("office_key"), "office_name")
    return ranked.join(a, "grp", "left").join(o, "office_key", "left").drop("office_key")


def neighborhoods(listings: DataFrame, as_of: str, least_year: int = 3, least_ever: int = 10) -> DataFrame:
    """Subdivisions: sales and prices over 12 months, the trend of two half years, the dominant office, the three busiest agents, and the hot ones of each city.

    A trend without earlier sales is 99. Hot: as many sales as the city's subdivision at rank n * 3 / 4, and three at least.
    """
    day = F.lit(as_of).cast("date")
    closed = listings.filter("status = 'Closed' AND subdivision IS NOT NULL AND trim(subdivision) NOT IN ('', '-', 'None', 'OTHER', 'UNKNOWN', 'none', 'other', 'Other')")
    year, half = F.col("close_date") >= F.add_months(day, -12), F.col("close_date") >= F.add_months(day, -6)
    by = ["city", "subdivision"]
    of = lambda x: F.when(year, x)
    stats = closed.groupBy(*by).agg(
        F.count_if(year).alias("closes_12mo"), F.count_if(half).alias("closes_6mo"), F.count_if(year & ~half).alias("closes_prior_6mo"), F.count("*").alias("closes_all_time"), F.sum(of(F.col("sold_price"))).alias("volume_12mo"),
        F.avg(of(F.col("dom"))).alias("avg_dom"), F.median(of(F.col("sold_price"))).alias("median_price"), F.avg(of(100 * ratio(F.col("sold_price"), F.col("original_list_price")))).alias("avg_list_to_sale_pct"),
        F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng"),
    ).filter((F.col("closes_12mo") >= least_year) | (F.col("closes_all_time") >= least_ever))
    trend = F.when(F.col("closes_prior_6mo") > 0, F.col("closes_6mo") / F.col("closes_prior_6mo")).when(F.col("closes_6mo") > 0, 99.0).otherwise(0.0)
    place = Window.partitionBy("city").orderBy("closes_12mo", "subdivision")
    city = stats.select("city", "closes_12mo", (F.row_number().over(place) - 1).alias("i"), F.count("*").over(Window.partitionBy("city")).alias("n"))
    cut = city.filter("i = CAST(floor(n * 0.75) AS INT)").select("city", F.col("closes_12mo").alias("p75"))
    recent = closed.filter(year)
    offices = recent.groupBy(*by, "office_id").agg(F.count("*").alias("top_office_closes")).withColumn("top_office_share_pct", 100.0 * F.col("top_office_closes") / F.sum("top_office_closes").over(Window.partitionBy(*by)))
    office = first_per(offices, by, [F.desc("top_office_closes"), F.asc("office_id")]).withColumnRenamed("office_id", "top_office")
    agents = first_per(recent.groupBy(*by, "agent_id").agg(F.count("*").alias("k")), by, [F.desc("k"), F.asc("agent_id")], 3, "r")
    top = agents.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "agent_id", "k"))), lambda x: F.concat_ws(":", x["agent_id"], x["k"])), ",").alias("top_agents"))
    out = stats.join(cut, "city").withColumn("velocity_trend", trend).withColumn("is_hot", F.col("closes_12mo") >= F.greatest("p75", F.lit(3))).drop("p75")
    return out.join(office, by, "left").join(top, by, "left")


def market_index(listings: DataFrame, as_of: str | None = None, months: int = 48) -> DataFrame:
    """Monthly median price per square foot of each county's homes, smoothed over neighbouring months by sales; only sales before ``as_of``."""
    done = listings.filter("status = 'Closed' AND class_id = 'RE_1' AND close_date IS NOT NULL AND sqft > 200 AND sold_price >= 80000")
    done = done.filter(F.col("close_date") < as_of) if as_of else done
    rows = done.select("county", month_index(F.col("close_date")).alias("m"), (F.col("sold_price") / F.col("sqft")).alias("ppsf"))
    monthly = quantiles(rows, ["county", "m"], "ppsf", {"median_ppsf": 0.5}, count="n_sales")
    newest = monthly.agg(F.max("m").alias("newest"))
    near = Window.partitionBy("county").orderBy("m").rangeBetween(-1, 1)
    kept = monthly.join(F.broadcast(newest)).filter(F.col("m") > F.col("newest") - months).drop("newest")  # one row
    return kept.withColumn("smoothed_ppsf", F.sum(F.col("median_ppsf") * F.col("n_sales")).over(near) / F.sum("n_sales").over(near))


def index_ratio(index: DataFrame, months: int = 12, least: int = 8) -> DataFrame:
    """Each month's smoothed index over the one ``months`` before; null unless both months have ``least`` sales."""
    usable = F.when((F.col("n_sales") >= least) & (F.col("smoothed_ppsf") > 0), F.col("smoothed_ppsf"))
    before = index.select("county", (F.col("m") + months).alias("m"), usable.alias("before"))
    return index.select("county", "m", usable.alias("now")).join(before, ["county", "m"], "left").select("county", "m", (F.col("now") / F.col("before")).alias("ratio"))


def heatmap(listings: DataFrame, as_of: str, least: int = 5) -> DataFrame:
    """Each city and class over 12 months: prices, days, share of list prices cut by 3 % or more, months of inventory."""
    closed = (F.col("status") == "Closed") & (F.col("sold_price") > 0) & (F.col("close_date") >= F.add_months(F.lit(as_of).cast("date"), -12))
    of = lambda x: F.median(F.when(closed, x))
    cut = closed & (F.col("list_price") < F.col("original_list_price") * 0.97)
    rows = listings.groupBy("city", "class_id").agg(
        F.count_if(closed).alias("n_closed"), of(F.col("sold_price")).alias("med_sold"), of(F.col("dom")).alias("med_dom"), of(100 * ratio(F.col("sold_price"), F.col("original_list_price"))).alias("sold_pct"),
        (F.count_if(cut) * 100.0 / F.nullif(F.count_if(closed), F.lit(0))).alias("cut_pct"), F.count_if(F.col("status") == "Active").alias("n_active"),
    ).filter(F.col("n_closed") >= least)
    return rows.withColumn("months_inv", F.col("n_active") / (F.col("n_closed") / 12.0))


def prior_period_kpis(listings: DataFrame, start: str, end: str, before: str) -> DataFrame:
    """Sales, volume and median price of [start, end) against [before, start)."""
    done = sold(listings).filter((F.col("close_date") >= before) & (F.col("close_date") < end)).select("county", "sold_price", F.when(F.col("close_date") >= start, 1).otherwise(0).alias("now"))
    per = quantiles(done, ["county", "now"], "sold_price", {"median": 0.5}, count="n").join(done.groupBy("county", "now").agg(F.sum("sold_price").alias("volume")), ["county", "now"])
    pick = lambda now, x: F.max(F.when(F.col("now") == now, F.col(x)))
    return per.groupBy("county").agg(F.coalesce(pick(1, "n"), F.lit(0)).alias("sales"), F.coalesce(pick(0, "n"), F.lit(0)).alias("prior_sales"), pick(1, "volume").alias("volume"), pick(1, "median").alias("median_sold"), pick(0, "median").alias("prior_median_sold"))


def fixed_spine(listings: DataFrame, as_of: str, slots: int = 12) -> DataFrame:
    """The last ``slots`` months of each county's median price: a gap takes the month before, a gap at the start the county's median of these months; smoothed over three places."""
    day = F.lit(as_of).cast("date")
    m = month_index(F.col("close_date"))
    recent = sold(listings).select("county", m.alias("m"), "sold_price").filter(F.col("m").between(month_index(day) - slots + 1, month_index(day)))
    rows, whole = (quantiles(recent, by, "sold_price", {name: 0.5}) for by, name in ((["county", "m"], "median_sold"), (["county"], "overall")))
    spine = listings.select("county").distinct().withColumn("m", F.explode(F.sequence(month_index(day) - slots + 1, month_index(day))))
    w = Window.partitionBy("county").orderBy("m")
    filled = F.coalesce(F.last("median_sold", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "overall")
    out = spine.join(rows, ["county", "m"], "left").join(whole, "county", "left").withColumn("filled", filled).drop("overall")
    return out.withColumn("smoothed", F.avg("filled").over(w.rowsBetween(-1, 1)))


def histogram(listings: DataFrame, class_id: str = "RE_1", bins: int = 24) -> DataFrame:
    """Sold prices of each county between their 1st and 99th percentile (the values at rank int(n p)), in bins of equal width; values outside count in the end bins."""
    rows = sold(listings).filter(F.col("class_id") == class_id).select("county", F.col("sold_price").alias("x"))
    ends = quantiles(rows, ["county"], "x", {"lo": 0.01, "hi": 0.99}, count="n", low_rank=True)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1))).otherwise(0)
    return rows.join(ends, "county").groupBy("county", at.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def percent_rank(listings: DataFrame) -> DataFrame:
    """The share of its city's and class's sales below each active list price, in whole percent (half up); 50 where there is none."""
    prices = sold(listings).select("city", "class_id", F.col("sold_price").alias("x"), F.lit(1).alias("sale"), F.lit(None).cast("long").alias("listing_id"))
    asked = listings.filter("status = 'Active'").select("city", "class_id", F.col("list_price").alias("x"), F.lit(0).alias("sale"), "listing_id")
    # One sort of sales and listings together instead of a join of all with all.
    w = Window.partitionBy("city", "class_id").orderBy("x")
    ranked = prices.unionByName(asked).withColumn("below", F.sum("sale").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("sale").over(w.rangeBetween(0, 0))).withColumn("n", F.sum("sale").over(Window.partitionBy("city", "class_id")))
    return ranked.filter("sale = 0").select("listing_id", "city", "class_id", F.coalesce(F.floor((200 * F.col("below") + F.col("n")) / F.nullif(2 * F.col("n"), F.lit(0))), F.lit(50)).cast("int").alias("percentile"))


def expiring_soon(listings: DataFrame, as_of: str, days: int = 60, term: int = 180) -> DataFrame:
    """Active listings whose term ends within ``days``, soonest first."""
    day = F.lit(as_of).cast("date")
    end = F.date_add("list_date", term)
    return listings.filter((F.col("status") == "Active") & end.between(day, F.date_add(day, days))).select("listing_id", "city", "class_id", "list_price", end.alias("expiration_date"), F.datediff(end, day).cast("long").alias("days_until_expiry"))


def buyer_portal(listings: DataFrame) -> DataFrame:
    """What a buyer may see: active and pending listings with a price, active ones first."""
    rows = listings.filter("status IN ('Active', 'Pending') AND list_price > 0")
    return rows.select("listing_id", "status", "city", "class_id", "list_price", "bedrooms", "full_baths", "sqft", "acres").orderBy((F.col("status") == "Active").desc(), F.desc("list_price"), "listing_id")


def subdivision_pages(listings: DataFrame, as_of: str, years: int = 3) -> DataFrame:
    """Subdivision tear sheets: sales and prices of ``years``, what is active now, the price of a square foot."""
    done = (F.col("status") == "Closed") & (F.col("sold_price") > 0) & (F.col("close_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    live = F.col("status") == "Active"
    return listings.filter("subdivision IS NOT NULL").groupBy("county", "subdivision").agg(
        F.count_if(done).alias("sales"), F.median(F.when(done, F.col("sold_price"))).alias("median_sold"), F.min(F.when(done, F.col("sold_price"))).alias("least_sold"), F.max(F.when(done, F.col("sold_price"))).alias("most_sold"),
        F.median(F.when(done, ratio(F.col("sold_price"), F.col("sqft")))).alias("median_ppsf"), F.count_if(live).alias("active"), F.median(F.when(live, F.col("list_price"))).alias("median_asked"), F.median(F.when(done, F.col("dom"))).alias("median_dom"),
    ).filter("sales + active > 0")


def price_trend(listings: DataFrame, as_of: str, months: int = 12, least: int = 3, dead_band: float = 0.01) -> DataFrame:
    """Up, down or flat for each city: the median of the newer half of the window over that of the older, with ``least`` sales in each."""
    day = F.lit(as_of).cast("date")
    start, middle = F.add_months(day, -months), F.add_months(day, -(months // 2))
    done = sold(listings).filter((F.col("close_date") >= start) & (F.col("close_date") < day))
    new = F.col("close_date") >= middle
    rows = done.groupBy("city").agg(F.count_if(new).alias("n_recent"), F.count_if(~new).alias("n_older"), F.median(F.when(new, F.col("sold_price"))).alias("recent"), F.median(F.when(~new, F.col("sold_price"))).alias("older"))
    change = F.when((F.col("n_recent") >= least) & (F.col("n_older") >= least), F.col("recent") / F.col("older") - 1)
    return rows.withColumn("change", change).withColumn("trend", F.when(change.isNull(), F.lit(None)).when(change > dead_band, "up").when(change < -dead_band, "down").otherwise("flat"))
