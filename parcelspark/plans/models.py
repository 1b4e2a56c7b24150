"""Models and what is read off them: value by boosted trees, price cuts, days on market by price."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.columns import clamp
from parcelspark.operators.relational import range_join
from parcelspark.operators.stages import settled
from parcelspark.plans import boosting
from parcelspark.plans.encoding import target_means

NUMBERS = ["sqft", "acres", "bedrooms", "full_baths", "year_built", "city_mean", "office_mean", "class_no"]


def features(rows: DataFrame, learnt: DataFrame, target: str, own: bool = False, most: int = 250) -> DataFrame:
    """Rows with numbers for a model: city and office as the mean ``target`` of ``learnt`` (the ``most`` frequent ones; the rest as one). With ``own``, rows of ``learnt`` itself, whose own fold is left out."""
    out = target_means(rows, learnt, "city", target, "listing_id", own, "city_mean", most)
    out = target_means(out, learnt, "office_id", target, "listing_id", own, "office_mean", most)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    kinds = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(("RE_1", "MF_2", "LD_3", "CM_4", "FM_5", "RN_6")) for x in (c, float(i))]), F.col("class_id")).alias("class_no")
    return out.select(*[c for c in rows.columns if c not in NUMBERS], *(number(c) for c in NUMBERS[:5]), "city_mean", "office_mean", F.coalesce(kinds, F.lit(6.0)).alias("class_no"))


def sales(listings: DataFrame) -> DataFrame:
    return listings.filter("status = 'Closed' AND sold_price > 30000 AND sold_price < 3500000 AND close_date IS NOT NULL")


def value_model(listings: DataFrame, until: str, trees: int = 20) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees on the logarithm of sold prices before ``until``; the model, and the sales from then on with model_value."""
    done = sales(listings)
    early, late = done.filter(F.col("close_date") < until), done.filter(F.col("close_date") >= until)
    model = Pipeline(stages=[VectorAssembler(inputCols=NUMBERS, outputCol="x"), GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=5, stepSize=0.1, seed=42)])
    fitted = model.fit(features(early, early, "sold_price", own=True).withColumn("y", F.log1p("sold_price")))
    return fitted, fitted.transform(features(late, early, "sold_price")).select("listing_id", "sold_price", F.expm1("prediction").alias("model_value"))


def cut_model(listings: DataFrame, until: str, trees: int = 15) -> DataFrame:
    """Probability that a listing's price is cut, for listings from ``until`` on, learnt on earlier ones."""
    rows = listings.filter("original_list_price > 0 AND list_price > 0").withColumn("y", (F.col("list_price") < F.col("original_list_price")).cast("double"))
    early, late = rows.filter(F.col("list_date") < until), rows.filter(F.col("list_date") >= until)
    model = Pipeline(stages=[VectorAssembler(inputCols=NUMBERS, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=4, seed=42)])
    return model.fit(features(early, early, "y", own=True)).transform(features(late, early, "y")).select("listing_id", "y", vector_to_array("probability")[1].alias("p"))


def cut_metrics(scored: DataFrame) -> DataFrame:
    """AUC and Brier score, and calibration in ten bins."""
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y").evaluate(scored)
    bins = scored.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("squares"))
    return bins.withColumn("auc", F.lit(auc))


def day_quantiles(listings: DataFrame, bands: DataFrame, until: str, least: int = 5) -> DataFrame:
    """Quartiles of days on market of each cohort before ``until``, with its class's where a cohort has too few sales."""
    done = range_join(sales(listings).filter(F.col("close_date") < until), bands, "list_price")
    q = [F.percentile("dom", p).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    wide = done.groupBy("class_id").agg(*q)
    own = done.groupBy("class_id", "city", "band").agg(F.count("*").alias("n"), *q).filter(F.col("n") >= least)
    keys = listings.select("class_id", "city").distinct().join(F.broadcast(bands.select("class_id", "band")), "class_id")
    pick = lambda c: F.coalesce(f"own.{c}", f"wide.{c}").alias(c)
    return keys.join(own.alias("own"), ["class_id", "city", "band"], "left").join(wide.alias("wide"), "class_id").select("class_id", "city", "band", *(pick(f"p{p}") for p in (25, 50, 75)))


def pinball(listings: DataFrame, bands: DataFrame, quantiles: DataFrame, since: str) -> DataFrame:
    """Pinball loss of the quartiles on sales from ``since`` on, and how many fall below each."""
    rows = range_join(sales(listings).filter(F.col("close_date") >= since), bands, "list_price").join(quantiles, ["class_id", "city", "band"])
    loss = lambda p: F.avg(F.greatest(p / 100 * (F.col("dom") - F.col(f"p{p}")), (p / 100 - 1) * (F.col("dom") - F.col(f"p{p}")))).alias(f"loss_{p}")
    below = lambda p: (F.count_if(F.col("dom") <= F.col(f"p{p}")) / F.count("*")).alias(f"below_{p}")
    return rows.groupBy("class_id").agg(F.count("*").alias("n"), *(f(p) for p in (25, 50, 75) for f in (loss, below)))


def pricing_surface(listings: DataFrame, bands: DataFrame, quantiles: DataFrame, elasticity: float = 4.0) -> DataFrame:
    """Days to expect for an active listing at 85 % to 115 % of its price in steps of 2.5: the cohort's median days times exp(elasticity x change), .4 to 3 times."""
    rows = range_join(listings.filter("status = 'Active' AND list_price > 0"), bands, "list_price").join(quantiles, ["class_id", "city", "band"])
    grid = rows.withColumn("change", F.explode(F.array(*(F.lit(round(-0.15 + 0.025 * i, 3)) for i in range(13)))))
    return grid.select("listing_id", "change", (F.col("list_price") * (1 + F.col("change"))).alias("price"), (F.col("p50") * clamp(F.exp(elasticity * F.col("change")), 0.4, 3.0)).alias("days"))


def sweet_spots(surface: DataFrame, target: float = 90.0) -> DataFrame:
    """The highest price at which a listing should still sell within ``target`` days."""
    return surface.filter(F.col("days") <= target).groupBy("listing_id").agg(F.max("price").alias("price"), F.max_by("days", "price").alias("days"))


# Days on market by boosted quantiles. Categories come in as their mean days.
DAY_NUMBERS = ["list_price", "original_list_price", "sqft", "bedrooms", "full_baths", "acres", "year_built", "assessed", "price_per_sqft", "age_at_list", "list_month", "price_to_assessed", "list_to_original"]
DAY_MEANS = {"city": "city_days", "class_id": "class_days", "subdivision": "subdivision_days", "agent_id": "agent_days", "office_id": "office_days"}
DAY_QUANTILES = (0.25, 0.5, 0.75)
MOST_DAYS, LEAST_ROWS = 180, 200


def day_features(rows: DataFrame, learnt: DataFrame, own: bool = False) -> DataFrame:
    """``rows`` with DAY_NUMBERS and the means; what can't be worked out is null. ``own`` as in :func:`features`."""
    return _day_numbers(_day_means(rows, learnt, own))


def _day_numbers(rows: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when((F.col(b) > 0) & (F.col(a) > 0), F.col(a) / F.col(b))
    return rows.withColumns({
        "price_per_sqft": ratio("list_price", "sqft"), "age_at_list": F.when(F.col("year_built") > 1700, F.year("list_date") - F.col("year_built")), "list_month": F.month("list_date"),
        "price_to_assessed": F.when(F.col("assessed") > 0, F.col("list_price") / F.col("assessed")), "list_to_original": F.when(F.col("original_list_price") > 0, F.col("list_price") / F.col("original_list_price")),
    })


def _day_means(rows: DataFrame, learnt: DataFrame, own: bool = False) -> DataFrame:
    for key, name in DAY_MEANS.items():
        rows = target_means(rows, learnt, key, "dom", "listing_id", own, name)
    return rows


def day_sales(listings: DataFrame, most: int = MOST_DAYS) -> DataFrame:
    """Closed sales with a price, both dates and 0 to ``most`` days on market."""
    return listings.filter(f"status = 'Closed' AND sold_price > 0 AND close_date IS NOT NULL AND list_date IS NOT NULL AND dom BETWEEN 0 AND {most}")


def day_model(listings: DataFrame, until: str, rounds: int = 12) -> tuple[boosting.Trees, DataFrame]:
    """Trees for the quartiles of days on market, learnt on sales that closed before ``until``; and those sales. Fewer than LEAST_ROWS of them are refused."""
    early = settled(day_sales(listings).filter(F.col("close_date") < until))
    if early.count() < LEAST_ROWS:
        raise ValueError(f"fewer than {LEAST_ROWS} sales to learn from")
    table = settled(day_features(early, early, own=True).select("dom", *DAY_NUMBERS, *DAY_MEANS.values()))
    return boosting.fit(table, [*DAY_NUMBERS, *DAY_MEANS.values()], "dom", DAY_QUANTILES, rounds), early


def day_predictions(listings: DataFrame, until: str, rounds: int = 12) -> DataFrame:
    """listing_id, class_id, dom, p25, p50, p75 of the sales from ``until`` on."""
    model, early = day_model(listings, until, rounds)
    late = day_sales(listings).filter(F.col("close_date") >= until)
    return boosting.predicted(model, day_features(late, early), ["listing_id", "class_id", "dom"])


def day_metrics(predictions: DataFrame) -> DataFrame:
    """By class and over all (class_id null): n, mean absolute error of the median, share within the quartiles, pinball losses, mean days as whole rows add up."""
    loss = lambda q: F.avg(F.greatest(q * (F.col("dom") - F.col(f"p{round(100 * q)}")), (q - 1) * (F.col("dom") - F.col(f"p{round(100 * q)}")))).alias(f"pinball_{round(100 * q)}")
    inside = F.avg(F.col("dom").between(F.col("p25"), F.col("p75")).cast("double")).alias("coverage")
    return predictions.rollup("class_id").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("dom") - F.col("p50"))).alias("mae"), inside, *map(loss, DAY_QUANTILES))


def price_for_days(model: boosting.Trees, early: DataFrame, subjects: DataFrame, target: float = 60.0, span: float = 0.25, step: int = 5_000) -> DataFrame:
    """The highest price at which a listing should sell within ``target`` days: its list price (else its assessment, else 250,000) less and plus ``span`` in steps of ``step``, 25,000 at least.

    listing_id, feasible, price, days: where no price of the grid will do, feasible is false and price that of the fewest days (the lowest of equal ones).
    """
    anchor = F.coalesce(F.nullif(F.col("list_price"), F.lit(0.0)), F.nullif(F.col("assessed").cast("double"), F.lit(0.0)), F.lit(250_000.0))
    low, high = F.greatest(F.floor(anchor * (1 - span)), F.lit(25_000)), F.floor(anchor * (1 + span))
    last = (high + step - 1).cast("long")
    grid = F.when(low <= last, F.sequence(low.cast("long"), F.greatest(low.cast("long"), last), F.lit(step).cast("long")))
    # Means don't hang on the price: worked out once a listing, and rows are dealt by number, as they are few in bytes before the grid and long in time.
    kept = ["listing_id", "list_price", "original_list_price", "sqft", "bedrooms", "full_baths", "acres", "year_built", "assessed", "list_date", *DAY_MEANS.values()]
    wide = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _day_means(subjects, early).select(*kept).repartition(wide, "listing_id")
    rows = rows.withColumn("_price", F.explode(grid)).withColumn("list_price", F.col("_price").cast("double")).drop("_price")
    best = boosting.best_offers(model, _day_numbers(rows), "listing_id", "list_price", "p50", target)
    return best.select("listing_id", F.col("hit").isNotNull().alias("feasible"), F.coalesce("hit", "near").alias("price"), F.coalesce("hit_p", "near_p").alias("days"))
