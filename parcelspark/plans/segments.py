"""Accuracy of estimates by segment, with bootstrap intervals.

Scored rows carry: id, sold_price, estimate, low, high, class_id, county, acres, sqft, has_geo. Six ways to cut them are made in one aggregation by grouping sets.
Intervals come from a Poisson bootstrap: every row takes part in each replicate with a weight that a hash of its id and the replicate gives, so nothing is resampled or held together, and a
second run gives the same figures. Medians of replicates are read from counts in steps of ``STEP`` of the error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, MOST = 0.001, 2.0
# Segments by upper bound (exclusive), the last one open.
PRICE_BANDS = [(150_000, "<150k"), (300_000, "150-300k"), (500_000, "300-500k"), (750_000, "500-750k"), (1_000_000, "750k-1M"), (None, "1M+")]
ACRE_TIERS = [(1, "<1ac"), (2, "1-2ac"), (6, "2-6ac"), (15, "6-15ac"), (40, "15-40ac"), (None, "40ac+")]
SQFT_TIERS = [(1500, "<1.5k"), (2500, "1.5-2.5k"), (3500, "2.5-3.5k"), (5000, "3.5-5k"), (None, "5k+")]
CUTS = ("class", "price_band", "acre_tier", "sqft_tier", "county", "join_success")


def tier(value: Column, tiers: list[tuple], missing: str | None = None) -> Column:
    """The label of the first tier whose bound lies above; ``missing`` for null."""
    out = F.when(value.isNull(), missing)
    for bound, label in tiers[:-1]:
        out = out.when(value < bound, label)
    return out.otherwise(tiers[-1][1])


def with_segments(scored: DataFrame) -> DataFrame:
    """``scored`` with its errors and one column for each of CUTS."""
    gap = F.col("estimate") - F.col("sold_price")
    size = F.when(F.col("sqft") > 0, F.col("sqft"))
    return scored.filter("sold_price > 0 AND estimate IS NOT NULL").select(
        "id", F.abs(gap / F.col("sold_price")).alias("ape"), (gap / F.col("sold_price")).alias("signed"), F.abs(gap).alias("off"), F.coalesce(F.col("sold_price").between(F.col("low"), F.col("high")), F.lit(False)).alias("covered"),
        F.col("class_id").alias("class"), tier(F.col("sold_price"), PRICE_BANDS).alias("price_band"), tier(F.col("acres"), ACRE_TIERS, "(no acres)").alias("acre_tier"), tier(size, SQFT_TIERS, "(no sqft)").alias("sqft_tier"),
        "county", F.when(F.col("has_geo"), "has_geo").otherwise("no_geo").alias("join_success"))


def by_segment(rows: DataFrame, aggregates: list[Column], more: tuple[str, ...] = ()) -> DataFrame:
    """cut, segment, ``more``, ``aggregates`` of rows with CUTS: each cut's segments, and cut ``overall``. One aggregation."""
    sets = [[F.col(c), *map(F.col, more)] for c in CUTS] + [list(map(F.col, more))]
    which = F.when(F.lit(False), "")
    for c in CUTS:
        which = which.when(F.grouping(c) == 0, c)
    segment = F.coalesce(*(F.when(F.grouping(c) == 0, F.coalesce(F.col(c), F.lit(""))) for c in CUTS), F.lit("all"))
    grouped = rows.groupingSets(sets, *CUTS, *more).agg(which.otherwise("overall").alias("cut"), segment.alias("segment"), *aggregates)
    return grouped.drop(*CUTS)


def segment_metrics(rows: DataFrame) -> DataFrame:
    """Of rows as ``with_segments`` makes them: n, median_ape, mape, mae, median_abs_error, ppe10, ppe20, coverage, median_signed, mean_signed of each segment."""
    share = lambda c: F.count_if(c) / F.count("*")
    return by_segment(rows, [
        F.count("*").alias("n"), F.median("ape").alias("median_ape"), F.avg("ape").alias("mape"), F.avg("off").alias("mae"), F.median("off").alias("median_abs_error"), share(F.col("ape") <= 0.10).alias("ppe10"),
        share(F.col("ape") <= 0.20).alias("ppe20"), share(F.col("covered")).alias("coverage"), F.median("signed").alias("median_signed"), F.avg("signed").alias("mean_signed"),
    ])


def poisson_weight(*keys: Column) -> Column:
    """A Poisson(1) number that the keys decide."""
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / float(1 << 40)
    out, below, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):
        below += term
        term /= k + 1
        out = out + F.when(u >= below, 1).otherwise(0)
    return out


def bootstrap(rows: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """cut, segment and, for mape, median_ape, mean_signed and ppe10, the interval of their replicates: low and high quantiles by nearest rank.

    Replicates are summed where the rows are; what is shuffled is one row for each task, segment, replicate and step of the error at most.
    """
    step = F.least(F.floor(F.col("ape") / STEP), F.lit(int(MOST / STEP))).cast("int")
    drawn = rows.withColumn("step", step).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(F.col("id"), F.col("replicate"))).filter("w > 0")
    sums = by_segment(drawn, [F.sum("w").alias("w"), F.sum(F.col("w") * F.col("ape")).alias("ape"), F.sum(F.col("w") * F.col("signed")).alias("signed"), F.sum(F.when(F.col("ape") <= 0.10, F.col("w")).otherwise(0)).alias("near")], ("replicate", "step"))
    upto = Window.partitionBy("cut", "segment", "replicate").orderBy("step")
    cells = sums.withColumn("upto", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(Window.partitionBy("cut", "segment", "replicate")))
    middle = F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("step"))) * STEP + STEP / 2
    each = cells.groupBy("cut", "segment", "replicate").agg((F.sum("ape") / F.sum("w")).alias("mape"), middle.alias("median_ape"), (F.sum("signed") / F.sum("w")).alias("mean_signed"), (F.sum("near") / F.sum("w")).alias("ppe10"))
    tail = (1 - level) / 2

    def ends(c: str) -> list[Column]:
        at = lambda q: F.element_at(F.array_sort(F.collect_list(c)), F.greatest(F.lit(1), F.ceil(q * F.count("*")).cast("int")))
        return [at(F.lit(tail)).alias(f"{c}_low"), at(F.lit(1 - tail)).alias(f"{c}_high")]

    return each.groupBy("cut", "segment").agg(*(x for c in ("mape", "median_ape", "mean_signed", "ppe10") for x in ends(c)))
