"""Categories as means of a target, without a row's own target in its mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
OTHER = "OTHER"


def target_means(rows: DataFrame, learnt: DataFrame, key: str, target: str, id_col: str, own: bool, out: str, most: int = 250, prior: float = 20.0) -> DataFrame:
    """``rows`` with ``out``: the mean ``target`` of their ``key`` in ``learnt``, drawn to the overall mean by the weight of ``prior`` rows.

    The ``most`` frequent keys count by themselves (ties to the smaller key), all others as one. With ``own`` the rows are those of ``learnt``, and each takes the mean of the other
    folds (by a hash of ``id_col``), overall mean included, so its own target has no part in it. Null keys are a key; with nothing learnt the mean is null.
    At most (most + 1) x (FOLDS + 1) means are broadcast.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FOLDS)).cast("int")
    cells = learnt.filter(F.col(target).isNotNull()).groupBy(name.alias("_key"), fold.alias("_fold")).agg(F.sum(F.col(target).cast("double")).alias("_s"), F.count("*").alias("_n"))
    kept = cells.groupBy("_key").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "_key").limit(most).select("_key", F.lit(True).alias("_kept"))
    cells = cells.join(F.broadcast(kept), "_key", "left").withColumn("_key", F.when(F.col("_kept"), F.col("_key")).otherwise(OTHER)).groupBy("_key", "_fold").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    folds = F.array(*map(F.lit, (*range(FOLDS), -1)))  # what is left of each fold; -1 leaves nothing out
    without = lambda c: F.sum(F.when(F.col("_fold") != F.col("_out"), F.col(c)).otherwise(0)).alias(c)
    spread = cells.withColumn("_out", F.explode(folds))
    sums = spread.groupBy("_key", "_out").agg(without("_s"), without("_n"))
    overall = spread.groupBy("_out").agg(without("_s"), without("_n")).select("_out", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("_all"))
    means = sums.join(overall, "_out").select("_key", "_out", ((F.col("_s") + prior * F.col("_all")) / (F.col("_n") + prior)).alias(out))
    asked = rows.withColumn("_out", fold if own else F.lit(-1)).withColumn("_key", name).join(F.broadcast(kept), "_key", "left").withColumn("_key", F.when(F.col("_kept"), F.col("_key")).otherwise(OTHER)).drop("_kept")
    got = asked.join(F.broadcast(means), ["_key", "_out"], "left").join(F.broadcast(overall), "_out", "left")
    return got.withColumn(out, F.coalesce(out, "_all")).drop("_key", "_out", "_all")
