"""Intermediate results that several steps read: written once to the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in ``spark.checkpoint.dir``; where that is unset, beside the warehouse, or, with Spark in one process, in a folder of our own."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="parcelspark-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return rows.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the same folder."""
    settled(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
