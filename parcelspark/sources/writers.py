"""Writers: reports as CSV, pools as Parquet that is replaced whole, merges that keep what must stay."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, one_file: bool = False, excel: bool = False) -> None:
    """A report with a header. ``excel`` puts a byte order mark before the first column's name; ``one_file`` suits small reports only."""
    out = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0]) if excel else rows
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def replace_parquet(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """A pool written beside the old one, then renamed into its place: a reader sees the old or the new whole."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(fresh)
    hadoop = jvm.org.apache.hadoop.fs.Path
    replace_folder(hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop, fresh, path)


def replace_folder(fs, hadoop, fresh: str, path: str) -> None:
    """``fresh`` renamed to ``path``. Until it is there the old folder stays under a name of its own, from which a next call takes it back after a crash in between."""
    old = f"{path}.old"
    if fs.exists(hadoop(old)) and not fs.exists(hadoop(path)):
        fs.rename(hadoop(old), hadoop(path))
    fs.delete(hadoop(old), True)
    fs.mkdirs(hadoop(path).getParent())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(fresh), hadoop(path))
    fs.delete(hadoop(old), True)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Old rows overwritten by new ones of the same key; columns in ``keep`` stay as they first were where that is known."""
    a, b = old.alias("a"), new.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    fresh = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in (key, *keep) else F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return rows.select(*(pick(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and the new ones whose key, nulls as empty, is not there; of new rows with one key one stays."""
    name = lambda df: F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    fresh = new.withColumn("_k", name(new)).dropDuplicates(["_k"]).join(old.select(name(old).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return old.unionByName(fresh)


def geojson(rows: DataFrame, lat: str, lng: str, properties: list[str]) -> DataFrame:
    """One GeoJSON point a row, as text: a line-delimited layer."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.round(lng, 6), F.round(lat, 6)).alias("coordinates"))
    feature: Column = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")))
    return rows.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(feature.alias("feature"))


def write_month(snapshot: DataFrame, path: str, month: str) -> None:
    """One month's snapshot; writing a month again replaces that month alone."""
    rows = snapshot.withColumn("snapshot_month", F.lit(month))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_month").parquet(path)
