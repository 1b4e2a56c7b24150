"""Sums of whole-number arrays that tasks make, added up in a tree of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64


def tree_sum(rows: DataFrame, size: int, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of ``of`` (a task's batches -> ``size`` long integers). FAN arrays meet in a task until FAN or fewer are left for the driver.

    Whole numbers, so the sum doesn't depend on how rows are dealt. An empty table gives zeros.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of(batches).astype("<i8").tobytes()], pa.binary())], ["data"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("data"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["data"])

    sums, left = rows.mapInArrow(one, "data binary"), rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.withColumn("near", F.pmod(F.spark_partition_id(), F.lit(left))).groupBy("near").applyInArrow(add, "data binary")
    total = np.zeros(size, np.int64)
    for r in sums.collect():
        total += np.frombuffer(r.data, "<i8")
    return total
