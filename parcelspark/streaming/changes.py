"""Change capture: each observation of a listing against what was last known of it, on batches and on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from parcelspark.operators.stages import settled
from parcelspark.sources.writers import replace_folder

EVENT = "listing_id long, kind string, observed_at timestamp, status string, from_status string, price double, from_price double"
_STATE = "status string, list_price double, sold_price double"


def batch_changes(seen: DataFrame) -> DataFrame:
    """Events of all observations (listing_id, observed_at, status, list_price, sold_price): new, status_change, price_change (both prices above 0), sold_price_set."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "status", "list_price", "sold_price")  # what was observed at one time goes by its content
    rows = seen.withColumns({f"from_{c}": F.lag(c).over(w) for c in ("status", "list_price", "sold_price")}).withColumn("n", F.row_number().over(w))
    first, price, old = F.col("n") == 1, F.coalesce("list_price", F.lit(0.0)), F.coalesce("from_list_price", F.lit(0.0))
    none = lambda t: F.lit(None).cast(t)
    event = lambda kind, status=none("string"), was=none("string"), p=none("double"), q=none("double"): F.struct(F.lit(kind).alias("kind"), status.alias("status"), was.alias("from_status"), p.alias("price"), q.alias("from_price"))
    events = F.array_compact(F.array(
        F.when(first, event("new", F.col("status"), p=F.col("list_price"))), F.when(~first & ~F.col("status").eqNullSafe(F.col("from_status")), event("status_change", F.col("status"), F.col("from_status"), F.col("list_price"))),
        F.when(~first & (price != old) & (price > 0) & (old > 0), event("price_change", p=F.col("list_price"), q=F.col("from_list_price"))),
        F.when(~first & (F.coalesce("from_sold_price", F.lit(0.0)) == 0) & (F.coalesce("sold_price", F.lit(0.0)) != 0), event("sold_price_set", p=F.col("sold_price"))),
    ))
    return rows.select("listing_id", "observed_at", F.explode(events).alias("e")).select("listing_id", "e.kind", "observed_at", "e.status", "e.from_status", "e.price", "e.from_price")


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One listing's new observations, in order, against the state."""
    known, out = state.get if state.exists else None, []
    rows = pd.concat(frames).sort_values("observed_at")
    clean = lambda x: None if pd.isna(x) else x
    for r in rows.itertuples():
        status, price, sold = clean(r.status), clean(r.list_price), clean(r.sold_price)
        event = lambda kind, *more: out.append((key[0], kind, r.observed_at, *more))  # noqa: E731, B023
        if known is None:
            event("new", status, None, price, None)
        else:
            was, old, gone = known
            if was != status:
                event("status_change", status, was, price, None)
            if (old or 0) != (price or 0) and (old or 0) > 0 and (price or 0) > 0:
                event("price_change", None, None, price, old)
            if not gone and sold:
                event("sold_price_set", None, None, sold, None)
        known = (status, price, sold)
    state.update(known)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])


def stream_changes(seen: DataFrame, overlap: str = "1 hour") -> DataFrame:
    """The same events from a stream, as it arrives: rows that are late across batches are compared with newer ones (``ordered.ordered_changes`` waits for them). Observations read twice (the overlap of two pulls) count once; late ones beyond ``overlap`` are dropped by the watermark."""
    once = seen.withWatermark("observed_at", overlap).dropDuplicatesWithinWatermark(["listing_id", "observed_at"])
    return once.groupBy("listing_id").applyInPandasWithState(_step, EVENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the latest observed_at of each key; of equal times that of the larger content."""
    rest = [c for c in rows.columns if c not in (key, "observed_at")]
    place = Window.partitionBy(key).orderBy(F.desc("observed_at"), *(F.desc(c) for c in rest))
    return rows.withColumn("_r", F.row_number().over(place)).filter("_r = 1").drop("_r")


def merged(old: DataFrame, fresh: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Of both the newest row of each key: one that was observed earlier never wins. Columns in ``keep`` stay as they are in ``old`` where that is known. One shuffle."""
    both = old.withColumn("_old", F.lit(True)).unionByName(fresh.withColumn("_old", F.lit(False)))
    was = {c: F.coalesce(F.max(F.when(F.col("_old"), F.col(c))).over(Window.partitionBy(key)), F.col(c)) for c in keep}
    return newest(both.withColumns(was), key).select(*old.columns)


def merge_snapshots(stream: DataFrame, snapshot: str, checkpoint: str, key: str = "listing_id", keep: list[str] = ("original_list_price",), parts: int = 64) -> None:
    """Everything available now, merged into a Parquet snapshot batch by batch: the latest row of a key wins, columns in ``keep`` stay as they first were.

    The snapshot is kept in ``parts`` folders by a hash of the key (column ``part``); a batch rewrites those that it touches, each replaced whole. A batch that runs again, or comes late, gives the same rows.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        fresh = settled(newest(batch.filter(F.col(key).isNotNull()), key))
        touched = [r.part for r in fresh.select(part.alias("part")).distinct().collect()]  # parts at most
        if not touched:
            return
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(snapshot).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [p for p in touched if fs.exists(hadoop(f"{snapshot}/part={p}"))]
        old = spark.read.schema(fresh.schema).parquet(*(f"{snapshot}/part={p}" for p in there)) if there else spark.createDataFrame([], fresh.schema)
        staged = f"{checkpoint}/staged-{uuid.uuid4().hex}"
        merged(old, fresh, key, list(keep)).withColumn("part", part).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(staged)
        for p in touched:
            replace_folder(fs, hadoop, f"{staged}/part={p}", f"{snapshot}/part={p}")
        fs.delete(hadoop(staged), True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_late(events: DataFrame, by: str, hours: int = 1) -> tuple[DataFrame, DataFrame]:
    """(in time, late) of a batch: late is what arrived (column arrived_at) more than ``hours`` after it happened."""
    late = F.col("arrived_at") > F.col(by) + F.make_interval(hours=F.lit(hours))
    return events.filter(~late), events.filter(late)
