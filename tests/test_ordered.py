"""Streams with shuffled arrival give the batch's events; snapshots keep the newest row."""

import datetime as dt
import random

import pytest

from parcelspark.streaming import changes, ordered

SCHEMA = "listing_id long, observed_at timestamp, status string, list_price double, sold_price double"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(h):
    return dt.datetime(2001, 1, 1) + dt.timedelta(hours=h)


def run(spark, tmp_path, pulls, **more):
    for pull in pulls:
        spark.createDataFrame(pull, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = ordered.ordered_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "6 hours", **more)
        events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(changes.EVENT).parquet(str(tmp_path / "out")).collect()]


def test_shuffled_arrival_equals_the_batch(spark, tmp_path, rocks):
    rnd = random.Random(8)
    rows = []
    for h in range(40):
        for i in range(6):
            if rnd.random() < 0.5:
                rows.append((i, at(h), rnd.choice(["Active", "Pending", "Closed", None]), rnd.choice([100.0, 90.0, 0.0, None]), rnd.choice([None, None, 88.0, 0.0])))
    rows += [(9, at(3), "Active", 5.0, None), (9, at(3), "Active", 4.0, None), (9, at(3), None, 4.0, None)]  # at one time: by content
    arrival = sorted(rows, key=lambda r: (r[1] - at(0)) / dt.timedelta(hours=1) + rnd.uniform(0, 5))  # within the overlap
    pulls = [arrival[i : i + 30] for i in range(0, len(arrival), 30)]
    pulls[2] = [*pulls[2], *pulls[1][-5:]]  # read again
    end = [(99, at(1000), "Active", 1.0, None)]  # lets the watermark pass everything else
    got = run(spark, tmp_path, [*pulls, [(None, at(1), "x", None, None), (3, None, "x", None, None), *end]])
    key = lambda r: tuple(map(str, r))
    want = [tuple(r) for r in changes.batch_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted((r for r in got if r[0] != 99), key=key) == sorted(want, key=key)


def test_silent_listings_are_forgotten(spark, tmp_path, rocks):
    pulls = [[(1, at(0), "Active", 1.0, None)], [(2, at(30), "Active", 1.0, None)], [(2, at(60), "Active", 1.0, None)], [(1, at(70), "Active", 1.0, None)], [(2, at(200), "Active", 1.0, None)]]
    got = run(spark, tmp_path, pulls, retention=dt.timedelta(hours=35))
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, "new", at(0)), (1, "new", at(70)), (2, "new", at(30))]


def test_stale_rows_never_win(spark, tmp_path):
    schema = "listing_id long, observed_at timestamp, original_list_price double, list_price double"
    pulls = [[(1, at(5), 9.0, 9.0), (2, at(1), 5.0, 5.0)], [(1, at(2), 10.0, 10.0), (2, at(4), 6.0, 6.0)], [(1, at(5), 9.0, 9.5), (None, at(9), 1.0, 1.0)], [(1, at(5), 9.0, 9.0)], [(3, at(0), None, 1.0), (3, at(1), 7.0, None)]]
    for pull in pulls:
        spark.createDataFrame(pull, schema).write.mode("append").parquet(str(tmp_path / "in"))
        changes.merge_snapshots(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "snap"), str(tmp_path / "cp"), parts=4)
        got = spark.read.parquet(str(tmp_path / "snap")).collect()
    assert sorted((r.listing_id, r.observed_at, r.original_list_price, r.list_price) for r in got) == [(1, at(5), 9.0, 9.5), (2, at(4), 5.0, 6.0), (3, at(1), 7.0, None)]
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == sorted({f"part={r.part}" for r in got})
