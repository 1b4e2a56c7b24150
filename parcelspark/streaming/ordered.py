"""Change capture in the order of observation, whatever the order of arrival.

Observations of a listing wait in its state until the watermark has passed them; then they are taken in order of (observed_at, status, list price, sold price) and compared with what was last
known, so a stream gives the events that ``batch_changes`` gives of the same rows. Observations read twice count once. Later ones than the watermark allows are dropped
(``split_late`` sets them apart beforehand). A listing that nothing is heard of for ``retention`` after its last observation is forgotten; it would be new again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parcelspark.streaming.changes import EVENT

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [c.split()[0] for c in EVENT.split(", ")]
_UTC = dt.timezone.utc


def _micros(at: dt.datetime) -> int:
    return round((at.astimezone(_UTC) - dt.datetime(1970, 1, 1, tzinfo=_UTC)) / dt.timedelta(microseconds=1))


def transitions(known: tuple | None, status: str | None, price: float | None, sold: float | None) -> Iterator[tuple]:
    """(kind, status, from_status, price, from_price) of an observation after ``known`` (status, list price, sold price), None for the first."""
    if known is None:
        yield "new", status, None, price, None
        return
    was, old, gone = known
    if was != status:
        yield "status_change", status, was, price, None
    if (old or 0) != (price or 0) and (old or 0) > 0 and (price or 0) > 0:
        yield "price_change", None, None, price, old
    if not gone and sold:
        yield "sold_price_set", None, None, sold, None


class InOrder(StatefulProcessor):
    """State of a listing: ``waiting`` observations by time and content, ``known``: the last one taken."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, content string", "status string, list_price double, sold_price double")
        self.known = handle.getValueState("known", "at long, status string, list_price double, sold_price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at, what = _micros(r.observed_at), (r.status, r.list_price, r.sold_price)
            self.waiting.updateValue((at, repr(what)), what)
            self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.known.get() if self.known.exists() else None
        due = [(k[0], tuple(v), tuple(k)) for k, v in self.waiting.iterator() if k[0] <= passed]
        none_first = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
        out, known = [], None if last is None else tuple(last)[1:]
        for at, what, place in sorted(due, key=lambda d: (d[0], none_first(d[1]))):
            self.waiting.removeKey(place)
            seen = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at)
            out += [Row(*_FIELDS)(key[0], kind, seen, *more) for kind, *more in transitions(known, *what)]
            known = what
        if due:
            newest = max(d[0] for d in due)
            self.known.update((newest, *known))
            self.handle.registerTimer(newest // 1000 + self.retention_ms)
        elif last is not None and last[0] + self.retention_ms * 1000 <= passed and not any(True for _ in self.waiting.keys()):
            self.known.clear()
        return iter(out)

    def close(self) -> None:
        pass


def ordered_changes(seen: DataFrame, overlap: str = "1 hour", retention: dt.timedelta = dt.timedelta(days=1100)) -> DataFrame:
    """Events of a stream of (listing_id, observed_at, status, list_price, sold_price), in order of observation. Needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to STORE.

    Events come when the watermark, ``overlap`` behind the latest observation, has passed them; rows without a listing or a time are left out.
    """
    rows = seen.filter("listing_id IS NOT NULL AND observed_at IS NOT NULL").select("listing_id", "observed_at", "status", "list_price", "sold_price").withWatermark("observed_at", overlap)
    return rows.groupBy("listing_id").transformWithState(InOrder(round(retention / dt.timedelta(milliseconds=1))), EVENT, "Append", "EventTime")
