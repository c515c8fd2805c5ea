"""Debounce with immediate flush as keyed state with event-time timers (L.7, L.8)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRED = "path string, op string, ts timestamp, fired_at timestamp"
#: What is known of a moment of a path: a trigger that may still fire, or an event that only cancels triggers before it.
PENDING, MARK = 1, 0


class Debounce(StatefulProcessor):
    """A trigger fires after a quiet time without another event of its path; a flush fires at once and cancels what is pending.

    State holds one entry per moment, in microseconds. An event cancels the triggers less than the quiet time before it,
    whichever of the two arrives first, so a row within the watermark's delay counts in order of its ts. A trigger fires
    when the watermark passes its quiet time; an entry is dropped once no row can arrive that it would cancel.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms, self.quiet = quiet_ms, quiet_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getMapState("moments", "at long", "kind int")

    def known(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.moments.iterator()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.known()
        events = set()
        flushes: list[int] = []
        for part in rows:
            at = part["at"].astype("int64")
            events.update(at)
            flushes += at[part["op"] == "flush"].tolist()
        # Over all moments in order, the next one decides whether a trigger stays pending; ties with a flush are cancelled.
        moments = sorted(before.keys() | events)
        now, own = {}, set(flushes)
        for at, after in zip(moments, [*moments[1:], None], strict=True):
            may = before[at] == PENDING if at in before else True
            now[at] = PENDING if may and at not in own and (after is None or after - at >= self.quiet) else MARK
        for at, kind in now.items():
            if before.get(at) != kind:
                self.moments.updateValue((at,), (kind,))
                self.handle.registerTimer(-(-at // 1000) + (self.quiet_ms if kind == PENDING else 0))
        if flushes:
            yield fired(key[0], "flush", flushes, flushes)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        quiet = []
        for at, kind in sorted(self.known().items()):
            if at + (self.quiet if kind == PENDING else 0) <= until:
                self.moments.removeKey((at,))
                quiet += [at] if kind == PENDING else []
        if quiet:
            yield fired(key[0], "trigger", quiet, [at + self.quiet for at in quiet])

    def close(self) -> None:
        pass


def fired(path: str, op: str, at: list[int], when: list[int]) -> pd.DataFrame:
    moment = lambda xs: pd.to_datetime(pd.Series(xs, dtype="int64"), unit="us")
    return pd.DataFrame({"path": [path] * len(at), "op": [op] * len(at), "ts": moment(at), "fired_at": moment(when)})


def debounced_with_flush(events: DataFrame, quiet_ms: int = 150, late: str = "10 seconds") -> DataFrame:
    """L.7, L.8: a stream of path, op (trigger or flush), ts to what fires: path, op, ts, fired_at.

    Rows later than the watermark's delay are dropped, and rows without a path or a ts; any other op counts as a trigger.
    Several triggers of one moment fire once, each flush row fires. Needs the RocksDB state store and a UTC session.
    """
    rows = events.filter("path is not null and ts is not null").select("path", "op", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    grouped = rows.withWatermark("ts", late).groupBy("path")
    return grouped.transformWithStateInPandas(Debounce(quiet_ms), FIRED, "append", "eventTime")
