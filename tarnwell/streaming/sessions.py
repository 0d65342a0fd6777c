"""Sessions of events: built-in session windows, and keyed state with timers for what they cannot say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def session_windows(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", value: str = "value") -> DataFrame:
    """key, start, last, n and total of each run of events at most `gap` apart; of streams and of tables.

    On a stream a session comes out once the watermark (`late` behind the latest event) has passed its end.  Events without
    a time or a key belong to no session.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    made = timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(ts).alias("last"))
    return made.select(key, F.col("w.start").alias("start"), "last", "n", "total")


SESSION = "start timestamp, last timestamp, n long, total double, first_type string, last_type string"


class _OpenSessions(StatefulProcessor):
    """Open sessions of a key by their start; an event joins, begins or connects them, a timer closes them."""

    def __init__(self, gap_ms: int, ts: str, value: str, kind: str, key: str, key_type: str):
        self.gap, self.ts, self.value, self.kind, self.key, self.key_type = gap_ms, ts, value, kind, key, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "last long, n long, total double, first_type string, last_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = {k[0]: list(v) for k, v in self.open.iterator()}
        old = set(found)
        for pdf in rows:
            times = (pdf[self.ts].astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[getattr(pdf[self.ts].dtype, "unit", "ns")]).tolist()
            for at, value, kind in sorted(zip(times, pdf[self.value].tolist(), pdf[self.kind].tolist(), strict=True), key=lambda r: (r[0], str(r[2]))):
                mine = [s for s in found if s - self.gap <= at <= found[s][0] + self.gap]
                begun = [(at, [at, 1, 0.0 if pd.isna(value) else float(value), kind, kind]), *[(s, found.pop(s)) for s in mine]]
                start, one = min(begun, key=lambda b: b[0])
                end = max(begun, key=lambda b: b[1][0])[1]
                found[start] = [end[0], sum(b[1][1] for b in begun), sum(b[1][2] for b in begun), one[3], end[4]]
        for s in old - set(found):
            self.open.removeKey((s,))
        for s, v in found.items():
            self.open.updateValue((s,), tuple(v))
            self.handle.registerTimer(v[0] + self.gap)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, done = expiredTimerInfo.getExpiryTimeInMs(), []
        for k, v in list(self.open.iterator()):
            if v[0] + self.gap <= now:
                done.append((k[0], v))
        for s, _ in done:
            self.open.removeKey((s,))
        if done:
            when = lambda ms: pd.to_datetime(ms, unit="ms")
            yield pd.DataFrame([{self.key: key[0], "start": when(s), "last": when(v[0]), "n": v[1], "total": v[2], "first_type": v[3], "last_type": v[4]} for s, v in sorted(done)])

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, gap_minutes: int = 30, late: str = "1 day", ts: str = "ts", value: str = "value", kind: str = "event_type") -> DataFrame:
    """session_windows with the types of the first and the last event, by keyed state with event-time timers; streams only.

    Times count in milliseconds; of events of the same millisecond the order is that of their types.  A key's state holds its
    open sessions, not their events.  Events that come after the watermark has passed are left out.  The session has to keep
    its state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    timed = stream.select(key, F.col(ts).cast("timestamp").alias(ts), value, kind).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    key_type = dict(stream.dtypes)[key]
    processor = _OpenSessions(gap_minutes * 60_000, ts, value, kind, key, key_type)
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{key} {key_type}, {SESSION}", "Append", "EventTime")
