"""Sessions of users over a stream of events: running state by user, closed by event time.

A session is a user's events with no more than ``gap`` between one and the next.
Open sessions are kept in the state store, a list a user; an event joins the
sessions that it is within a gap of, whatever order files come in. A timer is
set for the time when the watermark has passed a session's end by the gap: no
event still to come can reach it then, so it is sent out and leaves the state.

Defined results: events without user or time are left out; a repeated event_id
counts once while its session is open; events later than the watermark are left
out; sessions still open at the end of a run stay in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COLUMNS = "user_id long, started timestamp, ended timestamp, n_events long, total_value double, types array<string>"
_STATE = "started long, ended long, ids array<long>, total double, types array<string>"


class Sessions(StatefulProcessor):
    """Open sessions of a user as rows of (start, end, event ids, sum of values, types), in microseconds."""

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        before = {s[1] for s in sessions}
        for part in rows:
            part = part.sort_values(["ts", "event_id"])
            for event, at, value, kind in zip(part["event_id"], part["ts"].astype("datetime64[us]").astype("int64"), part["value"].fillna(0.0), part["event_type"]):
                near = [s for s in sessions if s[0] - self.gap <= at <= s[1] + self.gap]
                if any(event in s[2] for s in near):
                    continue
                sessions = [s for s in sessions if s not in near]
                joined = sorted([*near, (int(at), int(at), [int(event)], float(value), [kind])])
                sessions.append((joined[0][0], max(s[1] for s in joined), [i for s in joined for i in s[2]], sum(s[3] for s in joined), sorted({t for s in joined for t in s[4] if t is not None})))
        self._keep(sessions, before)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        done = sorted(s for s in sessions if s[1] + self.gap < now)
        self._keep([s for s in sessions if s[1] + self.gap >= now], {s[1] for s in sessions})
        if done:
            times = lambda i: pd.to_datetime([s[i] for s in done], unit="us", utc=True).tz_localize(None)
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "started": times(0), "ended": times(1), "n_events": [len(s[2]) for s in done], "total_value": [s[3] for s in done], "types": [list(s[4]) for s in done]})

    def _keep(self, sessions: list[tuple], before: set[int]) -> None:
        if sessions:
            self.open.put(sessions)
        elif self.open.exists():
            self.open.clear()
        now = {s[1] for s in sessions}
        for end in before - now:
            self.handle.deleteTimer(self._due(end))
        for end in now - before:
            self.handle.registerTimer(self._due(end))

    def _due(self, end: int) -> int:
        return (end + self.gap) // 1000 + 1


def user_sessions(events: DataFrame, gap_s: int = 1800, late: str = "2 hours") -> DataFrame:
    """Closed sessions of a stream of events; its state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_id", "ts", "value", "event_type").withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(gap_s), outputStructType=COLUMNS, outputMode="Append", timeMode="EventTime")


def batch_sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """The same sessions of a whole table, by islands after gaps."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros("ts")
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["event_id"])
    new = F.when(micros - F.lag(micros).over(own) <= gap_s * 1_000_000, 0).otherwise(1)
    marked = rows.withColumn("new", new).withColumn("session", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total_value"), F.array_sort(F.collect_set("event_type")).alias("types")
    ).drop("session")
