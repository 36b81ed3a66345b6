"""Sessions of a stream as a state machine with timers: what is open stays in the state and can be told at any time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that processors with timers need; set it before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["user_id", "start", "last", "n"]
STATE = ", ".join(f"{c} array<long>" for c in COLUMNS)
SESSION = ", ".join(f"{c} long" for c in COLUMNS)
#: Groups of users; each has one state and one timer at a time.
BUCKETS = 512


def joined(sessions: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Sessions of which those of a user that are within ``gap`` of each other are one."""
    s = sessions.sort_values(["user_id", "start"])
    user, start, n = (s[c].to_numpy() for c in ("user_id", "start", "n"))
    reach = s.groupby("user_id")["last"].cummax().to_numpy()
    first = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (start[1:] - reach[:-1] > gap)]) if len(s) else np.zeros(0, np.int64)
    end = np.r_[first[1:], len(s)][: len(first)] - 1
    return pd.DataFrame(dict(zip(COLUMNS, (user[first], start[first], reach[end], np.add.reduceat(n, first) if len(s) else n))), dtype="int64")


class SessionMachine(StatefulProcessor):
    """Open sessions of a bucket of users; an event joins those within ``gap`` of it, and those that are over are sent by a timer.

    A session is over once the watermark is beyond its last event by more than ``gap``. Late
    events that the watermark still lets through may join two sessions into one. All open
    sessions of a bucket are one value of the state, and the timer is that of the first of
    them to end, so the calls to the state go by buckets and batches, not by sessions.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _read(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(COLUMNS, self.open.get() or ([],) * len(COLUMNS))), dtype="int64")

    def _keep(self, sessions: pd.DataFrame) -> None:
        if sessions.empty:
            self.open.clear()
            return
        self.open.update(tuple(sessions[c].tolist() for c in COLUMNS))
        # the first millisecond at which the watermark tells that no event can join any more
        self.handle.registerTimer((int(sessions["last"].min()) + self.gap) * 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = self._read()
        for batch in rows:
            t = batch["timestamp"]
            sessions = joined(pd.concat([sessions, pd.DataFrame({"user_id": batch["user_id"], "start": t, "last": t, "n": 1})]), self.gap)
        self._keep(sessions)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._read()
        over = (sessions["last"] + self.gap) * 1000 < timerValues.getCurrentWatermarkInMs()
        self._keep(sessions[~over])
        yield sessions[over]

    def close(self) -> None:
        pass


def session_machine(events: DataFrame, gap: int = 1800, ts: str = "timestamp", user: str = "user_id", delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, start, last, n): sessions of a stream as they end; epochs in seconds, two events just ``gap`` apart are in one session."""
    timed = events.select(F.col(user).cast("long").alias("user_id"), F.col(ts).cast("long").alias("timestamp"), F.timestamp_seconds(F.col(ts)).alias("at")).filter("user_id is not null and timestamp is not null")
    dealt = timed.withWatermark("at", delay).withColumn("bucket", F.pmod(F.hash("user_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(SessionMachine(gap), SESSION, "append", "eventtime")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, start, last, n): the sessions that are still open in the state of a stream that has stopped."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select(F.inline(F.arrays_zip(*(F.col(f"value.{c}").alias(c) for c in COLUMNS))))
