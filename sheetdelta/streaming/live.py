"""The same operators over streams: comparisons as their files arrive, windows over events, and jobs that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.jobs import follows
from ..plans.compare import compare
from ..schema import TERMINAL
from ..tables import ship


def compare_stream(entities: DataFrame, sheets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Compare each micro-batch of ``entities`` (both revisions of a comparison arrive in one file) and hand the changes to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            here = sheets.join(rows.select("comparison_id").distinct(), "comparison_id", "left_semi")
            sink(compare(rows, here, registered=True).deltas, number)

    return entities.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped."""
    e = _timed(events, late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    e = _timed(events, late)
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = _timed(events, late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


JOB_OUT = "job_id long, state string, expired boolean"


def job_states(updates: DataFrame, ttl_seconds: int = 86_400, late: str = "1 minute") -> DataFrame:
    """``updates`` (job_id, state, ts) to the state of each job as it changes, and a row with ``expired`` once a finished job has
    outlived its time; a finished job takes no further state."""
    ship(updates.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": [last], "expired": [True]})
            return
        last = state.get[0] if state.exists else None
        changed = False
        for frame in frames:
            for r in frame.sort_values("ts").itertuples():
                if last not in TERMINAL:
                    last, changed = r.state, True
                    until = int(r.ts.timestamp() * 1000) + ttl_seconds * 1000
                    state.update((last,))
                    if last in TERMINAL:
                        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame({"job_id": [key[0]], "state": [last], "expired": [False]})

    u = _timed(updates, late)
    return u.groupBy("job_id").applyInPandasWithState(step, JOB_OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


MOVE_OUT = "job_id long, ts timestamp, before string, state string, outcome string"


class JobMachine(StatefulProcessor):
    """The state of one job, and a timer from the time that it finishes."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        found = []
        for r in pd.concat(list(rows)).sort_values("ts", kind="stable").itertuples():
            if last is not None and r.state == last:
                continue
            legal = follows(last, r.state)
            found.append((key[0], r.ts, last, r.state, "moved" if legal else "illegal"))
            if legal:
                last = r.state
                self.state.update((last,))
                if last in TERMINAL:
                    until = int(r.ts.timestamp() * 1000) + self.ttl
                    self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(found, columns=["job_id", "ts", "before", "state", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.state.get()
        self.state.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, last, None, "expired")], columns=["job_id", "ts", "before", "state", "outcome"])

    def close(self) -> None:
        pass


def job_moves(updates: DataFrame, ttl_seconds: int = 86_400, late: str = "1 minute") -> DataFrame:
    """``updates`` (job_id, state, ts) to a row for each: job_id, ts, before, state, and outcome: moved; illegal where the state may not
    follow (unknown or null states, too; the job stays as it was); and expired once a finished job has outlived its time.  A state that
    is told again gives no row, and updates behind the watermark are dropped.  The session needs the RocksDB state store."""
    ship(updates.sparkSession)
    u = _timed(updates.select(F.col("job_id").cast("long").alias("job_id"), "state", "ts"), late)
    return u.groupBy("job_id").transformWithStateInPandas(JobMachine(ttl_seconds), MOVE_OUT, "Append", "EventTime")
