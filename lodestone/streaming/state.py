"""Keyed state and event-time windows over streams of events and source runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BREAKER_OUT = "source string, ts timestamp, state string, fails int, open_until timestamp"
BREAKER_STATE = "fails int, open_until double, saved double"
FAILS, OPEN_SECONDS = 3, 600
#: Seconds for which a source's state is kept after its last run: twice the time for which it is open, and a minute.
KEEP_SECONDS = 2 * OPEN_SECONDS + 60


def _phase(fails: int, open_until: float, at: float) -> str:
    """Open until its time has come, half open while failures stand against it, else closed."""
    return "open" if open_until > at else "half_open" if fails else "closed"


def _fold(held: tuple[int, float, float] | None, rows: pd.DataFrame, source: str):
    """What is held after ``rows`` (fails, open until, saved at), and a row for each; at equal times successes come first."""
    out = []
    fine = rows["state"].isin(["success", "empty"])
    for ts, ok in sorted(zip(rows["ts"], ~fine, strict=True)):
        at = ts.timestamp()
        fails, until, saved = held or (0, 0.0, at)
        if at - saved > KEEP_SECONDS:  # what was held has run out
            fails, until = 0, 0.0
        fails = fails + 1 if ok else 0
        until = at + OPEN_SECONDS if fails >= FAILS else until if fails else 0.0
        held = fails, until, at
        out.append((source, ts, _phase(fails, until, at), fails, pd.Timestamp(until, unit="s") if until else pd.NaT))
    return held, pd.DataFrame(out, columns=["source", "ts", "state", "fails", "open_until"]).astype({"ts": "datetime64[us]", "open_until": "datetime64[us]"})


class _Breaker(StatefulProcessor):
    """One value a source, and one timer, at whose event time the value leaves the store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("breaker", BREAKER_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held.get() if self.held.exists() else None
        held, out = _fold(held, pd.concat(list(rows)), key[0])
        self.held.update(held)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((held[2] + KEEP_SECONDS) * 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def breaker(runs: DataFrame, late: str = "1 minute") -> DataFrame:
    """Circuit breaker per source over a stream of runs (source, ts, state): three failures in a row open it for ten minutes, a success closes it.

    One or two failures leave it half open, as does the end of the ten minutes.  State that no run has touched for
    ``KEEP_SECONDS`` of event time is gone, and its key leaves the store when the watermark (``late`` behind) passes that time.
    Rows later than the watermark are still counted, in order of arrival; within a micro-batch by time.
    """
    spark = runs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store that has timers
    keyed = runs.withWatermark("ts", late).groupBy("source")
    return keyed.transformWithStateInPandas(_Breaker(), BREAKER_OUT, "Append", "EventTime")


def breaker_batch(runs: DataFrame) -> DataFrame:
    """The same fold over a table, by window functions, so that a source of any size is sorted and spilled by Spark.

    A success, or a gap of more than ``KEEP_SECONDS``, begins an island and failures are counted inside it; the third and each later one opens the
    breaker for ten minutes from then.  At equal times successes come first.
    """
    fine = F.coalesce(F.col("state").isin("success", "empty"), F.lit(False))
    order = [F.col("ts"), F.desc("fine")]
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.select("source", F.col("ts").cast("timestamp").alias("ts"), fine.alias("fine"))
    gone = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("source").orderBy(*order))) > KEEP_SECONDS * 1_000_000
    rows = rows.withColumn("gone", F.coalesce(gone, F.lit(False)))
    rows = rows.withColumn("island", F.count_if(F.col("fine") | F.col("gone")).over(so_far("source")))
    rows = rows.withColumn("fails", F.count_if(~F.col("fine")).over(so_far("source", "island")).cast("int"))
    opened = F.col("fails") >= FAILS
    phase = F.when(opened, "open").when(F.col("fails") > 0, "half_open").otherwise("closed")
    return rows.select("source", "ts", phase.alias("state"), "fails", F.when(opened, F.col("ts") + F.expr(f"INTERVAL {OPEN_SECONDS} SECONDS")).alias("open_until"))


SEEN_OUT = "user_id bigint, seen_at timestamp"


def throttled_last_seen(events: DataFrame, minutes: int = 10) -> DataFrame:
    """A row whenever a user's last written time is ``minutes`` old; the anchor is what was written, not the last event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        written = state.get[0] if state.exists else None
        for rows in frames:
            out = []
            for ts in rows["ts"].sort_values():
                if written is None or ts.timestamp() - written >= minutes * 60:
                    written = ts.timestamp()
                    out.append((key[0], ts))
            yield pd.DataFrame(out, columns=["user_id", "seen_at"])
        if written is not None:
            state.update((written,))

    return events.groupBy("user_id").applyInPandasWithState(step, SEEN_OUT, "written double", "append", GroupStateTimeout.NoTimeout)


def rolling_activity(events: DataFrame, window: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and approximate active users per kind in sliding event-time windows; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counters(runs: DataFrame) -> DataFrame:
    """Running totals per source for a stream in complete or update mode."""
    ok = F.col("state").isin("success", "empty")
    return runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum("offers").alias("offers"), F.max("offers").alias("best"))
