"""The event log as a stream: deduplicated events, windowed counts, each run's running state and its progress with retries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def read_events(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each event once; state is kept for `lateness` only."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: str = "event_type", time: str = "ts", width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; late ones are counted as long as the watermark allows."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def run_states(events: DataFrame, run: str = "user_id") -> DataFrame:
    """Per run: events, errors and the last event's time, updated with every batch."""
    return events.groupBy(run).agg(F.count("*").alias("events"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.max("ts").alias("last_ts"))


_RUN = "turns int, errors int, status string, next_turn int, failures int, wait_seconds int, note string"


class _Progress(StatefulProcessor):
    """A run's successes by turn, its errors by event id and the timer of its next retry: one value, read and written once a batch."""

    def __init__(self, planned: int, first: int, most: int, cycles: int):
        self.planned, self.first, self.most, self.cycles = planned, first, most, cycles

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "json string")

    def handleInputRows(self, key, rows, timerValues):
        turns, errors, due = self._read()
        for r in rows:
            # Whatever comes twice, or late, finds its own place again: the state is the same in any order.
            at, what, *event = r.fact.split(" ", 2)
            us = int(at)
            if what == "error":
                errors[event[0]] = max(errors.get(event[0], us), us)
            elif 1 <= int(what) <= self.planned:
                turns[int(what)] = max(turns.get(int(what), us), us)
        now = self._row(key, turns, errors)
        new = max(errors.values()) // 1000 + now.wait_seconds * 1000 if now.wait_seconds is not None else None
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if new is not None:
                self.handle.registerTimer(new)
        self._write(turns, errors, new)
        yield now

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        turns, errors, _ = self._read()
        self._write(turns, errors, None)
        yield self._row(key, turns, errors, "retry_due")

    def _read(self):
        old = self.state.get()
        turns, errors, due = json.loads(old[0]) if old else ({}, {}, None)
        return {int(t): us for t, us in turns.items()}, errors, due

    def _write(self, turns, errors, due):
        self.state.update((json.dumps([turns, errors, due]),))

    def _row(self, key, turns, errors, note=None):
        missing = [t for t in range(1, self.planned + 1) if t not in turns]
        last = max(turns.values(), default=None)
        failures = sum(last is None or us > last for us in errors.values())
        status = "completed" if not missing else "partial" if turns else "failed" if errors else "planned"
        wait = min(self.most, self.first * 2 ** min(failures - 1, 30)) if missing and 0 < failures < self.cycles else None
        if missing and failures >= self.cycles:
            note = "gave_up"
        return Row(run=key[0], turns=len(turns), errors=len(errors), status=status, next_turn=missing[0] if missing else None, failures=failures, wait_seconds=wait, note=note)

    def close(self) -> None:
        pass


def run_progress(events: DataFrame, planned: int = 6, first_wait: int = 3, longest_wait: int = 60, cycles: int = 10, lateness: str = "1 hour", run: str = "run_id") -> DataFrame:
    """Each run's state after every batch that touches it: turns, errors, status, next missing turn, failures since its
    last success and the seconds to wait before the next try.

    events is a stream of (run, event_id, kind, turn_number, ts), kind being success or error. A row with note
    'retry_due' comes when event time passes the wait; after `cycles` failures in a row there is no wait, and the note is
    'gave_up'. Repeated events change nothing, late ones count as long as the watermark allows, and a run's last row is
    the same in whatever order its events came; successes outside 1..planned, and rows without a run, event id or time,
    count for nothing. State: one value a run with an entry for each planned turn and each error, which a batch reads and
    writes once. Of an event that comes with several times the latest counts. The session needs the RocksDB
    state store.
    """
    usable = F.col(run).isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull()
    time = F.col("ts").cast("timestamp")
    failed = F.col("kind") == "error"
    turn = F.coalesce(F.col("turn_number").cast("int"), F.lit(0)).cast("string")
    # Workers take rows apart one by one, so what they need of a row is one text.
    rows = events.where(usable & F.col("kind").isin("success", "error")).select(
        F.col(run).cast("string").alias("run"),
        F.concat_ws(" ", F.unix_micros(time), F.when(failed, "error").otherwise(turn), F.when(failed, F.col("event_id").cast("string"))).alias("fact"),
        time.alias("time"),
    )
    states = rows.withWatermark("time", lateness).groupBy("run").transformWithState(_Progress(planned, first_wait, longest_wait, cycles), f"run string, {_RUN}", "Update", "EventTime")
    return states.withColumnRenamed("run", run)
