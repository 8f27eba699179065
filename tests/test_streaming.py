"""The stream of runs against the batch rules, in any order of files, with repeated and late events."""

import datetime as dt
import json
import os
import random

import pytest
from cohortflow.operators import events as batch
from cohortflow.streaming import event_log
from pyspark.sql import Row

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "run_id string, event_id string, kind string, turn_number int, ts timestamp"
START = dt.datetime(2026, 1, 1)


@pytest.fixture()
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def row(run, event, kind, turn, second):
    return {"run_id": run, "event_id": event, "kind": kind, "turn_number": turn, "ts": (START + dt.timedelta(seconds=second)).isoformat()}


def replay(spark, folder, files, lateness):
    """All rows that the stream gave, in order of batches, a file a batch."""
    data = folder / "in"
    data.mkdir()
    for i, rows in enumerate(files):
        path = data / f"{i:03}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = []
    stream = event_log.run_progress(event_log.read_events(spark, str(data), SCHEMA, "json", files_per_trigger=1), lateness=lateness)
    sink = lambda frame, i: got.extend((i, r.asDict()) for r in frame.collect())
    q = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return [r for _, r in got]


def test_any_order_of_files_gives_the_batch_status(rocks, tmp_path):
    draw = random.Random(5)
    rows = []
    for r in range(8):
        for t in range(1, 1 + (r % 4) * 2):
            rows.append(row(f"run_{r}", f"s{r}_{t}", "success", t, draw.randrange(5000)))
        rows += [row(f"run_{r}", f"e{r}_{i}", "error", 1, draw.randrange(5000)) for i in range(r // 2)]
    rows += [row("run_9", "x", "other", 1, 5), row(None, "y", "error", 1, 5), row("run_7", None, "error", 1, 5), row("run_7", "z", "success", 7, 5)]
    shuffled = rows + rows[::3]
    draw.shuffle(shuffled)
    got = replay(rocks, tmp_path, [shuffled[i::3] for i in range(3)], "10 days")
    last = {r["run_id"]: r for r in got}
    events = rocks.createDataFrame([(r["run_id"], r["event_id"], r["kind"], r["turn_number"], dt.datetime.fromisoformat(r["ts"])) for r in rows], SCHEMA)
    known = events.where("run_id IS NOT NULL AND event_id IS NOT NULL AND turn_number <= 6 AND kind <> 'other'")
    want = {r["run_id"]: r for r in batch.run_status(known.select("run_id").distinct(), known).collect()}
    assert set(last) == set(want)
    for run, w in want.items():
        g = last[run]
        assert (g["turns"], g["errors"], g["status"]) == (w["turns"], w["errors"], w["status"])
        mine = [r for r in rows if r["run_id"] == run and r["event_id"] and r["turn_number"] <= 6]
        ends = max((r["ts"] for r in mine if r["kind"] == "success"), default="")
        assert g["failures"] == sum(r["kind"] == "error" and r["ts"] > ends for r in mine)
        assert g["next_turn"] == (None if g["turns"] == 6 else g["turns"] + 1)


def test_retries_fall_due_and_end(rocks, tmp_path):
    first = [row("a", "e1", "error", 1, 0), row("b", "e1", "error", 1, 0), row("c", "s1", "success", 1, 0)]
    first += [row("d", f"e{i}", "error", 1, i) for i in range(10)]
    # Event time moves on: b answers before its wait is over, a's passes (a batch later, as watermarks do); then a fails again.
    files = [first, [row("b", "s1", "success", 1, 2)], [row("c", "s2", "success", 2, 100)], [row("c", "s2", "success", 2, 100)], [row("a", "e2", "error", 1, 200)], [row("late", "s1", "success", 1, 1)], [row("c", "s3", "success", 3, 400)], [row("c", "s4", "success", 4, 500)]]
    got = replay(rocks, tmp_path, files, "10 seconds")
    of = lambda run: [(r["status"], r["failures"], r["wait_seconds"], r["note"]) for r in got if r["run_id"] == run]
    assert of("a")[:2] == [("failed", 1, 3, None), ("failed", 1, 3, "retry_due")]
    assert of("a")[2:] == [("failed", 2, 6, None), ("failed", 2, 6, "retry_due")]
    assert of("b") == [("failed", 1, 3, None), ("partial", 0, None, None)]
    assert of("d") == [("failed", 10, None, "gave_up")]
    assert of("late") == []  # beyond the watermark by more than the lateness
    assert [r["next_turn"] for r in got if r["run_id"] == "c"] == [2, 3, 3, 4, 5]


def test_a_batch_reads_and_writes_a_runs_state_once():
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, ms):
            calls.append("timer")

        def deleteTimer(self, ms):
            calls.append("timer")

    p = event_log._Progress(6, 3, 60, 10)
    p.init(Handle())
    facts = [Row(fact=f"{1000 * i} error event {i}") for i in range(2000)] + [Row(fact=f"{1000 * i} {i % 5 + 1}") for i in range(1990, 1998)]
    for _ in range(2):
        (got,) = p.handleInputRows(("run_1",), iter(facts), None)
        assert (got.turns, got.errors, got.failures, got.next_turn, got.wait_seconds) == (5, 2000, 2, 6, 6)
    assert calls == ["get", "timer", "update", "get", "update"]


def test_an_error_that_comes_with_two_times_counts_at_the_later_one_in_any_order(rocks, tmp_path):
    late, early = row("a", "e 1", "error", 1, 50), row("a", "e 1", "error", 1, 10)
    for name, files in (("up", [[early], [late]]), ("down", [[late], [early]])):
        (tmp_path / name).mkdir()
        got = replay(rocks, tmp_path / name, [[row("a", "s", "success", 1, 20)], *files], "10 days")
        assert (got[-1]["errors"], got[-1]["failures"], got[-1]["wait_seconds"]) == (1, 1, 3)
