"""Timeouts on event-time timers: the stream equals the batch, and its state stays bounded."""

import json
import os
from datetime import datetime, timedelta

import pytest

from glossmill.streaming import status, timers
from glossmill.streaming.readers import stream_any

START = datetime(2024, 1, 1)
SCHEMA = "run string, status string, at timestamp"


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(timers.STORE)
    spark.conf.set(timers.STORE, timers.ROCKSDB)
    yield spark
    spark.conf.set(timers.STORE, before)


def written(folder, batches):
    """One file per batch of (run, status, minute), in the order in which they arrive."""
    folder.mkdir()
    for number, rows in enumerate(batches):
        path = folder / f"{number:03d}.json"
        records = [{"run": r, "status": s, "at": None if m is None else (START + timedelta(minutes=m)).isoformat()} for r, s, m in rows]
        path.write_text("\n".join(map(json.dumps, records)))
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return str(folder)


def replayed(spark, folder, checkpoint, name, **options):
    """The rows of a replay, and the rows of state after each batch."""
    query = (
        timers.watch_timeouts(stream_any(spark, folder, SCHEMA, "json", 1), **options).writeStream.format("memory").queryName(name)
        .outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(tuple(r) for r in spark.table(name).collect()), states


def test_timers_equal_the_batch(rocks, tmp_path):
    """Finished, silent, finished too late, an update older than the first one seen, ties, no time, a settled run again."""
    folder = written(tmp_path / "feed", [
        [("ok", "running", 0), ("silent", "running", 0), ("late", "running", 0), ("early", "running", 30), ("tie", "complete", 5), ("tie", "cancelled", 5), ("gone", "running", None)],
        [("ok", "complete", 60), ("silent", "running", 90), ("early", "running", 10), ("tie", "complete", 5)],
        [("tick", "running", 600)],
        [("late", "complete", 610), ("ok", "complete", 620), ("tick", "running", 630)],
        [("tick", "running", 640)],
    ])
    rows, _ = replayed(rocks, folder, tmp_path / "c", "timer_rows")
    updates = rocks.read.schema(SCHEMA).json(folder).where("at is not null")
    batch = status.run_timeouts(updates, as_of=START + timedelta(minutes=640 - 120))
    assert rows == sorted(map(tuple, batch.collect()))
    assert {r[0]: (r[1], r[2]) for r in rows} == {
        "ok": ("complete", START + timedelta(minutes=60)), "silent": ("error", START + timedelta(minutes=120)), "late": ("error", START + timedelta(minutes=120)),
        "early": ("error", START + timedelta(minutes=130)), "tie": ("cancelled", START + timedelta(minutes=5)),
    }


def test_state_of_a_long_replay_is_bounded(rocks, tmp_path):
    """Twelve runs a batch over twenty hours of batches: state holds the runs of the last hours, every run is settled once."""
    hours, each = 20, 12
    batches = [[(f"r{h}-{k}", "complete" if k % 2 else "running", 60 * h + k) for k in range(each)] for h in range(hours)]
    folder = written(tmp_path / "feed", batches + [[("tick", "running", 60 * 60)], [("tick", "complete", 60 * 60 + 1)]])
    rows, states = replayed(rocks, folder, tmp_path / "c", "bounded_rows", seconds=3600, watermark="10 minutes", forget_seconds=3600)
    assert len(rows) == len({r[0] for r in rows}) == hours * each + 1
    assert sum(r[1] == "error" for r in rows) == hours * each // 2
    # State rows are counted over the value and the two timer tables: three a run, of at most four hours of runs.
    assert max(states) <= 3 * 4 * each
    assert max(states[10:20]) <= max(states[3:10])


def test_another_state_store_is_refused(spark, tmp_path):
    folder = written(tmp_path / "feed", [[("a", "running", 0)]])
    before = spark.conf.get(timers.STORE)
    spark.conf.set(timers.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            timers.watch_timeouts(stream_any(spark, folder, SCHEMA, "json", 1))
    finally:
        spark.conf.set(timers.STORE, before)
