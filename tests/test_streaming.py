import json
from datetime import datetime, timedelta

import pytest

from glossmill.streaming import logs, status
from glossmill.streaming.readers import stream_any

START = datetime(2024, 1, 1)


def at(minutes):
    return (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S")


@pytest.fixture
def feed(tmp_path):
    """Files of a feed, in the order in which they arrive."""
    import os

    folder = tmp_path / "feed"
    folder.mkdir()

    def put(batches):
        for number, records in enumerate(batches):
            path = folder / f"{number:03d}.json"
            path.write_text("\n".join(json.dumps(r) for r in records))
            os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
        return str(folder)

    return put


@pytest.fixture
def drain(spark, tmp_path):
    """Everything a streaming query puts out until its input is used up."""

    def run(df, mode, name):
        query = (
            df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]

    return run


def test_latest_state_of_a_stream_equals_the_batch(spark, feed, drain):
    schema = "run string, phase string, progress double, updated_at timestamp"
    folder = feed([
        [{"run": "a", "phase": "training", "progress": 0.1, "updated_at": at(0)}, {"run": "b", "phase": "training", "progress": 0.1, "updated_at": at(1)}],
        [{"run": "a", "phase": "completed", "progress": 1.0, "updated_at": at(5)}, {"run": "b", "phase": "evaluating", "progress": 0.9, "updated_at": at(4)}],
        [{"run": "a", "phase": "training", "progress": 0.5, "updated_at": at(2)}],
    ])
    streamed = drain(status.watch_status(stream_any(spark, folder, schema, "json", 1)), "complete", "latest")
    batch = status.latest_state(spark.read.schema(schema).json(folder))
    assert sorted(streamed) == sorted(map(tuple, batch.collect()))
    assert {r[0]: r[2:] for r in streamed} == {"a": ("completed", 1.0, True), "b": ("evaluating", 0.9, False)}


def test_timeouts_of_a_stream_equal_the_batch(spark, feed, drain):
    schema = "run string, status string, at timestamp"
    folder = feed([
        [{"run": "ok", "status": "running", "at": at(0)}, {"run": "slow", "status": "running", "at": at(0)}, {"run": "late", "status": "running", "at": at(0)}],
        [{"run": "ok", "status": "complete", "at": at(60)}, {"run": "slow", "status": "running", "at": at(90)}],
        [{"run": "tick", "status": "running", "at": at(600)}],
        [{"run": "late", "status": "complete", "at": at(610)}, {"run": "ok", "status": "complete", "at": at(620)}, {"run": "tick", "status": "running", "at": at(630)}],
        [{"run": "tick", "status": "running", "at": at(640)}],
    ])
    streamed = drain(status.detect_timeouts(stream_any(spark, folder, schema, "json", 1)), "append", "timeouts")
    updates = spark.read.schema(schema).json(folder)
    batch = status.run_timeouts(updates, as_of=datetime(2024, 1, 1, 10, 40))
    assert sorted(streamed) == sorted(map(tuple, batch.collect()))
    assert {r[0]: r[1] for r in streamed} == {"ok": "complete", "slow": "error", "late": "error"}
    assert {r.run for r in status.run_timeouts(updates).collect()} == {"ok", "slow", "late", "tick"}


def test_log_counts_of_a_stream_equal_the_batch(spark, feed, drain):
    schema = "run string, seq long, stream_name string, data string, ts timestamp"

    def entry(run, seq, stream, data, minute):
        return {"run": run, "seq": seq, "stream_name": stream, "data": data, "ts": at(minute)}

    folder = feed([
        [entry("a", 1, "stderr", "Error x", 0), entry("a", 2, "stdout", "fine", 1), entry("a", 1, "stderr", "Error x", 0)],
        [entry("a", 3, "stderr", "Traceback", 30), entry("b", 4, "stdout", "failed", 70), entry("a", 1, "stderr", "Error x", 0)],
        [entry("z", 9, "stdout", "error tick", 1000)],
        [entry("z", 10, "stdout", "fine", 1001)],
    ])
    source = stream_any(spark, folder, schema, "json", 1)
    total = drain(logs.live_counts(logs.unique_entries(source, ["run", "seq"]), ["run"], errors=True), "complete", "totals")
    batch = spark.read.schema(schema).json(folder).dropDuplicates(["run", "seq"])
    assert sorted(total) == sorted(map(tuple, logs.live_counts(batch, ["run"], errors=True).collect()))
    assert sorted(total) == [("a", 2, 0, 2), ("b", 1, 1, 0), ("z", 1, 1, 0)]
    unique = logs.unique_entries(source, ["run", "seq"])
    windows = logs.live_counts(unique, ["run"], errors=True, window="1 hour", watermark=None)
    found = drain(windows, "append", "windows")
    expected = [tuple(r) for r in logs.live_counts(batch, ["run"], errors=True, window="1 hour").collect()]
    assert sorted(found) == sorted(r for r in expected if r[0] != "z")
    errors = drain(logs.live_errors(source, "stderr").select("run", "seq"), "append", "errors")
    assert sorted(set(errors)) == [("a", 1), ("a", 3)]


def test_stream_formats(spark, tmp_path, drain):
    spark.range(3).select("id").write.parquet(str(tmp_path / "p"))
    spark.range(3).select("id").write.csv(str(tmp_path / "c"), header=True)
    for kind, folder in (("parquet", "p"), ("csv", "c")):
        rows = drain(stream_any(spark, str(tmp_path / folder), "id long", kind), "append", f"rows_{kind}")
        assert sorted(rows) == [(0,), (1,), (2,)]


def test_latest_state_with_a_map_of_metrics(spark):
    """Maps have no order: they are carried along and decide no tie."""
    schema = "run string, phase string, updated_at timestamp, metrics map<string,double>"
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    updates = spark.createDataFrame([("a", "training", early, {"bleu": 1.0}), ("a", "completed", late, {"bleu": 2.0}), ("b", "training", late, None)], schema)
    found = {r.run: (r.phase, r.metrics, r.finished) for r in status.latest_state(updates).collect()}
    assert found == {"a": ("completed", {"bleu": 2.0}, True), "b": ("training", None, False)}
