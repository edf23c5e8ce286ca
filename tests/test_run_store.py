import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glossmill.sources import run_store
from glossmill.sources.readers import STATUS, read_logs
from glossmill.sources.run_store import entries, parsed, read_run_store, stream_run_store
from glossmill.streaming import logs, status
from glossmill.streaming.late import late_rows

NASTY = ['plain', 'with "quotes" and {"data": 1}', 'line\nbreak ], [ {', "brace {", 'é 漢 "}', '{"stream_name":"stdout"}', "", "\\"]


def entry(k):
    return {"stream_name": ("stdout", "stderr")[k % 2], "time": k / 4, "data": f"{k} {NASTY[k % len(NASTY)]}"}


def texts(n):
    own = [json.dumps(entry(k), ensure_ascii=k % 3 > 0) for k in range(n)]
    return {"array": "[" + "\n,".join(own) + "]", "dense": "[" + ",".join(own) + "]", "lines": "\n".join(own) + "\n", "indented": json.dumps([entry(k) for k in range(n)], indent=1)}


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "runs"
    for name, text in texts(60).items():
        (root / name).mkdir(parents=True)
        (root / name / "kernel.log").write_text(text)
    (root / "broken").mkdir()
    (root / "broken" / "kernel.log").write_text('no json\n{"stream_name": "stdout", "time": "soon", "data": {"x"\n' + json.dumps(entry(1)) + '\n{"other": 1}{"time": 2}')
    (root / "empty").mkdir()
    (root / "empty" / "kernel.log").write_text("")
    return root


def test_every_cut_of_a_log_gives_the_same_entries(store):
    for name in texts(1):
        path = str(store / name / "kernel.log")
        size = (store / name / "kernel.log").stat().st_size
        for cut in (1, 7, 64, 997, size):
            found = []
            with open(path, "rb") as source:
                for piece in run_store._pieces(name, path, 0, size, cut):
                    found += entries(source, piece)
            assert [e for _, e in found] == [entry(k) for k in range(60)], (name, cut)


def test_a_log_is_read_by_several_tasks(spark, store):
    df = read_run_store(spark, str(store), splitBytes=1000)
    assert df.rdd.getNumPartitions() > 8
    rows = df.orderBy("run", "file", "at").collect()
    for name in texts(1):
        own = [(r.stream_name, r.time, r.data) for r in rows if r.run == name]
        assert own == [tuple(entry(k).values()) for k in range(60)]
    assert [(r.stream_name, r.time, r.data) for r in rows if r.run == "broken"] == [tuple(entry(1).values())]
    whole = read_logs(spark, str(store)).where("run not in ('broken', 'empty')")
    assert sorted(map(tuple, whole.drop("seq").collect())) == sorted((r.run, r.stream_name, r.time, r.data) for r in rows if r.run not in ("broken", "empty"))


def test_filters_on_runs_choose_files(spark, store):
    assert read_run_store(spark, str(store)).where("run = 'lines'").count() == 60
    spark.conf.set(run_store.PUSHDOWN, "true")
    try:
        for condition, parts in (("run = 'lines'", 1), ("run in ('lines', 'array', 'gone')", 2), ("run like 'in%'", 1), ("stream_name = 'stdout'", 6)):
            found = read_run_store(spark, str(store), splitBytes=run_store.STEP).where(condition)
            assert found.rdd.getNumPartitions() <= parts
            assert found.where("run in ('lines', 'array', 'indented')").count() in (60, 90, 120)
    finally:
        spark.conf.unset(run_store.PUSHDOWN)


def test_tailing_a_growing_log_equals_the_batch(spark, tmp_path):
    """The log grows in the middle of entries; a second run of the query goes on where the first ended."""
    root = tmp_path / "runs"
    (root / "run=a").mkdir(parents=True)
    (root / "run=b").mkdir()
    text = texts(50)["array"].encode()
    cuts = [0, 30, 31, 500, 501, 1400, len(text)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        with open(root / "run=a" / "kernel.log", "ab") as out:
            out.write(text[a:b])
        if number == 2:
            (root / "run=b" / "kernel.log").write_text(json.dumps(entry(7)))
        stream = stream_run_store(spark, str(root), splitBytes=700)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        assert query.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, read_run_store(spark, str(root)).collect()))
    assert streamed.where("run = 'a'").count() == 50 and streamed.where("run = 'b'").count() == 1


def test_status_files_that_change_come_again(spark, tmp_path):
    root = tmp_path / "runs"
    for name in ("a", "b"):
        (root / name).mkdir(parents=True)
        (root / name / "status.json").write_text(json.dumps({"phase": "training", "progress": 0.5}))
    seen = []
    for phase in ("", "completed"):
        if phase:
            time.sleep(0.02)
            (root / "b" / "status.json").write_text(json.dumps({"phase": phase, "progress": 1.0}))
        query = stream_run_store(spark, str(root), "status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [2, 3]
    found = parsed(spark.read.parquet(str(tmp_path / "out")), STATUS).select("run", F.col("at").alias("updated_at"), "phase", "progress")
    assert {r.run: r.phase for r in status.latest_state(found).collect()} == {"a": "training", "b": "completed"}
    assert {r.run for r in read_run_store(spark, str(root), "metrics").collect()} == set()


def test_late_rows_are_counted_exactly(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: (start + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S")
    folder = tmp_path / "feed"
    folder.mkdir()
    batches = [[(1, 0), (2, 5)], [(3, 600)], [(4, 610)], [(5, 1), (6, 2), (7, 3), (8, 605)], [(9, 4), (10, 620)]]
    schema = "run string, seq long, stream_name string, data string, ts timestamp"
    with late_rows(spark) as late:
        runs = []
        for number, rows in enumerate(batches):
            (folder / f"{number}.json").write_text("\n".join(json.dumps({"run": "a", "seq": s, "stream_name": "stdout", "data": "x", "ts": at(m)}) for s, m in rows))
            source = spark.readStream.schema(schema).json(str(folder))
            counted = logs.live_counts(logs.unique_entries(source, ["run", "seq"]), ["run"], window="1 hour", watermark=None)
            query = counted.writeStream.queryName("windows").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
            query.processAllAvailable()
            query.stop()
            runs.append(query.runId)
        for _ in range(100):
            if all(late.ended(r) for r in runs):
                break
            time.sleep(0.1)
        assert late.totals() == {"windows": 4}
        table = late.table(spark)
        assert table.agg(F.sum("late_rows")).first()[0] == 4 and {r.kind for r in table.where("late_rows > 0").collect()} == {"dedupeWithinWatermark"}
        late.write(spark, str(tmp_path / "late"))
    assert spark.read.parquet(str(tmp_path / "late")).agg(F.sum("late_rows")).first()[0] == 4
