"""Queries over run history, logs, files, studies and votes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from glossmill.operators import runs, studies
from glossmill.plans import query
from glossmill.plans.inputs import (
    SQL_FILES, SQL_LOGS, SQL_STAMP, SQL_STATUS, SQL_TRIALS, artifact_files, logs, run_metrics, run_status, stamp, status_updates, table, trials,
)
from glossmill.session import ensure_checkpoint_dir
from glossmill.sources.run_store import read_run_store
from glossmill.streaming.status import TIMEOUT_MESSAGE, latest_state, run_timeouts


@query("list_runs", f"""
WITH {SQL_STATUS}
SELECT run, phase, bleu, chrf, round(sqrt(nullif(bleu, 0) * nullif(chrf, 0)), 6) AS combined,
  CAST(CAST(floor(duration_seconds / 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm' AS duration, strftime(updated_at, '{SQL_STAMP}') AS updated_at
FROM status WHERE phase = 'completed' ORDER BY status.updated_at DESC NULLS LAST, run LIMIT 20
""")
def list_runs(spark, folder):
    listed = runs.list_runs(run_status(spark, folder), "completed", 20)
    return listed.withColumns({"combined": F.round("combined", 6), "updated_at": stamp("updated_at")})


@query("name_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def name_contains(spark, folder):
    return runs.name_contains(table(spark, folder, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query("running_runs", """
SELECT CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'queued' END AS status, count(*) AS kernels FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1
""")
def running_runs(spark, folder):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("complete")
    kernels = table(spark, folder, "orders").select("o_orderkey", status.alias("status"))
    return runs.running(kernels).groupBy("status").agg(F.count(F.lit(1)).alias("kernels"))


@query("pending_limit", """
SELECT o_orderkey, 'pending' AS status FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10
""")
def pending_limit(spark, folder):
    status = F.when(F.col("o_orderstatus") == "P", "pending").otherwise("complete")
    submissions = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", status.alias("status"))
    return runs.pending(submissions, 10, [F.col("o_orderdate").desc(), "o_orderkey"]).select("o_orderkey", "status")


@query("search_runs", f"""
SELECT o_orderkey AS run_id, strftime(o_orderdate, '{SQL_STAMP}') AS start_time FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def search_runs(spark, folder):
    all_runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"),
        F.create_map(F.lit("kernel_type"), F.col("o_orderstatus")).alias("tags"), F.create_map(F.lit("model"), F.col("o_orderpriority")).alias("params"),
    )
    found = runs.search_runs(all_runs, {"kernel_type": "F"}, {"model": "1-URGENT"})
    return found.select("run_id", stamp("start_time").alias("start_time"))


@query("older_than", f"""
WITH {SQL_STATUS}
SELECT run, phase FROM status WHERE updated_at IS NULL OR epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(updated_at) >= 1 * 86400000000
""")
def older_than(spark, folder):
    moment = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return runs.older_than(run_status(spark, folder), 1, moment).select("run", "phase")


@query("gate_completed", f"""
WITH {SQL_STATUS}
SELECT run, phase, CASE WHEN phase <> 'completed' THEN 'not completed: ' || phase END AS reason FROM status
""")
def gate_completed(spark, folder):
    accepted, rejected = runs.gate_completed(run_status(spark, folder).select("run", "phase"))
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query("latest_state", f"""
SELECT user_id AS run, strftime(max(ts), '{SQL_STAMP}') AS updated_at, arg_max(event_type, (ts, event_type)) AS phase, arg_max(event_type, (ts, event_type)) = 'error' AS finished
FROM events GROUP BY user_id
""")
def latest_states(spark, folder):
    updates = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("updated_at"), F.col("event_type").alias("phase"))
    return latest_state(updates).withColumn("updated_at", stamp("updated_at"))


@query("run_timeouts", f"""
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type = 'purchase' AS ended, ts FROM events),
f AS (SELECT run, min(ts) + INTERVAL 172800 SECOND AS deadline, min(ts) FILTER (ended) AS done FROM u GROUP BY run)
SELECT run, CASE WHEN done <= deadline THEN 'completed' ELSE 'error' END AS status,
  strftime(CASE WHEN done <= deadline THEN done ELSE deadline END, '{SQL_STAMP}') AS ended_at,
  CASE WHEN done <= deadline THEN NULL ELSE '{TIMEOUT_MESSAGE}' END AS message
FROM f
""")
def run_timeout_outcomes(spark, folder):
    updates = status_updates(spark, folder)
    outcomes = run_timeouts(updates.withColumn("at", F.col("at").cast("timestamp")), seconds=172_800)
    return outcomes.select("run", "status", stamp("at").alias("ended_at"), "message")


@query("compare_metrics", """
WITH m AS (SELECT user_id, event_type AS key, max(value) AS value FROM events GROUP BY 1, 2),
j AS (SELECT c.user_id AS run, c.key, c.value, b.value AS baseline, c.value - b.value AS delta
  FROM m c JOIN m b ON c.key = b.key AND c.user_id = b.user_id + 1)
SELECT run, key, value, baseline, round(delta, 6) AS delta, round(100 * delta / nullif(baseline, 0), 4) AS percent,
  CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END AS direction FROM j
""")
def compare_metrics(spark, folder):
    best = run_metrics(spark, folder).groupBy("run_id", "key").agg(F.max("value").alias("value"))
    baseline = best.select((F.col("run_id") + 1).alias("run_id"), "key", "value")
    compared = runs.compare_metrics(best, baseline, ["run_id", "key"])
    direction = F.when(F.col("change").startswith("+"), "up").otherwise("down")
    return compared.select(
        F.col("run_id").alias("run"), "key", "value", "baseline", F.round("delta", 6).alias("delta"), F.round("percent", 4).alias("percent"), direction.alias("direction")
    )


@query("pivot_params", """
SELECT user_id AS run, CAST(max(CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS click,
  max(CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS view,
  max(CASE WHEN event_type = 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS error
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id
""")
def pivot_params(spark, folder):
    params = run_metrics(spark, folder).select(F.col("run_id").alias("run"), "key", F.col("step").alias("value"))
    return runs.pivot_params(params, "run", ["click", "view", "error"])


SQL_ERROR = "(regexp_matches(data, '(?i)error|exception|traceback|failed') OR contains(data, '--->'))"


@query("log_errors", f"""
WITH {SQL_LOGS}
SELECT run, seq, data FROM logs WHERE stream_name = 'stderr' AND {SQL_ERROR}
""")
def log_errors(spark, folder):
    return runs.filter_logs(logs(spark, folder), "stderr", errors=True).select("run", "seq", "data")


@query("log_counts", f"""
WITH {SQL_LOGS}
SELECT run, count(*) AS entries, count(*) FILTER (stream_name = 'stdout') AS stdout, count(*) FILTER (stream_name = 'stderr') AS stderr FROM logs GROUP BY run
""")
def log_counts(spark, folder):
    return runs.log_counts(logs(spark, folder), ["run"])


@query("log_windows", f"""
WITH {SQL_LOGS}
SELECT run, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS entries, count(*) FILTER (stream_name = 'stderr') AS stderr
FROM logs WHERE {SQL_ERROR} GROUP BY 1, 2
""")
def log_windows(spark, folder):
    from glossmill.streaming.logs import live_counts

    counts = live_counts(logs(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")), ["run"], errors=True, window="1 day")
    return counts.select("run", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "entries", "stderr")


@query("log_tail", f"""
WITH {SQL_LOGS}
SELECT run, seq, data FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS rn FROM logs) WHERE rn <= 20
""")
def log_tail(spark, folder):
    return runs.log_tail(logs(spark, folder), 20, ["run"], ["seq"]).select("run", "seq", "data")


@query("latest_checkpoint", f"""
WITH {SQL_FILES}, c AS (SELECT run, rel_path, CAST(regexp_extract(rel_path, 'checkpoint-([0-9]+)', 1) AS BIGINT) AS step FROM files WHERE contains(rel_path, 'checkpoint-'))
SELECT run, arg_max(rel_path, (step, rel_path)) AS rel_path, max(step) AS step FROM c GROUP BY run
""")
def latest_checkpoint(spark, folder):
    return runs.latest_checkpoint(artifact_files(spark, folder))


@query("stale_checkpoints", f"""
WITH {SQL_FILES}, c AS (SELECT run, rel_path, CAST(regexp_extract(rel_path, 'checkpoint-([0-9]+)', 1) AS BIGINT) AS step FROM files WHERE contains(rel_path, 'checkpoint-'))
SELECT run, rel_path, step FROM (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM c) WHERE r > 2
""")
def stale_checkpoints(spark, folder):
    return runs.stale_checkpoints(artifact_files(spark, folder)).select("run", "rel_path", "step")


@query("retention_plan", f"""
WITH {SQL_FILES}, a AS (SELECT run, bytes, CASE WHEN contains(rel_path, 'output/model/') OR contains(rel_path, 'metrics.json') THEN 'keep'
  WHEN contains(rel_path, 'hf_cache/') OR contains(rel_path, 'checkpoints/') THEN 'delete' END AS action FROM files)
SELECT run, CAST(count(*) FILTER (action = 'delete') AS BIGINT) AS deleted, CAST(count(*) FILTER (action = 'keep') AS BIGINT) AS kept,
  CAST(coalesce(sum(bytes) FILTER (action = 'delete'), 0) AS BIGINT) AS saved_bytes
FROM a GROUP BY ROLLUP (run)
""")
def retention_plan(spark, folder):
    return runs.retention_plan(artifact_files(spark, folder))


@query("study_summary", f"""
WITH {SQL_TRIALS}
SELECT study, direction, count(*) AS n_trials, CASE direction WHEN 'MAXIMIZE' THEN max(value) FILTER (state = 'COMPLETE') ELSE min(value) FILTER (state = 'COMPLETE') END AS best_value
FROM trials GROUP BY study, direction
""")
def study_summary(spark, folder):
    return studies.study_summary(trials(spark, folder))


@query("study_best", f"""
WITH {SQL_TRIALS}
SELECT study, number AS best_trial, value AS best_value, CAST(discount AS VARCHAR) || '/' || CAST(tax AS VARCHAR) AS params FROM (
  SELECT *, row_number() OVER (PARTITION BY study ORDER BY CASE direction WHEN 'MAXIMIZE' THEN -value ELSE value END, number, discount, tax) AS rn
  FROM trials WHERE state = 'COMPLETE') WHERE rn = 1
""")
def study_best(spark, folder):
    best = studies.study_best(trials(spark, folder), prefix="best_")
    params = F.concat_ws("/", F.try_element_at("best_params", F.lit("best_discount")), F.try_element_at("best_params", F.lit("best_tax")))
    return best.select("study", "best_trial", "best_value", params.alias("params"))


@query("last_trials", f"""
WITH {SQL_TRIALS}
SELECT study, number FROM (SELECT study, number, row_number() OVER (PARTITION BY study ORDER BY number DESC) AS rn FROM trials) WHERE rn <= 10
""")
def last_trials(spark, folder):
    return studies.last_trials(trials(spark, folder)).select("study", "number")


@query("weighted_vote", """
WITH v AS (SELECT l_orderkey AS id, l_returnflag || l_linestatus AS prediction, CAST(l_quantity AS BIGINT) AS weight FROM lineitem),
s AS (SELECT id, prediction, CAST(sum(weight) AS BIGINT) AS votes FROM v GROUP BY 1, 2)
SELECT id, prediction, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, prediction) AS rn FROM s) WHERE rn = 1
""")
def weighted_vote(spark, folder):
    votes = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("prediction"), F.col("l_quantity").cast("bigint").alias("weight")
    )
    return studies.weighted_vote(votes)


@query("run_store_logs", f"""
WITH {SQL_LOGS}
SELECT 'run-' || CAST(run % 20 AS VARCHAR) AS run, stream_name, CAST(seq AS DOUBLE) AS time, data FROM logs
""")
def run_store_logs(spark, folder):
    """All events as logs of twenty runs, written as the arrays that kernels write and read again by byte ranges."""
    entry = F.to_json(F.struct("stream_name", F.col("seq").cast("double").alias("time"), "data"))
    lines = logs(spark, folder).select(F.concat(F.lit(","), entry).alias("value"), F.concat(F.lit("run-"), (F.col("run") % 20).cast("string")).alias("run"))
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-store-{uuid4().hex}"
    lines.write.partitionBy("run").text(store)
    return read_run_store(spark, store, splitBytes=1 << 20).select("run", "stream_name", "time", "data")
