from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glossmill import session
from glossmill.operators import kernels, keyed, lineage, pairs, profile, registry, runs, studies


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect())) if columns else sorted(map(tuple, df.collect()))


def test_sequence_over_a_hot_key(spark):
    """One key holds most rows and many buckets; NULL is a key like any other."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("name"),
        (F.col("id") * 37 % 1000).alias("at"), "id",
    )
    numbered = keyed.sequence_per_key(df, ["name"], ["at", "id"])
    found = {(r.name, r.id): r.sequence for r in numbered.collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.name, []).append((r["at"], r.id))
    expected = {(name, i): n for name, items in groups.items() for n, (_, i) in enumerate(sorted(items), 1)}
    assert found == expected


def test_a_hot_key_with_a_common_prefix_is_spread(spark):
    """Texts that share many bytes, NULL and NaN keys; the input is read for the sample and once more, by one exchange."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 20 == 1, F.lit(float("nan"))).when(F.col("id") % 20 > 1, 1.5).alias("k"), F.concat(F.lit("run-12345-"), F.hash("id").cast("string")).alias("at"), "id"
    )
    numbered = keyed.sequence_per_key(df, ["k"], ["at", "id"])
    key = lambda r: "nan" if r.k != r.k else r.k
    groups = {}
    for r in df.collect():
        groups.setdefault(key(r), []).append((r["at"], r.id))
    expected = {(name, i): n for name, items in groups.items() for n, (_, i) in enumerate(sorted(items), 1)}
    for found in (numbered, numbered.unionByName(numbered).dropDuplicates(["id"])):  # task numbers hold inside a union too
        assert {(key(r), r.id): r.sequence for r in found.collect()} == expected
    final = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("rangepartitioning") == 2 and final.count("ReusedExchange") == 1
    shares = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 3 and max(r["count"] for r in shares) < 2000
    assert keyed.sequence_per_key(df.where("id < 0"), ["k"], ["at"]).count() == 0


def test_large_lists_are_paged_and_complete(spark):
    df = spark.range(2500).select(F.when(F.col("id") < 2400, "hot").when(F.col("id") < 2450, "small").alias("k"), "id")
    lists = keyed.collect_paged(df, ["k"], F.struct("id"), ["id"], page_size=100).collect()
    assert sum(len(r["items"]) for r in lists) == 2500
    assert sorted(r.page for r in lists if r.k == "hot") == list(range(24)) and [r.page for r in lists if r.k == "small"] == [0]
    assert max(len(r["items"]) for r in lists) == 100
    assert all([x.id for x in r["items"]] == list(range(100 * r.page, 100 * r.page + 100)) for r in lists if r.k == "hot")


def test_repeated_items_fill_pages_too(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.lit(7).alias("v"), F.lit("same").alias("t"))
    for order in (["v"], ["t", "v"]):
        lists = keyed.collect_paged(df, ["k"], F.col("v"), order, page_size=10).collect()
        assert sorted((r.page, len(r["items"])) for r in lists) == [(k, 10) for k in range(10)]
    assert keyed.collect_paged(df.where("v = 8"), ["k"], F.col("v"), ["v"]).count() == 0


def test_sequences_over_texts_times_and_nulls(spark):
    df = spark.range(400).select(
        F.concat(F.lit("n"), (F.col("id") * 7 % 400).cast("string")).alias("text"), F.timestamp_seconds(F.col("id") * 31 % 400).alias("time"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 11 % 400).alias("maybe"), F.date_add(F.lit("2020-01-01"), (F.col("id") * 3 % 400).cast("int")).alias("day"), "id",
    )
    data = df.collect()
    for name in ("text", "time", "maybe", "day"):
        found = {r.id: r.sequence for r in keyed.sequence_per_key(df.withColumn("k", F.lit(1)), ["k"], [name, "id"]).collect()}
        ordered = sorted(data, key=lambda r: (r[name] is not None, r[name] if r[name] is not None else 0, r.id))
        assert found == {r.id: n for n, r in enumerate(ordered, 1)}


def test_top_rows_per_key_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = keyed.top_per_key(df, ["k"], [F.col("id").desc()], 2)
    assert rows(top) == [(0, 996), (0, 998), (1, 997), (1, 999)]
    large = keyed.top_per_key(df, ["k"], [F.col("id").desc()], 1200)
    assert large.count() == 1000
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def versions(spark):
    data = [("a1", "a", 1, None), ("a2", "a", 2, "a1"), ("a3", "a", 3, "a2"), ("b1", "b", 1, "a2")]
    return spark.createDataFrame(data, "id string, name string, version long, parent_id string")


def test_versions(spark):
    v = versions(spark)
    assert rows(registry.latest_versions(v), "name", "id") == [("a", "a3"), ("b", "b1")]
    refs = spark.createDataFrame([("a",), ("a:1",), ("b:7",), ("c",)], "ref string")
    assert rows(registry.resolve_refs(refs, v), "ref", "id") == [("a", "a3"), ("a:1", "a1")]
    new = spark.createDataFrame([("a", datetime(2024, 1, 1), 1), ("a", datetime(2024, 1, 2), 2), ("z", datetime(2024, 1, 1), 3)], "name string, at timestamp, n int")
    assert rows(registry.assign_versions(new, v, ["at"]), "n", "version") == [(1, 4), (2, 5), (3, 1)]
    assert rows(registry.list_versions(v, name="a"), "id") == [("a1",), ("a2",), ("a3",)]
    sized = spark.createDataFrame([(0, 5)], "row_count long, size_bytes long")
    assert rows(registry.zero_to_null(sized)) == [(None, 5)]


def test_links(spark):
    v = versions(spark)
    links = spark.createDataFrame([("a1", "r2", "training"), ("a1", "r1", "evaluation"), ("b1", "r1", "training")], "dataset_version_id string, run_id string, link_type string")
    nested = {r.id: [tuple(x) for x in r.runs] for r in registry.with_links(v, links).collect()}
    assert nested == {"a1": [("r1", "evaluation"), ("r2", "training")], "a2": [], "a3": [], "b1": [("r1", "training")]}
    many = spark.range(250).select(F.lit("a1").alias("dataset_version_id"), F.col("id").cast("string").alias("run_id"), F.lit("training").alias("link_type"))
    paged = registry.with_links(v, many, page_size=100).collect()
    assert sorted(r.page for r in paged if r.id == "a1") == [0, 1, 2] and len(paged) == 6
    assert len({x.run_id for r in paged for x in r.runs}) == 250 and {r.n_runs for r in paged if r.id == "a1"} == {250}
    assert rows(registry.datasets_for_runs(v, links, ["r1"]), "id", "run_id") == [("a1", "r1"), ("b1", "r1")]


def test_lineage(spark):
    v = versions(spark)
    chains = lineage.lineage(v)
    assert rows(chains, "start", "depth", "node") == [("a3", 0, "a3"), ("a3", 1, "a2"), ("a3", 2, "a1"), ("b1", 0, "b1"), ("b1", 1, "a2"), ("b1", 2, "a1")]
    starts = spark.createDataFrame([("a2",)], "id string")
    assert rows(lineage.lineage(v, starts=starts), "node") == [("a1",), ("a2",)]
    labelled = chains.join(v.select(F.col("id").alias("node"), registry.ref_text("name", "version").alias("label")), "node")
    assert rows(lineage.lineage_text(labelled, "label"), "start", "lineage") == [("a3", "a:3 <- a:2 <- a:1"), ("b1", "b:1 <- a:2 <- a:1")]


def test_lineage_of_long_chains_missing_parents_and_cycles(spark):
    chain = spark.range(300).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert rows(lineage.lineage(chain).agg(F.count("*"), F.max("depth"), F.countDistinct("node"))) == [(300, 299, 300)]
    dangling = spark.createDataFrame([("x", "gone")], "id string, parent_id string")
    assert rows(lineage.lineage(dangling), "start", "depth", "node") == [("x", 0, "x")]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        lineage.lineage(cycle, starts=cycle)
    leaf = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("leaf", "a")], "id string, parent_id string")
    with pytest.raises(ValueError, match="4 rows"):
        lineage.lineage(leaf)


def test_lineage_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20, raising=False)
    held = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in held]
    spark.conf.set(held[0], "-1")
    try:
        chain = spark.range(600).select("id", F.when(F.col("id") % 6 > 0, F.col("id") - 1).alias("parent_id"))
        chains = lineage.lineage(chain)
        sizes = chains.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) == 600 and len(sizes) >= 30 and max(sizes) <= 60
        assert rows(chains.where("start = 11")) == [(11, k, 11 - k) for k in range(6)]
        with pytest.raises(ValueError, match="cycle"):
            lineage.lineage(chain.withColumn("parent_id", F.col("id")), starts=chain)
    finally:
        spark.conf.set(held[0], before[0])
    assert [spark.conf.get(k) for k in held] == before


def test_upsert_and_keys(spark):
    old = spark.createDataFrame([(1, "a", "n"), (2, "b", None)], "k int, x string, y string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, x string")
    merged = registry.upsert(old, new, ["k"], {"y": F.lit("d")})
    assert rows(merged) == [(1, "a", "n"), (2, "b", "d"), (3, "c", "d")]
    known = spark.createDataFrame([("1", "a")], "id string, name string")
    names = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    keys = registry.ensure_keys(known, names)
    assert sorted(r.name for r in keys.collect()) == ["a", "b"] and rows(keys.where("name = 'a'")) == [("1", "a")]
    refs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc int, slug string")
    assert rows(registry.missing_refs(refs, spark.createDataFrame([("y",)], "slug string"), ["slug"]), "doc", "slug") == [(1, "x")]


def test_schema_violations(spark):
    used = spark.createDataFrame([("d", "good"), ("d", "bad"), ("d", "id"), ("unknown", "bad")], "dataset string, column_name string")
    known = spark.createDataFrame([("d", "good")], "dataset string, column_name string")
    assert rows(registry.schema_violations(used, known)) == [("d", "bad")]


def test_kernels(spark):
    data = [("k", 1, "complete", 1, "semver", None), ("k", 2, None, 2, "experiment", "r"), ("j", 1, None, 1, "semver", None)]
    v = spark.createDataFrame(data, "kernel string, version int, status string, timestamp int, strategy string, run_id string")
    assert rows(kernels.kernel_summary(v)) == [("j", 1, "semver", 1, None), ("k", 2, "experiment", 2, "complete")]
    assert rows(kernels.latest_kernel(v), "kernel", "version") == [("j", 1), ("k", 2)]
    history = kernels.kernel_history(v)
    assert rows(kernels.kernel_versions(history), "kernel", "version") == [("j", 1), ("k", 1), ("k", 2)]
    updates = spark.createDataFrame([("k", 2, "running", 1, None), ("k", 2, "error", 2, "r9"), ("k", 9, "error", 1, None)], "kernel string, version int, status string, updated_at int, run_id string")
    changed, last = kernels.apply_status(v, updates)
    assert rows(changed, "kernel", "version", "status", "run_id") == [("j", 1, None, None), ("k", 1, "complete", None), ("k", 2, "error", "r9")]
    assert rows(last) == [("k", "error")]


def test_models_and_boards(spark):
    data = [("m", 1, "READY", "r1", None), ("m", 2, "READY", "r2", "prod")]
    nested = kernels.models_nested(spark.createDataFrame(data, "name string, version int, status string, run_id string, alias string")).first()
    assert [v.version for v in nested.versions] == [1, 2] and nested.aliases == {"prod": 2}
    models = spark.createDataFrame([("c", "active"), ("c", "testing")], "competition string, status string")
    subs = spark.createDataFrame([("c", 1.5), ("c", 0.5), ("c", None)], "competition string, public_score double")
    competitions = spark.createDataFrame([("c", "minimize"), ("e", "maximize")], "competition string, metric_direction string")
    assert rows(kernels.scoreboard(models, subs, competitions)) == [("c", "minimize", 2, 1, 1, 0, 3, 0.5), ("e", "maximize", 0, 0, 0, 0, 0, None)]


def test_run_listing(spark):
    data = [
        ("a", "completed", {"bleu": 4.0, "chrf++": 9.0}, datetime(2024, 1, 2), 90.0), ("b", "training", {"bleu": 1.0}, None, None),
        ("c", "completed", {"bleu": 0.0, "chrf": 5.0}, datetime(2024, 1, 3), 0.0), ("d", None, None, datetime(2024, 1, 1), 60.0),
    ]
    df = spark.createDataFrame(data, "run string, phase string, metrics map<string,double>, updated_at timestamp, duration_seconds double")
    listed = [tuple(r)[:6] for r in runs.list_runs(df).collect()]
    assert listed == [("c", "completed", 0.0, 5.0, None, None), ("a", "completed", 4.0, 9.0, 6.0, "2m"), ("d", "unknown", None, None, None, "1m"), ("b", "training", 1.0, None, None, None)]
    assert [r.run for r in runs.list_runs(df, "completed", 1).collect()] == ["c"]
    assert [r.run for r in runs.list_runs(df, "completed", 1, limit_first=True).collect()] == ["a"]
    assert [r.run for r in runs.list_runs(df, "running").collect()] == ["b"]
    old = runs.older_than(df, 1, datetime(2024, 1, 3))
    assert rows(old, "run") == [("a",), ("b",), ("d",)]
    done, rest = runs.gate_completed(df)
    assert rows(done, "run") == [("a",), ("c",)] and rows(rest, "run", "reason") == [("b", "not completed: training"), ("d", "not completed: no status")]


def test_comparison_and_pivot(spark):
    current = spark.createDataFrame([("bleu", 12.5), ("loss", 0.5), ("new", 1.0)], "key string, value double")
    base = spark.createDataFrame([("bleu", 10.0), ("loss", 0.0)], "key string, value double")
    assert rows(runs.compare_metrics(current, base, ["key"]), "key", "delta", "percent", "change") == [("bleu", 2.5, 25.0, "+2.50 (25.0%)"), ("loss", 0.5, None, "+0.50")]
    params = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("s", "b", "3"), ("s", "z", "9")], "run string, key string, value string")
    assert rows(runs.pivot_params(params, "run", ["a", "b"])) == [("r", "1", "2"), ("s", None, "3")]


def test_search(spark):
    data = [("1", 1, {"t": "x"}, {"m": "a"}), ("2", 2, {"t": "x"}, {}), ("3", 3, {"t": "y"}, {"m": "a"})]
    df = spark.createDataFrame(data, "run_id string, start_time int, tags map<string,string>, params map<string,string>")
    assert [r.run_id for r in runs.search_runs(df, {"t": "x"}).collect()] == ["2", "1"]
    assert [r.run_id for r in runs.search_runs(df, {"t": "x"}, {"m": "a"}).collect()] == ["1"]


def test_checkpoints_and_retention(spark):
    paths = ["checkpoints/checkpoint-9/a", "checkpoints/checkpoint-10/a", "checkpoints/checkpoint-100/metrics.json", "checkpoints/checkpoint-9/b", "hf_cache/x", "output/model/w", "readme"]
    df = spark.createDataFrame([("r", p, 10) for p in paths], "run string, rel_path string, bytes long")
    assert rows(runs.latest_checkpoint(df)) == [("r", "checkpoints/checkpoint-100/metrics.json", 100)]
    assert rows(runs.stale_checkpoints(df), "rel_path") == [("checkpoints/checkpoint-9/a",), ("checkpoints/checkpoint-9/b",)]
    plan = {r.run: tuple(r)[1:] for r in runs.retention_plan(df).collect()}
    assert plan == {"r": (4, 2, 40), None: (4, 2, 40)}
    assert {r.run: r.deleted for r in runs.retention_plan(df, keep_checkpoints=True).collect()} == {"r": 1, None: 1}


def test_logs(spark):
    data = [("r", i, "stderr" if i % 2 else "stdout", "Traceback" if i % 3 == 0 else "ok") for i in range(12)]
    df = spark.createDataFrame(data, "run string, seq int, stream_name string, data string")
    assert rows(runs.filter_logs(df, "stderr", errors=True), "seq") == [(3,), (9,)]
    assert [r.seq for r in runs.log_tail(df, 3, ["run"], ["seq"]).collect()] == [9, 10, 11]
    assert rows(runs.log_counts(df, ["run"])) == [("r", 12, 6, 6)]


def test_studies(spark):
    data = [("s", "MAXIMIZE", 1, 1.0, "COMPLETE"), ("s", "MAXIMIZE", 2, 3.0, "COMPLETE"), ("s", "MAXIMIZE", 3, 3.0, "COMPLETE"), ("s", "MAXIMIZE", 4, 9.0, "PRUNED"), ("e", "MINIMIZE", 1, None, "FAIL")]
    trials = spark.createDataFrame([(*d, {"lr": str(d[2])}) for d in data], "study string, direction string, number int, value double, state string, params map<string,string>")
    assert rows(studies.study_summary(trials)) == [("e", "MINIMIZE", 1, None), ("s", "MAXIMIZE", 4, 3.0)]
    best = studies.study_best(trials, "best_").collect()
    assert [(r.study, r.best_trial, r.best_params) for r in best] == [("s", 2, {"best_lr": "2"})]
    assert rows(studies.last_trials(trials, 2), "study", "number") == [("e", 1), ("s", 3), ("s", 4)]


def test_pair_columns(spark):
    assert pairs.detect_pair_columns(["id", "src_old", "Source", "english"]) == ("Source", "english")
    assert pairs.detect_pair_columns(["a", "b", "target"]) == ("a", "b")
    assert pairs.detect_pair_columns(["input_target", "tgt"]) == ("input_target", "tgt")
    with pytest.raises(ValueError):
        pairs.detect_pair_columns(["only"])
    df = spark.createDataFrame([("x", None), (None, "y"), ("p", "q")], "source string, target string")
    assert rows(pairs.clean_pairs(df)) == [("p", "q")]
    assert rows(profile.pair_quality(df)) == [(3, 1, 1, 1.0, 1.0, 1)]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 1.5), (2, None, None)], "n int, t string, x double")
    exact = {r.column_name: (r.non_null, r.nulls, r.distinct_values, r.min, r.max) for r in profile.profile(df).collect()}
    assert exact == {"n": (3, 0, 2, 1.0, 2.0), "t": (1, 2, 1, None, None), "x": (2, 1, 1, 1.5, 1.5)}
    assert {r.column_name: r.distinct_values for r in profile.profile(df, approx=True).collect()} == {"n": 2, "t": 1, "x": 1}
    empty = profile.profile(df.select(F.lit(None).cast("string").alias("z"))).first()
    assert (empty.nulls, empty.distinct_values) == (3, 0)
