"""Registering as one operation: repeated calls, parents, links, buckets, files."""

import os

import pytest
from pyspark.sql import functions as F

from glossmill.operators import registration as reg

NEW = "name string, checksum string, row_count long, size_bytes long, source_path string, created_at string, parent string, run_id string"


def listing(spark, store):
    return sorted((r.name, r.version, r.checksum) for r in reg.registered(spark, store).collect())


def files(store):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(store) for f in names if f.endswith(".parquet"))


def test_checksum_is_of_the_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 1, ""), ("b", None, "1:x")], "g string, n int, t string")
    one = {r.g: tuple(r) for r in reg.describe(df.repartition(3), ["g"]).collect()}
    assert one == {r.g: tuple(r) for r in reg.describe(df.orderBy(F.desc("n")), ["g"]).collect()}
    assert one["a"][1] == 3 and reg.describe(df.where("g = 'a'").drop("g")).first().checksum == one["a"][3]
    assert reg.describe(df.where("g = 'a'").dropDuplicates().drop("g")).first().checksum != one["a"][3]
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None)], "x string, y string")
    assert len({r.checksum for r in reg.describe(shifted.withColumn("k", F.monotonically_increasing_id()), ["k"]).collect()}) == 4
    empty = reg.describe(df.where("false").drop("g")).first()
    assert (empty.row_count, empty.size_bytes) == (0, 0) and empty.checksum


def test_two_calls_give_one_row(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("a", "c1", 3, 30, "s", "2024-01-01", None, "run-1"), ("a", "c2", 0, 0, "s", "2024-01-02", None, None), ("a", "c1", 3, 30, "s", "2024-01-03", None, "run-1"), (None, "c9", 1, 1, "s", "2024-01-01", None, None)]
    new = spark.createDataFrame(rows, NEW)
    done = {(r.name, r.checksum): (r.version, r.outcome, r.row_count) for r in reg.register(new, store, ["created_at"]).collect()}
    assert done == {("a", "c1"): (1, "new", 3), ("a", "c2"): (2, "new", None), (None, "c9"): (None, "no_name", 1)}
    before = files(store)
    again = reg.register(new, store, ["created_at"]).collect()
    assert {r.outcome for r in again if r.name} == {"known"} and files(store) == before
    assert listing(spark, store) == [("a", 1, "c1"), ("a", 2, "c2")]
    links = [tuple(r) for r in reg.registered_links(spark, store).select("name", "run_id", "link_type").collect()]
    assert links == [("a", "run-1", "training")]
    # The same content from another source is a version of its own; a known version can gain a link.
    more = spark.createDataFrame([("a", "c1", 3, 30, "other", "2024-02-01", None, None), ("a", "c2", 0, 0, "s", "2024-02-01", None, "run-2")], NEW)
    assert {(r.version, r.outcome) for r in reg.register(more, store, ["created_at"]).collect()} == {(3, "new"), (2, "known")}
    assert reg.registered_links(spark, store).count() == 2


def test_parents_and_untouched_buckets(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(f"set-{k}", f"c{k}", k + 1, 1, "s", "2024-01-01", None, None) for k in range(200)], NEW)
    reg.register(first, store, ["created_at"])
    assert reg.registered(spark, store).count() == 200
    before = files(store)
    new = spark.createDataFrame([
        ("child", "x", 1, 1, "s", "2024-01-02", "set-7", None), ("child", "y", 1, 1, "s", "2024-01-03", "set-9:1", None),
        ("child", "z", 1, 1, "s", "2024-01-04", "set-9:2", None), ("child", "w", 1, 1, "s", "2024-01-05", "nothing", None),
    ], NEW)
    done = {r.checksum: r for r in reg.register(new, store, ["created_at"]).collect()}
    assert {c: (r.version, r.outcome) for c, r in done.items()} == {"x": (1, "new"), "y": (2, "new"), "z": (None, "parent_not_found"), "w": (None, "parent_not_found")}
    ids = {r.name: r.id for r in reg.registered(spark, store).where("name like 'set-%'").collect()}
    assert (done["x"].parent_version_id, done["y"].parent_version_id) == (ids["set-7"], ids["set-9"])
    assert len(ids) == 200 and len(set(before) - set(files(store))) <= 1


def test_no_rows(spark, tmp_path):
    assert reg.register(spark.createDataFrame([], NEW), str(tmp_path / "s"), ["created_at"]).count() == 0
    assert reg.registered(spark, str(tmp_path / "s")).count() == 0


def test_a_file_from_reading_to_link(spark, tmp_path):
    store, path = str(tmp_path / "store"), tmp_path / "in.csv"
    path.write_text("My Id,score\n1,2.5\n2,\n3,4.5\n")
    one = reg.register_file(spark, str(path), store, "raw", "2024-01-01", run_id="r1", notes="first").first()
    assert (one.name, one.version, one.row_count, one.outcome) == ("raw", 1, 3, "new") and '"notes":"first"' in one.metadata
    assert spark.read.parquet(one.table_path).agg(F.sum("score")).first()[0] == 7.0
    before = files(store)
    assert reg.register_file(spark, str(path), store, "raw", "2024-01-02", run_id="r1").first().outcome == "known"
    assert files(store) == before and reg.registered_links(spark, store).count() == 1
    path.write_text("My Id,score\n1,2.5\n")
    two = reg.register_file(spark, str(path), store, "raw", "2024-01-03", parent="raw").first()
    assert (two.version, two.parent_version_id) == (2, one.id)
    with pytest.raises(LookupError):
        reg.register_file(spark, str(path), store, "raw", "2024-01-04", parent="raw:9")
    assert listing(spark, store) == [("raw", 1, one.checksum), ("raw", 2, two.checksum)]
