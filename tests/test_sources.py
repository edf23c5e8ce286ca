import hashlib

import pytest
from pyspark.sql import functions as F

from glossmill.sources import readers, schema, sinks, tables


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
        return str(path)

    return put


def test_names():
    raw = [" a b ", "a.b", "[x](y)", "1st", "", "a_b", "it's"]
    assert schema.sanitize_names(raw) == ["a_b", "a_b_1", "xy", "_1st", "column", "a_b_2", "it_s"]


def test_csv(spark, write):
    path = write("t.csv", 'id,my name,my name,"q ""x"""\n1, a ,,2\n2,"x, ""y""",  ,3.5\n')
    table = readers.read_table_csv(spark, path)
    assert table.columns == ["id", "my_name", "my_name_1", "q_x"]
    assert sorted(map(tuple, table.collect())) == [("1", "a", None, "2"), ("2", 'x, "y"', None, "3.5")]
    typed = readers.read_table_csv(spark, path, typed=True)
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "string", "string", "double"]
    assert sorted(map(tuple, readers.csv_name_mapping(spark, path).collect())) == [("my_name", "my name"), ("my_name_1", "my name"), ("q_x", 'q "x"')]
    with pytest.raises(ValueError):
        readers.read_table_csv(spark, write("empty.csv", "a,b\n"))


def test_types_strict_and_prefix(spark):
    rows = [("1", "1.5", "2024-01-01", "x", None), (" 2 ", "3", "12abc", "1d", ""), ("-3", "1e3", "7", "5", "  ")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    report = {compat: {r.column_name: r.type for r in schema.type_report(df, compat=compat).collect()} for compat in ("strict", "prefix")}
    assert report["strict"] == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "TEXT", "e": "TEXT"}
    assert report["prefix"] == {"a": "INTEGER", "b": "REAL", "c": "REAL", "d": "TEXT", "e": "TEXT"}
    assert [r.c for r in schema.infer_types(df, compat="prefix").collect()] == [2024.0, 12.0, 7.0]
    huge = spark.createDataFrame([("99999999999999999999",)], "a string")
    assert schema.type_report(huge).first().type == "REAL"


def test_types_come_from_all_rows_unless_a_sample_is_asked_for(spark):
    df = spark.createDataFrame([(str(i) if i < 150 else "x",) for i in range(200)], "a string").coalesce(1)
    for compat in ("prefix", "strict"):
        assert schema.infer_types(df, compat=compat).where("a = 'x'").count() == 50
    typed = schema.infer_types(df, sample=100, compat="prefix")
    assert typed.where("a is null").count() == 50 and typed.schema["a"].dataType.simpleString() == "bigint"


def test_ingest_and_metadata(spark, write, tmp_path):
    write("in/a.csv", "x,y\n1,2\n3,4\n")
    write("in/b.csv", "z\nq\n")
    counts = tables.ingest_dir(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2024-01-01T00:00:00")
    assert sorted(map(tuple, counts.collect())) == [("a", 2), ("b", 1)]
    assert spark.read.parquet(str(tmp_path / "out/a")).agg(F.sum("y")).first()[0] == 6
    metadata = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "out/a/_metadata")).collect()}
    assert metadata["row_count"] == "2" and metadata["table_name"] == "a"


def test_readers_by_name(spark, write, tmp_path):
    write("d/my_train.csv", "a,b\n1,2\n")
    write("d/deep/er/dev.csv", "a,b\n1,2\n3,4\n")
    write("d/x.jsonl", '{"a": 1}\n{"a": 2}\n')
    spark.range(3).write.parquet(str(tmp_path / "d/p.parquet"))
    assert readers.read_any(spark, str(tmp_path / "d/x.jsonl")).count() == 2
    assert readers.read_any(spark, str(tmp_path / "d/p.parquet")).count() == 3
    first = readers.read_first(spark, [str(tmp_path / "none/*.csv"), str(tmp_path / "d/*.csv")])
    assert first.count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, [str(tmp_path / "none/*.csv")])
    splits = readers.read_splits(spark, str(tmp_path / "d"))
    assert splits["train"].count() == 1 and splits["validation"].count() == 2 and splits["test"] is None
    assert readers.split_paths(["a.csv", "test.csv"], need_train=False) == {"train": ["a.csv"], "validation": [], "test": ["test.csv"]}
    write("d/train_2.csv", "b,c\n5,6\n7,8\n")
    assert readers.read_splits(spark, str(tmp_path / "d"))["train"].count() == 3
    assert readers.read_first(spark, [str(tmp_path / "d/*.csv")]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.split_paths(["a.csv"])
    lines = readers.read_lines(spark, write("l.txt", "one\n\n two\n"))
    assert [r.text for r in lines.orderBy("line_id").collect()] == ["one", " two"]


def test_run_folders(spark, write, tmp_path):
    write("r/a/metrics.json", '{"bleu": 12.5,\n "loss": 1}')
    write("r/a/eval_results.json", '{"bleu": 1}')
    write("r/b/eval_results.json", '{"bleu": 3}')
    write("r/c/metrics.json", "broken")
    metrics = {r.run: r.metrics for r in readers.read_run_metrics(spark, str(tmp_path / "r")).collect()}
    assert metrics == {"a": {"bleu": 12.5, "loss": 1.0}, "b": {"bleu": 3.0}, "c": None}
    write("r/a/status.json", '{"phase": "training", "progress": 0.4, "metrics": {"bleu": 1.5}, "updated_at": "2024-01-01T00:00:00Z"}')
    write("r/b/status.json", "{broken")
    status = {r.run: (r.phase, r.metrics) for r in readers.read_run_status(spark, str(tmp_path / "r")).collect()}
    assert status == {"a": ("training", {"bleu": 1.5}), "b": ("unknown", None)}


def test_logs(spark, write, tmp_path):
    write("k/a/x.log", '[{"stream_name":"stdout","time":1.0,"data":"hi\\n"},{"stream_name":"stderr","time":2.0,"data":"Error"}]')
    write("k/b/x.log", '[{"stream_name":"stdout","time":1.0,"data":"a"}\n,{"stream_name":"stdout","time":2.0,"data":"b"},\nnot json\n,\n]')
    found = readers.read_logs(spark, str(tmp_path / "k"))
    assert sorted((r.run, r.data) for r in found.collect()) == [("a", "Error"), ("a", "hi\n"), ("b", "a"), ("b", "b")]
    by_line = readers.read_logs(spark, str(tmp_path / "k"), lines=True).where("run = 'b'")
    assert sorted(r.data for r in by_line.collect()) == ["a", "b"]


def test_submissions(spark, write):
    path = write("s.csv", 'fileName,date,description,status,publicScore,privateScore\na.csv,2024,"x, y",SubmissionStatus.COMPLETE,1.5,\nb.csv,2024,,pending,,\nshort,1\n')
    rows = sorted(map(tuple, readers.read_submissions(spark, path).collect()))
    assert rows == [("a.csv", "2024", "x, y", "complete", 1.5, None), ("b.csv", "2024", "", "pending", None, None)]


def test_json_maps(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "oops"), (3, None)], "id int, j string")
    good, bad = readers.explode_json_map(df, "j")
    assert sorted(map(tuple, good.collect())) == [(1, "a", "1"), (1, "b", "x")]
    assert [r.id for r in bad.collect()] == [2]


def test_fingerprints_ignore_row_order(spark, write):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    assert tables.table_fingerprint(df).first() == tables.table_fingerprint(df.repartition(5).orderBy(F.rand(1))).first()
    assert tables.table_fingerprint(df).first() != tables.table_fingerprint(df.where("id <> 3")).first()
    assert tables.table_fingerprint(df.union(df.limit(2))).first() != tables.table_fingerprint(df).first()
    path = write("f.bin", "hello")
    assert tables.file_checksum(spark, path).first().sha256 == hashlib.sha256(b"hello").hexdigest()


def test_merge_and_counts(spark):
    merged = tables.merge_tables([{"t": spark.range(2).select("id"), "_x": spark.range(9)}, {"t": spark.range(3).withColumn("y", F.lit(1))}])
    assert list(merged) == ["t"] and merged["t"].count() == 5 and merged["t"].columns == ["id", "y"]
    assert [tuple(r) for r in tables.table_counts({"a": spark.range(4), "_m": spark.range(1)}).collect()] == [("a", 4)]
    assert tables.table_columns({"a": spark.range(1)}) == {"a": [("id", "bigint", 0)]}


def test_write_submission(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", (s)'), (2, "b")], "id int, translation string")
    sinks.write_submission(sinks.submission_table(df, "id", "translation", "full"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert sorted(map(tuple, back.collect())) == [("1", 'say "hi", s'), ("2", "b")]
