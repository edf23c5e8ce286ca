"""Folders of many CSV files: as many jobs as headers, types per file, odd names."""

import pytest

from glossmill.sources import folders, tables


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()

    def write(**files):
        for name, text in files.items():
            (place / f"{name}.csv").write_text(text)
        return str(place)

    return write


def test_tables_equal_the_single_ingest(spark, folder, tmp_path):
    source = folder(**{
        "a": "x,y\n1,2\n3,4\n", "b": "x,y\n1.5,t\n", "c": "x,y\n5,6\n\n7, 8 \n", "007": "x,y\n9,\n", "with space+x": 'My Id,"a,b"\n1,"p,q"\n', "d": "\ntable_name,_key\n1,k\n",
    })
    found = folders.ingest_folder(spark, source, str(tmp_path / "out"), "2024-01-01")
    assert {r.table_name: r.row_count for r in found.collect()} == {"a": 2, "b": 1, "c": 2, "007": 1, "with space+x": 1, "d": 1}
    assert {r.path for r in found.collect() if r.table_name in "ac"} == {found.where("table_name = 'a'").first().path}
    counts = {r.table_name: r.row_count for r in tables.ingest_dir(spark, source, str(tmp_path / "single"), "2024-01-01").collect()}
    assert counts == {r.table_name: r.row_count for r in found.collect()}
    for name in counts:
        one, other = folders.ingested(spark, str(tmp_path / "out"), name), spark.read.parquet(str(tmp_path / "single" / name))
        assert one.schema == other.schema and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    with pytest.raises(LookupError):
        folders.ingested(spark, str(tmp_path / "out"), "none")


def test_refused_folders(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        folders.ingest_folder(spark, folder(), str(tmp_path / "o"), "2024-01-01")
    with pytest.raises(ValueError, match="data row"):
        folders.ingest_folder(spark, folder(a="x\n1\n", b="x\n"), str(tmp_path / "o"), "2024-01-01")
    with pytest.raises(ValueError, match="header"):
        folders.ingest_folder(spark, folder(b="x\n1\n", c="\n"), str(tmp_path / "o"), "2024-01-01")
    assert not (tmp_path / "o").exists()


def test_jobs_grow_with_headers_not_files(spark, folder, tmp_path):
    """Three hundred files of two headers need as many jobs as a hundred (above 32, Spark lists files in a job too)."""

    def jobs(source, target):
        spark.sparkContext.setJobGroup(target, target)
        try:
            assert folders.ingest_folder(spark, source, target, "2024-01-01").count()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(target))

    few = jobs(folder(**{f"t{k}": "a,b\n1,2\n" if k % 2 else "c\nx\n" for k in range(100)}), str(tmp_path / "few"))
    many = jobs(folder(**{f"t{k}": "a,b\n1,2\n" if k % 2 else "c\nx\n" for k in range(300)}), str(tmp_path / "many"))
    assert many == few
