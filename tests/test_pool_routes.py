"""Routing by file name or pool folder, listing without reading, narrow exceptions."""

import pytest
from pyspark.errors import AnalysisException

from citeflow.session import read_or_none
from citeflow.sources import papers as SP
from citeflow.sources import pools as P


def write(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_a_parent_folder_does_not_route(spark, tmp_dir):
    root = f"{tmp_dir}/latest_run/2024"
    write(spark, f"{root}/high", ['{"_id": "h1"}'])
    write(spark, f"{root}/latest/day=2024-01-01", ['{"pub_id": "l1"}'])
    write(spark, f"{root}/scholar", ['{"s": [{"event_pub_id": "e1"}, {"pub_id": "e2"}]}'])
    write(spark, f"{root}/other", ['{"pub_id": "no"}'])
    got = P.route(spark, [f"{root}/{d}" for d in ("high", "latest", "scholar", "other", "missing")]).collect()
    assert {(r.pool, r.paper_id) for r in got} == {("high", "h1"), ("latest", "l1"), ("scholar", "e1"), ("scholar", "e2")}


def test_empty_files_are_listed(spark, tmp_dir):
    write(spark, f"{tmp_dir}/pool/a", ["x"])
    open(f"{tmp_dir}/pool/a/empty.json", "w").close()
    got = P.discover(spark, [f"{tmp_dir}/pool", f"{tmp_dir}/missing"]).collect()
    assert "empty.json" in {r.file_name for r in got} and len(got) == 2


def test_only_a_missing_table_counts_as_missing(spark, tmp_dir):
    assert read_or_none(spark, f"{tmp_dir}/none") is None
    open(f"{tmp_dir}/broken.parquet", "w").write("no parquet")
    with pytest.raises(Exception) as e:
        read_or_none(spark, f"{tmp_dir}/broken.parquet")
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")


def test_corrupt_lines_need_no_cached_scan(spark, tmp_dir):
    write(spark, f"{tmp_dir}/p", ['{"_id": "a", "id_of_mysql": 1}', '{"_id": "b", "id_of', ''])
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    good, bad = SP.split_corrupt(SP.read_papers_raw(spark, f"{tmp_dir}/p"))
    assert [r.id_of_mysql for r in good.collect()] == [1] and bad.count() == 1
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before
    rows = SP.first_n(good, -1)
    assert rows.count() == 1 and SP.first_n(good, 0).count() == 0
