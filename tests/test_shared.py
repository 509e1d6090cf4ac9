from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from jumptrail import shared
from jumptrail.operators.ordering import ranked
from jumptrail.shared import fresh_path, shared_folder, written


def session_with(named: str | None, master: str) -> SimpleNamespace:
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf={"spark.checkpoint.dir": named}, sparkContext=context)


def test_folder_is_the_one_the_session_names():
    assert shared_folder(session_with("hdfs://shared/", "yarn")) == "hdfs://shared"
    assert fresh_path(session_with("hdfs://shared", "yarn"), "x").startswith("hdfs://shared/x-")


def test_no_folder_of_its_own_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with(None, "yarn"))


def test_written_rows_come_back(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n bigint, t string")
    assert sorted(map(tuple, written(df, "t").collect()), key=str) == [(1, "a"), (None, None)]
    assert shared_folder(spark) == shared_folder(spark)


def test_release_leaves_nothing_behind(spark, monkeypatch):
    monkeypatch.setattr(shared, "_MADE", {})
    monkeypatch.setattr(shared, "_TABLES", {})
    folder = shared_folder(spark).removeprefix("file:")
    tables = {row.tableName for row in spark.sql("SHOW TABLES").collect()}
    before = set(os.listdir(folder))
    assert ranked(spark.range(50), [F.desc("id")]).count() == 50
    written(spark.range(3), "three")
    assert len(set(os.listdir(folder)) - before) == 2
    shared.release(spark)
    assert set(os.listdir(folder)) == before
    assert {row.tableName for row in spark.sql("SHOW TABLES").collect()} == tables


def test_ranks_shuffle_rows_once(spark):
    plan = ranked(spark.range(50).withColumn("k", F.col("id") % 3), [F.desc("id")], ["k"])._jdf.queryExecution().executedPlan().toString()
    # What is left to shuffle are counts: a row per key and range.
    left = [line for line in plan.splitlines() if " Exchange " in line]
    assert "Window [row_number()" in plan and all("hashpartitioning(k" in line for line in left)


def test_shuffle_files_are_released_only_while_writing(spark):
    before = spark.conf.get(shared.RELEASE, None)
    with shared.releasing(spark):
        assert spark.conf.get(shared.RELEASE) == "true"
    assert spark.conf.get(shared.RELEASE, None) == before
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(shared.written(counted, "counted").collect()) == sorted(counted.collect()) == sorted(shared.written(counted, "again").collect())


def test_a_bucketed_table_goes_with_its_files(spark):
    table = shared.bucketed(spark.range(20), "numbers", 2, ["id"])
    path = shared._TABLES[id(spark.sparkContext)][table]
    assert spark.table(table).count() == 20
    shared.unbucketed(spark, table)
    assert not spark.catalog.tableExists(table) and not os.path.exists(path.removeprefix("file:"))


def test_small_frames_start_no_python_worker(spark):
    from jumptrail.operators import lookup
    from jumptrail.shared import few_rows, no_rows

    rows = few_rows(spark, "a long", a=[3, 5])
    nothing = no_rows(spark, "a string, b timestamp")
    assert [r.a for r in rows.collect()] == [3, 5] and nothing.columns == ["a", "b"] and nothing.count() == 0
    marks = lookup._marks(spark.range(3), [7, 8])
    for frame in (rows, nothing, marks):
        assert "ExistingRDD" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[lookup._KEY] for r in marks.collect()) == [7, 8]
