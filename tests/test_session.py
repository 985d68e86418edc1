"""Intermediates and what is left of them."""

import glob

import pytest

from riskloom.session import bucketed, fresh_path, materialize, scratch, shared_dir, written


def left(spark):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*"))


def test_scratch_leaves_the_result_alone(spark):
    written(spark.range(1), fresh_path(spark, "first"))  # so that the folder is there
    path, tables = fresh_path(spark, "kept"), {t.name for t in spark.catalog.listTables()}
    before = left(spark)
    with scratch(spark):
        a = materialize(spark.range(100), "a")
        with scratch(spark):
            materialize(a, "inner")
        b = bucketed(a, "b", "id")
        out = written(a.join(b, "id"), path)
    assert out.count() == 100
    assert {p.rpartition("/")[2] for p in left(spark) - before} == {path.rpartition("/")[2]}
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_scratch_goes_after_an_error_too(spark):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(10), "a")
        1 / 0  # noqa: B018
    assert left(spark) == before
    assert "scratch" not in fresh_path(spark, "next")


def test_bucketed_tables_leave_no_name_and_join_without_a_shuffle(spark):
    names = {t.name for t in spark.catalog.listTables()}
    rows = spark.range(2000).selectExpr("id", "id % 7 AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = bucketed(rows, "a", "id"), bucketed(rows.selectExpr("id", "k AS j"), "b", "id")
        assert {t.name for t in spark.catalog.listTables()} == names
        both = a.join(b, "id")
        assert both.count() == 2000 and both.where("k <> j").count() == 0
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
