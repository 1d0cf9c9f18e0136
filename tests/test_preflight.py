"""Preflights: one scan, findings and counters that agree, and what passes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import preflight as pre


def rules():
    return {"a": {"big": ("error", F.col("v") > 8), "odd": ("note", F.col("v") % 2 == 1)}, "b": {"none": ("warning", F.col("v").isNull())}}


def test_all_rules_share_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as k", "case when id <> 4 then id end as v", "'x' as rule").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = pre.findings(rows, "k", rules())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    found, report = pre.run(rows, "k", rules())
    assert sorted((r["k"], r["of"], r["rule"], r["severity"]) for r in found.collect()) == [(1, "a", "odd", "note"), (3, "a", "odd", "note"), (4, "b", "none", "warning"), (5, "a", "odd", "note"), (7, "a", "odd", "note"), (9, "a", "big", "error"), (9, "a", "odd", "note")]
    assert sorted(map(tuple, report.collect())) == [("a", "big", "error", 1, 10, False), ("a", "odd", "note", 5, 10, False), ("b", "none", "warning", 1, 10, True)]
    counted = {(r["of"], r["rule"]): r["count"] for r in found.groupBy("of", "rule").count().collect()}
    assert counted == {(r["of"], r["rule"]): r["broken"] for r in report.collect() if r["broken"]}


def test_empty_tables_and_unknown_severities(spark):
    found, report = pre.run(spark.createDataFrame([], "k long, v long"), "k", rules())
    assert found.count() == 0 and {(r["broken"], r["rows"], r["passed"]) for r in report.collect()} == {(0, 0, True)}
    with pytest.raises(ValueError):
        pre.findings(spark.range(1).toDF("v"), "v", {"a": {"x": ("fatal", F.lit(True))}})
