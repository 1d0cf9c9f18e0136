"""The plan of return findings: a text is parsed once, and rules look at columns that were read once."""

from __future__ import annotations

from tallyforge.operators import returns as rt


def test_bodies_are_read_once(spark):
    rows = spark.createDataFrame([(1, "{}")], "k int, body string").repartition(2)
    catalog = spark.createDataFrame([("a", "pattern", True)], "id string, entry_type string, observable boolean")
    plan = rt.return_findings(rows, "k", "body", catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.lower().count("inline(") == 1
