"""Repairs hold little in a task: one shuffle and one sort for all findings, no maps of keys, and odd keys and fields."""

from __future__ import annotations

import re

from tallyforge.operators import repairs as rp


def _plan(df):
    return re.findall(r"(\w+) ?[\[(]", df._jdf.queryExecution().executedPlan().toString())


def _asked(spark, *x):
    return spark.createDataFrame(x, "k long, field string, value string")


def test_findings_sort_once_and_hold_no_maps(spark):
    rows = spark.range(1000).selectExpr("id as k", "cast(id % 3 as string) as s", "id % 5 as n").repartition(3)
    asked = rows.selectExpr("k", "'s' as field", "s as value")
    steps = _plan(rp.findings(rows.where("k % 2 = 0"), "k", asked, asked, ["s", "n"]))
    assert steps.count("hashpartitioning") == steps.count("Sort") == 1 and steps.count("Window") == 1 and "HashAggregate" not in steps and "ObjectHashAggregate" not in steps
    after, _ = rp.settled(rows, "k", asked, asked.where("k % 4 = 0"), ["s", "n"])
    assert "HashAggregate" not in _plan(after) and "ObjectHashAggregate" not in _plan(after) and _plan(after).count("SortMergeJoin") <= 1


def test_a_refused_plan_joins_nothing(spark):
    rows = spark.range(40).selectExpr("id as k", "'a' as s")
    after, against = rp.settled(rows, "k", _asked(spark, (1, "s", "a"), (99, "s", "a")), _asked(spark, (1, "s", "b")), ["s"])
    assert [tuple(r) for r in against.collect()] == [(99, "s", "unknown_key")]
    assert after.where("s <> 'a' or size(_changes) > 0").count() == 0 and not [x for x in _plan(after) if "Join" in x]


def test_odd_keys_and_fields(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "a"), (None, "b"), (3, "c"), (3, "c")], "k int, s string").repartition(2)
    guards = _asked(spark, (1, "s", "a"), (2, "s", None), (None, "s", "a"), (3, None, "c"), (2, "q", "x"))
    sets = _asked(spark, (2, "s", "z"), (2, "s", "z"), (None, "s", "x"), (3, None, None), (3, None, "x"), (2, "q", "x"))
    want = {
        (1, "s", "precondition_failed"), (1, None, "duplicate_key"), (None, "s", "unknown_key"), (None, "s", "unguarded_set"), (3, None, "unguarded_set"),
        (3, None, "conflicting_sets"), (3, None, "duplicate_key"), (2, "q", "unknown_field"),
    }
    found = [tuple(r) for r in rp.findings(rows, "k", guards, sets, ["s"]).collect()]
    assert len(found) == len(want) and set(found) == want


def test_changes_of_several_fields_stay_with_their_row(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "a", 1)], "k long, s string, n int").repartition(2)
    guards = _asked(spark, (1, "s", "a"), (1, "n", "5"), (2, "s", "b"))
    after, _ = rp.settled(rows, "k", guards, _asked(spark, (1, "s", None), (1, "n", "7"), (2, "s", "b")), ["s", "n"])
    got = {r["k"]: (r["s"], r["n"], [tuple(c) for c in r["_changes"]]) for r in after.collect()}
    assert got == {1: (None, 7, [("s", "a", None), ("n", "5", "7")]), 2: ("b", 6, []), None: ("a", 1, [])}
