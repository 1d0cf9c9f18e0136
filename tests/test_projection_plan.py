"""Reasons of projections: lanes and outcomes are read once, and missing parts are told."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import contracts as ct
from tallyforge.plans import records

KIND = "struct<pattern_outcomes:array<struct<pattern_id:string,outcome:string>>,patterns_detected:array<string>,antipatterns_detected:array<string>,not_evaluable:array<string>,applicability_assessments:array<struct<pattern_id:string,result:string>>>"


def test_lanes_are_bound_once(spark, sf_dir):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    plan = records.projections(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("undetected") < 60  # 293 when each check repeated the outcomes


def test_reasons(spark):
    good = ([("a", "detected"), ("b", "not_evaluable"), ("c", "not_applicable")], ["a"], [], ["b"], [("c", "not_applicable")])
    rows = [good, (None, ["a"], [], ["b"], None), (good[0], ["a", "a"], None, ["b"], [("c", "maybe")]), (good[0], ["b"], ["b"], ["b"], good[4]), (good[0], ["z"], [], ["b"], good[4])]
    made = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, o {KIND}")
    found = [r.e for r in made.select("i", ct.projection_reasons(F.col("o")).alias("e")).orderBy("i").collect()]
    assert found == [
        [], ["pattern_outcomes_projection_invalid"],
        ["patterns_detected_ids_invalid", "antipatterns_detected_ids_invalid", "applicability_assessment_results_invalid", "pattern_outcomes_not_applicable_projection_drift"],
        ["pattern_detection_polarity_overlap", "pattern_observation_lane_overlap", "pattern_outcomes_detected_projection_drift"],
        ["pattern_outcomes_unknown_lane_ids", "pattern_outcomes_detected_projection_drift"],
    ]
