"""Rules over prose and decks; stored rows against proposals."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import guardrails as gr, reconcile as rc


def test_prose_rules(spark):
    row = spark.range(1).select(
        gr.unsourced_claim(F.lit("grew 40% last year")).alias("a"), gr.unsourced_claim(F.lit("grew 40% (source: X)")).alias("b"), gr.words_found(F.lit("Damn, a dam."), ["dam", "damn", "hell"]).alias("c"),
        gr.branding(F.lit("@me | conf"), ["@ME", "site.org"]).alias("d"), gr.closing_missing(F.lit("Recap. Next step: thank you, see a.dev/")).alias("e"), gr.sentences(F.lit("One. Two! Three?")).alias("f"), gr.prose_status(F.lit(0), F.lit(2)).alias("g"),
        gr.comparison_valid(F.lit("One."), F.lit(9), F.lit(1.0), F.lit(2.0)).alias("h"), gr.stale(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 3, 31))).alias("i"), gr.stale(F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 4, 1))).alias("j"),
        gr.recommended(F.lit("Nano-Banana-2")).alias("k"), gr.recommended(F.lit("other")).alias("l"),
    ).first()
    assert tuple(row) == (True, False, ["dam", "damn"], ["site.org"], [], 3, "WARN", ["too_few_compared", "score_differs", "sentence_count"], False, True, "gemini", None)


def test_names(spark):
    names = spark.createDataFrame([("~$a.pptx",), ("Static (1).pptx",), ("talk (2).pptx",), ("my backup.pptx",), ("masterclass.pptx",)], "n string")
    assert [r[0] for r in names.select(gr.skip_reason(F.col("n"), ["BACKUP"])).collect()] == ["lock", "static", "conflict_copy", "pattern", None]
    assert [r[0] for r in names.select(gr.artifact_role(F.col("n"))).collect()] == ["delivery", "static_export", "delivery", "backup", "delivery"]


def test_operations(spark):
    ops = ["TEXT", "SLIDE", "CELL", "TABLE", "CELL", "CHART", "SLIDE", "SERIES", "CHART", "SERIES", "CHART", "NOPE"]
    rows = spark.createDataFrame([("d", i, o) for i, o in enumerate(ops)], "deck string, line int, op string")
    found = sorted((r.line, r.error) for r in gr.operation_errors(rows).collect())
    assert found == [(0, "outside_slide"), (2, "cell_without_table"), (5, "chart_without_series"), (7, "series_without_chart"), (10, "chart_without_series"), (11, "unknown_operation")]


def test_differences_and_proposals(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", "n"), (2, "z", "q"), (3, "w", None)], "k int, f string, g string")
    assert sorted(map(tuple, rc.field_differences(a, b, "k", ["f", "g"]).collect())) == [(1, "g", None, "n"), (2, "f", "y", "z")]
    assert sorted(map(tuple, rc.proposals(a, b, "k", ["f", "g"]).collect())) == [(1, "existing", "unchanged", "add"), (2, "existing", "review", "unchanged"), (3, "new", "add", "absent")]
    ledger = spark.createDataFrame([(1, "u", 2, "late"), (1, "u", 1, "first")], "k int, url string, place int, reason string")
    rows = spark.createDataFrame([(1, "u"), (1, "v"), (2, "u")], "k int, url string")
    assert [(r.k, r.reason) for r in rc.rejected_again(rows, ledger, "k", F.col("url"), F.col("url")).collect()] == [(1, "first")]


def test_relations_and_spans(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 9, "a"), (3, 1, "b"), (4, 1, "a"), (5, None, "a")], "k int, to int, v string")
    assert sorted((r.k, r.code) for r in rc.relation_findings(rows, "k", "to", "v").collect()) == [(1, "self"), (2, "unknown_target"), (3, "other_identity")]
    spans = spark.createDataFrame([(1, float(s), float(s + 7)) for s in range(0, 100, 5)], "k int, start double, end double")
    asked = spark.createDataFrame([(1, i, float(i), float(i + 33)) for i in range(0, 90, 11)], "k int, id int, low double, high double")
    got = sorted((r.id, r.start) for r in rc.overlapping(spans, asked, "k", 10).collect())
    assert got == sorted((i, float(s)) for i in range(0, 90, 11) for s in range(0, 100, 5) if s + 7 > i and s < i + 33)


def test_plans_apply_whole_or_tell(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, f string")
    good = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", "c"), (2, 3, None, "x")], "k int, step int, expect string, set string")
    candidate, errors = rc.mutation_plan(t, good, "k", "f")
    assert errors.count() == 0 and sorted(map(tuple, candidate.collect())) == [(1, "c"), (2, "x")]
    bad = spark.createDataFrame([(1, 1, "z", "b"), (9, 2, None, "c")], "k int, step int, expect string, set string")
    assert sorted(map(tuple, rc.mutation_plan(t, bad, "k", "f")[1].collect())) == [(1, [1]), (9, [2])]


def test_queue_states(spark):
    rows = spark.createDataFrame([(1, "processed", 0, None), (2, "processed", 0, None), (3, "Done", 0, None)], "k int, status string, generation int, reason string")
    current = spark.createDataFrame([(1,)], "k int")
    found = {r.k: (r.status, r.generation, r.reason) for r in rc.requeue(rc.legacy_statuses(rows, {"Done": "processed"}), current, "k").collect()}
    assert found == {1: ("processed", 0, None), 2: ("needs-reprocessing", 1, "stale_generation"), 3: ("needs-reprocessing", 1, "stale_generation")}
    queue = spark.createDataFrame([(1, "r", "claimed"), (2, "q", "claimed"), (3, "r", None)], "k int, run_id string, claim_state string")
    assert sorted((r.k, r.claim_state) for r in rc.close_claims(queue, queue, "k", "r").collect()) == [(1, "completed"), (2, "claimed"), (3, None)]
    claims = spark.createDataFrame([("r", "a", 1, "t", [1, 2]), ("r", "a", 2, "t", [1, 2]), ("r", "b", 1, "t", [1]), ("r", "b", 2, "u", [1, 2])], "run_id string, batch_id string, key int, claimed_at string, exclusions array<int>")
    assert [(r.batch_id, r.codes) for r in rc.claim_consistency(claims).collect()] == [("b", ["several_times", "several_snapshots"])]
    old = spark.createDataFrame([(1, 1)], "k int, schema_version int")
    assert tuple(rc.migrate(old, {"lang": F.lit("en")}, 2).first()) == (1, 2, "en")
    with pytest.raises(ValueError):
        rc.migrate(old, {}, 0)
