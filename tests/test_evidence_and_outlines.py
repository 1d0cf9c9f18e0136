"""Gates, audits, outlines and nested values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import nested
from tallyforge.operators import evidence as ev, outline as ol


def values(frame, *columns):
    return sorted(tuple(str(r[c]) if isinstance(r[c], list) else r[c] for c in columns) for r in frame.collect())


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize("groups,available,want", [([["a"]], ["a"], True), ([["a", "b"]], ["a", "b"], False), ([["a", "b"]], ["a", "b", "source_comparison"], True), ([["a", "b"], ["c"]], ["c"], True), (None, ["a"], False)])
def test_gates(spark, groups, available, want):
    frame = spark.createDataFrame([(groups, available)], "g array<array<string>>, a array<string>")
    assert frame.select(ev.gate_open(F.col("g"), F.col("a")).alias("x")).first().x is want


def test_derived_outcomes(spark):
    entities = spark.createDataFrame([(1, ["slides"], ["e"])], "entity int, available array<string>, not_applicable array<string>")
    catalog = spark.createDataFrame([("a", None, [["slides"]], "x"), ("b", [["video"]], [["slides"]], "x"), ("c", None, [["video"]], "x"), ("d", None, None, None), ("e", None, [["slides"]], "x"), ("f", None, None, "x"), ("g", [["video"]], None, None)], "entry string, applicability_gate array<array<string>>, absence_gate array<array<string>>, evaluable_from string")
    hits = spark.createDataFrame([(1, "g")], "entity int, entry string")
    assert values(ev.derive(entities, catalog, hits), "entry", "outcome", "reason") == [("a", "undetected", None), ("b", "not_evaluable", "applicability_incomplete"), ("c", "not_evaluable", "inspection_incomplete"), ("d", "not_evaluable", "pending"), ("e", "not_applicable", "assessed"), ("f", "not_evaluable", "positive_only"), ("g", "detected", None)]


def test_audit_and_histogram(spark):
    catalog = spark.createDataFrame([("a", "pattern", [1, 2])], "entry string, polarity string, dimensions array<int>")
    found = spark.createDataFrame([(1, "a", "pattern", "strong", [2, 1]), (2, "a", "antipattern", "huge", [3]), (3, "z", "pattern", "weak", None), (4, "a", "pattern", "weak", [1, 2])], "entity int, entry string, polarity string, confidence string, dimensions array<int>")
    audit = ev.detection_audit(found, catalog)
    assert {r.entity: r.codes for r in audit.collect()} == {1: ["dimension_order"], 2: ["wrong_lane", "bad_confidence", "dimension_membership"], 3: ["unknown_id"], 4: []}
    assert values(ev.code_histogram(audit), "code", "n")[0] == ("bad_confidence", 1)


def test_freshness_and_batches(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, sha string")
    observed = spark.createDataFrame([(1, "a"), (2, "x"), (4, "c")], "k int, sha string")
    assert values(ev.freshness(stored, observed, "k", ["sha"]), "k", "state") == [(1, "current"), (2, "stale"), (3, "unverified")]
    twice = observed.union(observed.where("k = 4")).union(observed.where("k = 1"))
    assert values(ev.batch_match(stored, twice, "k"), "k", "code") == [(1, "returned_twice"), (3, "not_returned"), (4, "not_claimed")]


def test_citations(spark):
    cited = spark.createDataFrame([(1, 2, 3), (1, 5, 9), (2, 1, 1)], "k int, start int, end int")
    seen = spark.createDataFrame([(1, 1, 4), (1, 5, 8)], "k int, low int, high int")
    assert values(ev.cited_outside(cited, seen, "k"), "k", "start") == [(1, 5), (2, 1)]


def test_dispositions(spark):
    rows = spark.createDataFrame([("matched", "a", "a"), ("matched", "a", "b"), ("ambiguous", None, "b"), ("unmatched", None, "b"), ("matched", "a", None)], "v string, s string, t string")
    assert [r[0] for r in rows.select(ev.disposition(F.col("v"), F.col("s"), F.col("t"))).collect()] == ["confirmed", "contradicted", "review", "unproven", "unbound"]
    signals = spark.range(1).select(ev.non_delivery(F.lit(True), F.lit(True), F.lit(None), F.lit(1000), F.lit(False)).alias("a"), ev.non_delivery(F.lit(True), F.lit(None).cast("boolean"), F.lit(600), F.lit(60), F.lit(False)).alias("b"), ev.score_resolution(F.lit(1.0), F.lit("1.00")).alias("c"), ev.capabilities(x=F.lit(True), y=F.lit(False), z=F.lit(True)).alias("d")).first()
    assert (signals.a, signals.b, signals.c, signals.d) == ([], ["clip_marker", "short_ratio", "under_two_minutes"], "agrees", ["x", "z"])
    goals = spark.createDataFrame([("f", 1, "i"), ("g", 1, "i"), (None, 1, "i")], "fingerprint string, version int, identity string")
    assert [r.comparability for r in ev.goal_comparability(goals, {"fingerprint": "f", "version": 1, "identity": "i"}).collect()] == ["comparable", "not_comparable", "legacy_unknown"]


SLIDES = "talk int, pos int, n int, chapter string, builds int, big boolean, text string, thread string, kind string"


def test_outline_checks(spark):
    slides = spark.createDataFrame([(1, 1, 1, "a", 3, False, "x", "s", "introduce"), (1, 2, 2, "b", 0, True, "y", "s", "recall"), (1, 3, 3, "c", None, False, "z", "t", "recall"), (2, 1, 2, "a", 1, False, "x", None, None), (2, 2, 1, "q", 1, False, "y", None, None)], SLIDES)
    chapters = spark.createDataFrame([(1, "a", 1, 10.0), (1, "b", 2, 30.0), (1, "c", 3, 10.0), (2, "a", 1, 5.0)], "talk int, chapter string, pos int, minutes double")
    assert values(ol.expanded_count(slides), "talk", "slides") == [(1, 5), (2, 2)]
    assert values(ol.exactly_one(slides, "big"), "talk", "ok") == [(1, True), (2, False)]
    assert values(ol.ordered(slides), "talk", "ok") == [(1, True), (2, False)]
    assert values(ol.threading(slides, "thread", "kind"), "thread", "ok") == [("s", True), ("t", False)]
    assert values(ol.act_one(chapters, slides, F.col("big")), "talk", "share", "verdict") == [(1, 0.2, "PASS"), (2, 0.0, "WARN")]
    assert values(ol.broken_references(slides, "chapter", chapters, "chapter"), "talk", "reference") == [(2, "q")]
    assert values(ol.coverage(slides, "chapter", ["a", "b", "z"]), "talk", "missing") == [(1, "['z']"), (2, "['b', 'z']")]
    assert values(ol.opening(slides, F.col("text") == "x"), "talk", "ok") == [(1, True), (2, False)]
    assert values(ol.thesis_order(slides, F.col("text") == "x", F.col("text") == "z"), "talk", "ok")[0] == (1, True)
    talks = spark.createDataFrame([(1, 45.0), (2, 45.0)], "talk int, minutes double")
    assert values(ol.duration_accounting(chapters, talks), "talk", "verdict") == [(1, "PASS"), (2, "WARN")]
    between = spark.createDataFrame([(1, 1, "i")], "talk int, after int, text string")
    assert [r[3] for r in sorted(map(tuple, ol.events(slides.where("talk = 1"), between).collect()))] == ["x", "i", "y", "z"]
    assert values(ol.selection("1,3-9", slides), "n") == [(1,), (3,)] and values(ol.selection("remaining", slides, slides.where("n = 1")), "n") == [(2,), (3,)]


def test_members_and_callbacks(spark):
    rows = spark.createDataFrame([(1, "g", 1), (1, "g", 2), (1, "h", 1), (1, "h", 3), (1, "i", 1)], "talk int, id string, i int")
    assert values(ol.contiguous_members(rows, ["talk", "id"], "i"), "id", "verdict") == [("g", "ok"), ("h", "gap"), ("i", "too_few")]
    rows = spark.createDataFrame([(1, "a", "plant", 1), (1, "a", "pay", 3), (1, "b", "plant", 2), (1, "c", "pay", 2), (1, "d", "plant", 4), (1, "d", "pay", 2)], "talk int, id string, kind string, n int")
    assert values(ol.callbacks(rows), "id", "verdict") == [("a", "ok"), ("b", "unpaid"), ("c", "unplanted"), ("d", "early")]


def test_nested(spark):
    frame = spark.createDataFrame([('{"a": {"b": 1, "c": ""}, "d": 0}', '{"a": {"b": 0, "c": "x"}, "d": null, "e": []}', [(3, 4), (1, 2), (7, 9)], "b+a|c|a+b")], "x string, y string, r array<struct<start:int,end:int>>, g string")
    row = frame.select(nested.deep_merge(F.col("x"), F.col("y")).alias("m"), nested.page_ranges(F.col("r"), F.lit(9)).alias("p"), nested.page_ranges(F.col("r"), F.lit(8)).alias("q"), nested.or_groups(F.col("g")).alias("g"), nested.dig(F.parse_json(F.col("x")), "a.b", "int").alias("d"), nested.dig(F.parse_json(F.col("x")), "d.b").alias("e"), nested.same_json(F.lit('{"a":1,"b":2}'), F.lit('{"b":2,"a":1}')).alias("s"), nested.same_json(F.lit("1"), F.lit("true")).alias("t"), nested.covered_pages(F.col("r"), F.array(F.lit(2), F.lit(5))).alias("c")).first()
    assert row.m == '{"a":{"b":0,"c":"x"},"d":0}' and [tuple(x) for x in row.p] == [(1, 4), (7, 9)] and row.q is None
    assert (row.g, row.d, row.e, row.s, row.t, row.c) == ([["a", "b"], ["c"]], 1, None, True, False, [2])
