"""Known answers and boundary pairs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numbers as nu, text as tx, times as tm
from tallyforge.operators import bands, cohort, findings, opportunity as op, sequences, state, text_quality, trend


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_answer_of_rates(spark):
    states = {"p": ["detected", "undetected", "not_evaluable"], "q": ["not_applicable", "undetected", "detected"]}
    rows = [(i, "c", d, "pattern", True, o) for d, os in states.items() for i, o in enumerate(os)]
    found = {r.detector: r for r in op.opportunity_rates(spark.createDataFrame(rows, "entity int, cohort string, detector string, polarity string, absence_capable boolean, outcome string")).collect()}
    assert (found["p"].d, found["p"].e, found["p"].u, found["p"].na, found["p"].n, found["p"].rate) == (1, 2, 1, 0, 3, 0.5)
    assert found["p"].coverage == pytest.approx(2 / 3)
    assert (found["q"].d, found["q"].e, found["q"].u, found["q"].na) == (1, 2, 0, 1)


def bounds(spark, polarity, d, e, u, na=0, absence=True):
    row = spark.createDataFrame([("c", "x", polarity, absence, d, e, u, na, e + u + na)], "cohort string, detector string, polarity string, absence_capable boolean, d int, e int, u int, na int, n int")
    return op.evidence_bounds(row)


@pytest.mark.parametrize("d,e,u,tier", [(7, 10, 0, "signature"), (6, 10, 0, "regular"), (4, 10, 0, "regular"), (7, 8, 2, "signature"), (4, 8, 3, "unclassified"), (3, 20, 0, "occasional"), (2, 20, 0, "rare"), (0, 8, 0, "never_tried"), (0, 7, 0, "unclassified"), (0, 8, 1, "not_yet_observed"), (0, 0, 0, "unclassified")])
def test_positive_tiers(spark, d, e, u, tier):
    assert op.positive_tiers(bounds(spark, "pattern", d, e, u)).first().tier == tier


@pytest.mark.parametrize("d,e,u,tier", [(5, 10, 0, "high_frequency"), (3, 12, 0, "moderate_frequency"), (2, 12, 0, "occasional"), (0, 8, 0, "confirmed_none"), (0, 8, 1, "unclassified"), (3, 6, 0, "unclassified")])
def test_recurrence_tiers(spark, d, e, u, tier):
    assert op.recurrence_tiers(bounds(spark, "antipattern", d, e, u)).first().tier == tier


@pytest.mark.parametrize("members,want", [(["detected"] * 2, "detected"), (["detected", "undetected"], "undetected"), (["not_evaluable", "not_applicable"], "not_applicable"), (["detected", "not_evaluable"], "not_evaluable")])
def test_joint_outcome(spark, members, want):
    assert one(spark, op.joint_outcome(F.array(*map(F.lit, members)))).asDict().popitem()[1] == want


@pytest.mark.parametrize("p,r,want", [((0.2, 0.2), (0.4, 0.4), "increasing"), ((0.4, 0.4), (0.2, 0.2), "decreasing"), ((0.2, 0.2), (0.39, 0.39), "stable"), ((0.0, 1.0), (0.0, 1.0), "indeterminate"), ((None, None), (0.1, 0.1), "unavailable")])
def test_movement(spark, p, r, want):
    bound = [F.lit(x).cast("double") for x in (*p, *r)]
    assert one(spark, trend.movement(*bound, F.lit(True)).alias("m")).m == want


def test_baseline_status(spark):
    rows = spark.createDataFrame([("a", "1.005", "i", True), ("a", "1.00", "i", True), ("b", "1", "i", True), ("b", "1", "j", True), ("c", "1", "i", False)], "g string, score string, identity string, ok boolean")
    found = {r.g: r for r in cohort.baseline(rows, "g", "score", "identity", "ok").collect()}
    assert (found["a"].status, found["a"].scored_count) == ("available", 2)
    assert (found["b"].status, found["b"].scored_count, found["b"].score_average, found["b"].eligible_count) == ("mixed_opportunity_coverage", 0, None, 2)
    assert found["c"].status == "unavailable"


def test_bands(spark):
    rows = spark.createDataFrame([(5,), (20,), (32,), (45,), (100,), (None,)], "m int")
    held = [(20, "a"), (45, "b"), (90, "c")]
    assert [r.b and r.b.value for r in bands.as_of(rows, F.col("m"), held, "b").collect()] == ["a", "a", "a", "b", "c", None]
    tie = [(20, "a"), (44, "b"), (90, "c")]
    assert [r.b and r.b.value for r in bands.nearest(rows, F.col("m"), tie, "b").collect()] == ["a", "a", "a", "b", "c", None]
    with pytest.raises(ValueError):
        bands.as_of(rows, F.col("m"), [])


def test_fold_is_not_lag(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 5, 10, 12, 19, 20, 30])], "k int, i int, v double")
    assert [r.v for r in sequences.keep_apart(rows, "k", "i", "v", 8).orderBy("i").collect()] == [0, 10, 19, 30]


def test_islands_and_containment(spark):
    ranges = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 2, 2), (1, 9, 9), (2, 1, 1)], "k int, s int, e int")
    assert sorted(tuple(r)[:3] for r in sequences.islands(ranges, "k", "s", "e").collect()) == [(1, 1, 6), (1, 9, 9), (2, 1, 1)]
    asked = spark.createDataFrame([(1, 2, 5), (1, 6, 9), (3, 1, 1)], "k int, s int, e int")
    assert sorted(tuple(r) for r in sequences.contained(asked, ranges, "k", "s", "e").collect()) == [(1, 2, 5, True), (1, 6, 9, False), (3, 1, 1, False)]


def test_segments(spark):
    rows = spark.createDataFrame([("a", 1.0, None, 2.0), ("b", 1.0, 1.0004, None), ("c", -1.0, 2.0, None), ("d", float("nan"), 2.0, None), ("e", 0.12345, 3.0, None)], "text string, start double, end double, duration double")
    assert sorted(tuple(r) for r in sequences.segments(rows).collect()) == [("a", 1.0, 3.0), ("e", 0.123, 3.0)]


@pytest.mark.parametrize("a,b,want", [("Robots at Work", "robots at work live", True), ("Clean Code", "clean architecture", False), ("DevOps Patterns", "devopspatterns", True), ("Reactive Machines: an intro", "Reactive Machines", True), ("of the", "x", False), ("Testing in Production", "Testing", False), ("Testing", "Testing in Production", True)])
def test_titles(spark, a, b, want):
    assert one(spark, tx.titles_agree(F.lit(a), F.lit(b)).alias("x")).x is want


def test_names_and_sequences(spark):
    row = one(spark, tx.names_agree(F.lit("Ada B Lovelace"), F.lit("ada lovelace")).alias("a"), tx.names_agree(F.lit("Ada Lovelace"), F.lit("Ada")).alias("b"), tx.contains_sequence(F.array(*map(F.lit, "abc")), F.array(F.lit("b"), F.lit("c"))).alias("c"), tx.contains_in_order(F.array(*map(F.lit, "abc")), F.array(F.lit("a"), F.lit("c"))).alias("d"), tx.contains_sequence(F.array(F.lit("a")), F.array(*map(F.lit, "ab"))).alias("e"))
    assert tuple(row) == (True, False, True, True, False)


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"), ("https://youtu.be/abcdefghijk?x", "abcdefghijk"), ("https://youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://www.youtube.com/watch?v=short", None), ("https://a.org/x/", None)])
def test_video_ids(spark, url, want):
    assert one(spark, tx.video_id(F.lit(url)).alias("x")).x == want


def test_addresses(spark):
    row = one(spark, tx.url_identity(F.lit("HTTPS://www.A.org/Path/")).alias("a"), tx.same_source(F.lit("https://youtu.be/abcdefghijk"), F.lit("https://www.youtube.com/embed/abcdefghijk")).alias("b"), tx.same_source(F.lit("x"), F.lit(None).cast("string")).alias("c"), tx.urls(F.lit("see https://a.org/x). and http://b.de!")).alias("d"), tx.repositories(F.lit("https://github.com/o/n.git, github.com/p/q.")).alias("e"), tx.rfcs(F.lit("RFC 2119 and rfc-793")).alias("f"), tx.drive_id(F.lit("https://docs.google.com/presentation/d/abc_1/edit")).alias("g"))
    assert tuple(row) == ("a.org/Path", True, False, ["https://a.org/x", "http://b.de"], ["o/n", "p/q"], ["2119", "793"], "abc_1")


def test_unicode_forms(spark):
    row = one(spark, tx.alias(F.lit("Crème Brûlée!")).alias("a"), tx.for_match(F.lit("ﬁne  “Straße”")).alias("b"), tx.word_count(F.lit("один два été ½ x1")).alias("c"))
    assert (row.a, row.b, row.c) == ("creme-brulee", 'fine "strasse"', 5)


def test_times(spark):
    row = one(spark, tm.utc_seconds(F.lit("2026-07-31T13:30:45.987654-05:00")).alias("a"), tm.utc_seconds(F.lit("2026-07-31T13:30:45")).alias("b"), tm.minutes(F.lit("1 hour")).alias("c"), tm.minutes(F.lit("0 min")).alias("d"), tm.clock_seconds(F.lit("01:02:03.5")).alias("e"), tm.m_ss(F.lit(605)).alias("f"), tm.strict_date(F.lit("2024-02-30")).alias("g"))
    assert row.a == dt.datetime(2026, 7, 31, 18, 30, 45) and row.b is None and (row.c, row.d, row.e, row.f, row.g) == (60, None, 3723.5, "10:05", None)


def test_numbers(spark):
    row = one(spark, nu.half_even(F.lit("2.675").cast("decimal(10,3)")).alias("a"), nu.half_even(F.lit("2.665").cast("decimal(10,3)")).alias("b"), nu.ratio(F.lit(1), F.lit(0)).alias("c"), nu.finite(F.lit(float("nan"))).alias("d"), nu.hamming(F.array(F.lit(3)), F.array(F.lit(5))).alias("e"))
    assert (str(row.a), str(row.b), row.c, row.d, row.e) == ("2.68", "2.66", None, False, 2)


@pytest.mark.parametrize("text,words,seconds,want", [("", 1, None, "empty"), ("a b", 1, -1.0, "invalid_parameters"), ("Traceback (most recent call last): x", 1, None, "crash_output"), ("a <00:01.000>b", 1, None, "raw_captions"), ("[Music] [Music] a", 1, None, "non_speech"), ("a b", 3, None, "too_few_words"), ("w " * 400, 1, 3000.0, "too_slow"), ("a b c", 3, None, "ok")])
def test_verdicts(spark, text, words, seconds, want):
    assert one(spark, text_quality.verdict(F.lit(text), F.lit(words), F.lit(seconds).cast("double")).alias("v")).v == want


QUEUE = "key int, status string, claimable boolean, run_id string, batch_id string, claimed_at timestamp, claim_state string"


def test_claims_replay_and_recover(spark):
    old = dt.datetime(2024, 1, 1)
    rows = [(3, "pending", True, None, None, None, None), (1, "pending", True, None, None, None, None), (2, "done", True, None, None, None, None), (4, "pending", False, None, None, None, None), (5, "in-progress", True, "r0", "b0", old, "claimed"), (6, "done", True, "r0", "b0", old, "claimed")]
    queue = spark.createDataFrame(rows, QUEUE)
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    first = state.claim(queue, "key", "r", "b", now, limit=1)
    assert [r.key for r in first.where("taken").collect()] == [1]
    again = state.claim(first.drop("taken"), "key", "r", "b", now, limit=1)
    assert [r.key for r in again.where("taken").collect()] == [1]
    found = {r.key: r.recovery for r in state.recover(queue, now, 3600).collect()}
    assert (found[5], found[6], found[1]) == ("expired", "drifted", "none")
    assert {r.key: r.recovery for r in state.recover(queue, now, 3601).collect()}[5] == "live"


def test_merge_and_patch(spark):
    row = one(spark, state.merge_maps(F.create_map(*map(F.lit, ("a", "1", "b", "2"))), F.create_map(*map(F.lit, ("a", "", "b", "0", "c", "x")))).alias("m"))
    assert row.m == {"a": "1", "b": "0", "c": "x"}
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, f string")
    p = spark.createDataFrame([(1, "a", "z"), (2, None, "y"), (3, "x", "w")], "k int, expect string, set string")
    assert sorted((r.k, r.f, r.applied) for r in state.patch(t, p, "k", "f").collect()) == [(1, "z", True), (2, "y", True), (3, "c", False)]


def test_edges_and_rules(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("b", "x")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert sorted(tuple(r) for r in findings.edge_findings(edges, nodes).collect()) == [("a", "a", "self_reference"), ("a", "c", "non_reciprocal"), ("b", "x", "dangling"), ("b", "x", "non_reciprocal")]
