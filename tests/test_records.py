"""Known answers for identities, contracts, profiles, outlines and quotes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import contracts as ct, dimensions as dm, identity as idn, matching, profile as pf, rhetoric as rh, sequences
from tallyforge.sources import decks, outlines as ot, sinks

TALK = "filename string, title string, conference string, date string"
DECK = "deck string, document_title string, created_year string, rendered_title string, footers array<string>, hashtags array<string>, pdf_talk string"
VOXXED = ("2025-01-17-voxxed-ticino-devops-developers.md", "DevOps for Developers", "Voxxed Days Ticino", "2025-01-17")
DEVOXX = ("2024-11-05-devoxx-belgium-devops-developers.md", "DevOps for Developers", "Devoxx Belgium", "2024-11-05")

#: Its venue contradicts the talk whose title agrees.
OTHER = ("2020-x.md", "Other Things", "Devoxx Belgium", "2020-01-01")


@pytest.mark.parametrize(
    "deck,talks,verdict,talk,reason",
    [
        (("Conferences/Voxxed Days Ticino/2025/DevOps for Developers.pptx",), [VOXXED, DEVOXX], "matched", VOXXED[0], "identity_matched"),
        (("Conferences/Devoxx Belgium/2024/DevOps for Developers.pptx",), [VOXXED, DEVOXX], "matched", DEVOXX[0], "identity_matched"),
        (("Conferences/Voxxed Days Ticino/2025/x.pptx",), [], "unmatched", None, "identity_no_candidate_talks"),
        (("Conferences/KubeCon Europe/2025/Something Else.pptx",), [VOXXED], "unmatched", None, "identity_no_agreeing_signal"),
        (("Decks/devops-developers.pptx",), [VOXXED], "review_required", None, "identity_filename_similarity_only"),
        (("Decks/a.pptx", "DevOps for Developers"), [VOXXED, DEVOXX], "review_required", None, "identity_ambiguous_candidates"),
        (("Decks/Devoxx Belgium/a.pptx", "DevOps for Developers"), [VOXXED, OTHER], "matched", OTHER[0], "identity_matched"),
        (("Decks/2019/a.pptx", "DevOps for Developers"), [VOXXED], "review_required", None, "identity_conflicting_signals"),
        (("Voxxed Days Ticino/master/a.pptx",), [VOXXED], "review_required", None, "identity_matched"),
        (("a.pptx", None, None, None, None, ["#VoxxedTicino"]), [VOXXED, DEVOXX], "matched", VOXXED[0], "identity_matched"),
    ],
)
def test_identity_verdicts(spark, deck, talks, verdict, talk, reason):
    found = idn.assess(spark.createDataFrame([(*deck, *[None] * (7 - len(deck)))], DECK), spark.createDataFrame(talks, TALK)).collect()
    assert [(r.verdict, r.talk, r.reasons[0]) for r in found] == [(verdict, talk, reason)]


def test_event_names(spark):
    rows = [("Devoxx Belgium 2024",), ("The Open Conference",), ("DevoxxUK",), ("AI",), ("DevOpsDays France",), (None,), ("Go",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(idn.event_alias(F.col("n"))).collect()]
    assert got == [["devoxx", "be"], None, ["devoxx", "uk"], None, ["devops", "fr"], None, None]
    titles = [(1, "DevOps at Devoxx Belgium 2024", "Devoxx"), (2, "Java at Java", "Java Days"), (3, "JFokus 2023 - Talk", "Jfokus"), (4, "No event", "Jfokus"), (5, "Talk at Voxxed Days Ticino", "Devoxx UK")]
    aliases = spark.createDataFrame([(["devoxx", "be"],), (["devoxx"],), (["jfokus"],), (["java"],), (["voxxed", "ticino"],)], "alias array<string>")
    got = {r.id: (r.mentions, r.agrees) for r in idn.event_agreement(spark.createDataFrame(titles, "id long, title string, conference string"), "id", "conference", "title", aliases).collect()}
    assert got == {1: ([["devoxx", "be"]], True), 2: ([], None), 3: ([["jfokus"]], True), 4: ([], None), 5: ([["voxxed", "ticino"]], False)}


def test_quotes_must_stand_once_at_word_borders(spark):
    texts = [(1, "The river is “long”.\n\nIt was – they say – a  Paper\nMOON over fields."), (2, "aba aba aba"), (3, "moonlight only"), (None, "the river"), (5, "x_paper moon"), (6, None)]
    quotes = [("a", "a paper moon over"), ("b", 'is "LONG". it'), ("c", "aba aba"), ("d", "moon"), ("e", ""), (None, "river"), ("g", "ﬁelds")]
    segments = [(1, "a paper moon", 1.0, 2.0), (1, "over fields", 2.0, 3.5), (1, "the river", 0.0, 1.0)]
    found = matching.quotes(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(quotes, "q string, s string"), "id", "t", "q", "s", spark.createDataFrame(segments, "id long, text string, start_seconds double, end_seconds double"))
    got = {(r.id, r.q): (r.status, r.line_start, r.line_end, r.start_seconds, r.end_seconds) for r in found.collect()}
    assert got == {(5, "d"): ("resolved", 1, 1, None, None), (1, "a"): ("resolved", 3, 4, 1.0, 3.5), (1, "b"): ("resolved", 1, 3, None, None), (2, "c"): ("ambiguous", None, None, None, None), (1, "d"): ("resolved", 4, 4, 1.0, 2.0), (1, "g"): ("resolved", 4, 4, 2.0, 3.5)}
    empty = matching.quotes(spark.createDataFrame([], "id long, t string"), spark.createDataFrame([], "q string, s string"), "id", "t", "q", "s")
    assert empty.count() == 0


def test_keep_apart_carries_the_last_kept_value(spark):
    rows = [("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 9.0), ("a", 4, 10.0), ("b", 1, 3.0), ("b", 2, None), (None, 1, 1.0)]
    found = sequences.keep_apart(spark.createDataFrame(rows, "k string, o int, v double").repartition(3), "k", ["o"], "v", 8.0)
    assert sorted((r.k or "", r.o) for r in found.collect()) == [("", 1), ("a", 1), ("a", 3), ("b", 1)]


OUTLINE = {
    "talk": {"title": "T", "speakers": ["Ann"], "architecture": "sparkline", "applied_patterns": [{"id": "call-to-action"}]},
    "chapters": [{"id": "c1", "title": "One", "argument_beats": [{"text": "x", "slide_refs": [1, 9]}]}],
    "slides": [
        {"n": 1, "chapter": "c1", "visual": "a chart", "text_overlay": "", "script": [{"line": "hi"}, {"cue": "lights"}, {"parenthetical": "pause"}], "big_idea": True, "builds": [{"step": 0}, {"step": 1}], "applied_patterns": [{"id": "call-to-action"}, {"id": "star-moment"}]},
        {"n": 2, "chapter": "zz", "script": [{"line": "yo", "speaker": "Bo"}], "builds": [{"step": 1}]},
    ],
    "interludes": [{"id": "i", "chapter": "c1", "after_slide": 7, "script": [], "applied_patterns": [{"id": "inoculation", "resistance_vector": "time"}]}],
}


def test_outline_trees(spark):
    yaml = pytest.importorskip("yaml")
    texts = spark.createDataFrame([("json", json.dumps(OUTLINE)), ("yaml", yaml.safe_dump(OUTLINE)), ("bad", "- 1\n- 2"), ("none", None)], "k string, value string")
    trees = ot.parse(texts)
    assert {r.k: r.error for r in trees.collect()} == {"json": None, "yaml": None, "bad": "outline_unreadable", "none": "outline_unreadable"}
    errors = {r.k: r.errors for r in rh.tree_errors(trees, "k").collect()}
    assert errors["json"] == errors["yaml"] == ["unknown_chapter", "unknown_slide_ref", "unknown_anchor", "build_steps", "speaker_on_single", "unknown_speaker"]
    assert errors["none"] == ["chapters_missing", "slides_missing"]
    lines = [(r.slide, r.section, r.line) for r in ot.resource_lines(trees.where("k = 'json'"), "k").collect()]
    assert lines == [(1, "One", "- Visual: a chart"), (1, "One", "- Speaker: hi"), (1, "One", "  (pause)"), (2, "zz", "- Speaker: Bo: yo")]
    applied = ot.patterns(trees.where("k = 'yaml'"), "k")
    assert {(r.element, r.n, r.status) for r in rh.sparkline(trees.where("k = 'yaml'"), "k", applied).collect()} == {("call-to-adventure", 0, "FLAG"), ("call-to-action", 2, "FLAG"), ("new-bliss", 0, "FLAG"), ("star-moment", 1, "PASS")}
    assert [(r.n, r.status, r["where"]) for r in rh.inoculations(trees.where("k = 'yaml'"), "k", applied).collect()] == [(1, "PASS", ["interlude i (time)"])]


def test_deck_boundaries(spark):
    slidev = "---\nmdc: true\n---\none\n---\nlayout: x\n---\ntwo\n```\n---\n```\n---\nthree"
    plain = "one\n---\ntwo"
    rows = spark.createDataFrame([(1, slidev, "slidev"), (2, plain, "marp"), (3, "---\ntitle: t\n---\na\n<!-- end_slide -->\nb", "presenterm"), (4, "", "slidev")], "id int, text string, flavor string")
    assert {r.id: r.starts for r in decks.boundaries(rows).collect()} == {1: [3, 7, 12], 2: [0, 2], 3: [0, 3, 5], 4: [0]}
    found = {r.id: (r.flavor and r.flavor.decided_by, r.flavor_error) for r in decks.flavor(rows.drop("flavor")).collect()}
    assert found == {1: ("headmatter_key", None), 2: (None, "flavor_unmarked"), 3: ("body_marker", None), 4: (None, "flavor_unmarked")}


def test_dimension_registry(spark):
    assert dm.registry(spark).count() == len({label for labels in dm.REGISTRY.values() for label in labels})
    with pytest.raises(ValueError, match="two dimensions"):
        dm.registry(spark, {1: ("Same",), 2: ("same",)})


def test_policy(spark):
    good = {
        "schema_version": 1, "policy_id": "p-1", "policy_version": 1,
        "positive_patterns": {t: {f: True if f == "require_complete_evaluation" else 0 if f == "maximum_detections" else 8 if f in ("minimum_applicable", "minimum_evaluable", "minimum_detections") else 0.5 for f in fields} for t, fields in pf.POSITIVE.items()},
        "antipattern_recurrence": {t: {f: True if f == "require_complete_evaluation" else 0 if f == "maximum_detections" else 8 if f in ("minimum_applicable", "minimum_evaluable", "minimum_detections") else 0.5 for f in fields} for t, fields in pf.RECURRENCE.items()},
        "signature_combinations": {**pf.COMBINATIONS, "minimum_applicable": 8, "minimum_detections": 4, "minimum_lower": 0.4},
    }
    assert pf.policy_errors(good) == [] and pf.resolved_policy(None, good) == good
    bad = json.loads(json.dumps(good))
    bad["positive_patterns"]["regular"]["minimum_lower"] = 0
    bad["antipattern_recurrence"]["confirmed_none"]["maximum_detections"] = 1
    assert pf.policy_errors(bad) == ["positive_patterns.regular.minimum_lower must be over zero", "antipattern_recurrence.confirmed_none.maximum_detections must be 0"]
    with pytest.raises(ValueError):
        pf.resolved_policy(bad, good)


def test_swaps_and_archives(spark):
    rows = spark.createDataFrame([('{"evidence":[1,2],"dimensions":"said so"}',), ('{"evidence":"x","dimensions":[1]}',), ('{"evidence":[99],"dimensions":"x"}',), ('{"evidence":[1],"dimensions":" "}',), ("{}",)], "j string")
    got = [r.s for r in rows.select(ct.variant_swap(F.parse_json("j")).alias("s")).collect()]
    assert got[0].evidence == "said so" and got[0].dimensions == [1, 2] and got[1:] == [None] * 4


def test_commits_name_what_can_be_read(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert table.commit(0, spark.range(3)) == 1 and table.read().count() == 3
    with pytest.raises(sinks.Conflict):
        table.commit(0, spark.range(4))
    table._exclusively(f"{table.path}/_claims/2", "taken")  # a writer that died after its claim
    with pytest.raises(sinks.Conflict):
        table.commit(1, spark.range(5))
    assert table.version() == 1 and table.read().count() == 3
    table.recover()
    assert table.commit(1, spark.range(6)) == 2 and table.read().count() == 6


def test_vault_parts(spark, tmp_path):
    from tallyforge.sources import vault

    (tmp_path / vault.DATABASE).write_text('{"config":{"speaker_name":"Ann"},"talks":[{"filename":"a"},{"filename":"b"}]}')
    (tmp_path / vault.SUMMARY).write_text("Summary")
    parts = vault.load(spark, str(tmp_path))
    assert [r[0] for r in parts["talks"].select(F.try_variant_get("talk", "$.filename", "string")).collect()] == ["a", "b"]
    assert parts["summary"].collect()[0].text == "Summary" and parts["specification"].count() == 0 and parts["defects"].count() == 0
    assert parts["config"].select(F.try_variant_get("config", "$.speaker_name", "string")).collect()[0][0] == "Ann"


@pytest.mark.parametrize("near", [False, True])
def test_long_band_lists_give_what_short_ones_give(spark, monkeypatch, near):
    from tallyforge.operators import bands

    table = [(k, f"v{i}") for i, k in enumerate([5, 1, 9, 5, 3, 20, 1, 14])]
    rows = spark.createDataFrame([(x / 2,) for x in range(-4, 50)] + [(None,)], "x double")
    find = bands.nearest if near else bands.as_of
    want = find(rows, F.col("x"), table).collect()
    monkeypatch.setattr(bands, "MOST_BANDS", 3)
    assert find(rows, F.col("x"), table).collect() == want
