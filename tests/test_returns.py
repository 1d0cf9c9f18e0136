"""Layers of return validation: a good return, and each fault on its own."""

from __future__ import annotations

import copy
import json

import pytest

from tallyforge.operators import returns as rt

GOOD = {
    "evidence_sources": ["transcript", "static_slides"],
    "patterns_detected": [{"pattern_id": "a", "confidence": "strong", "evidence_source": "transcript"}],
    "antipatterns_detected": [{"pattern_id": "z", "confidence": "weak", "evidence_source": "static_slides"}],
    "applicability_assessments": [{"pattern_id": "b", "result": "applicable", "evidence_source": "transcript", "evidence": "e", "evidence_citations": []}],
    "source_inspection": [{"source": "transcript", "line_ranges": [[1, 9]]}, {"source": "source_comparison", "evidence_sources_used": ["transcript", "static_slides"], "comparison_scope": "full"}],
    "pattern_score": 0,
    "slide_source": "video_extracted",
    "video_extraction": {"schema_version": 4, "pipeline_version": "v1", "source_video_id": "x-1", "source_video_path": "/v/x-1.mp4", "total_frames_extracted": 9, "unique_frame_count": 2, "authored_slide_count": None, "fps_used": 0.5, "retained_frames": [{"page_number": 1, "frame_index": 0, "timestamp_seconds": 0.0}, {"page_number": 2, "frame_index": 4, "timestamp_seconds": 8}]},
}


def put(path: str, value):
    """GOOD with one thing changed; a path ends in `-` to take it away, or `+` to add to a list."""
    out = copy.deepcopy(GOOD)
    *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    at = out
    for p in way:
        at = at[p]
    if value == "-":
        del at[last]
    elif last == "+":
        at.append(value)
    else:
        at[last] = value
    return out


CASES = [
    (GOOD, []),
    (put("pattern_score", {"patterns_used": 1, "antipatterns_detected": 1, "score": 0}), []),
    (put("slide_source", "deck") | {"video_extraction": 7}, []),
    ([1], [("$", "not_object")]),
    (put("patterns_detected", {}), [("patterns_detected", "not_array"), ("pattern_score", "differs")]),
    (put("antipatterns_detected", "-"), [("antipatterns_detected", "not_array"), ("pattern_score", "differs")]),
    (put("patterns_detected.0", "a"), [("patterns_detected[0]", "not_object")]),
    (put("patterns_detected.0.pattern_id", 5), [("patterns_detected[0].pattern_id", "no_id")]),
    (put("patterns_detected.0.confidence", "sure"), [("patterns_detected[0].confidence", "confidence")]),
    (put("patterns_detected.0.evidence_source", "rumour"), [("patterns_detected[0].evidence_source", "evidence_source")]),
    (put("patterns_detected.0.evidence_source", "native_deck"), [("patterns_detected[0].evidence_source", "source_not_available")]),
    (put("patterns_detected.+", GOOD["patterns_detected"][0]), [("patterns_detected[1].pattern_id", "duplicate_id"), ("pattern_score", "differs")]),
    (put("applicability_assessments.0.pattern_id", "a"), [("applicability_assessments[0].pattern_id", "also_detected")]),
    (put("applicability_assessments.0.result", "not_applicable"), [("applicability_assessments[0].condition_id", "condition_missing")]),
    (put("applicability_assessments.0.condition_id", "c"), [("applicability_assessments[0].condition_id", "condition_forbidden")]),
    (put("applicability_assessments.0.evidence", "-"), [("applicability_assessments[0]", "fields")]),
    (put("applicability_assessments.0.result", True), [("applicability_assessments[0].result", "result")]),
    (put("source_inspection", []), [("source_inspection", "empty")]),
    (put("source_inspection.+", {"source": "transcript", "line_ranges": [[1, 2]]}), [("source_inspection[2].source", "duplicate_source")]),
    (put("source_inspection.0.more", 1), [("source_inspection[0]", "fields")]),
    (put("source_inspection.0.line_ranges", []), [("source_inspection[0]", "no_ranges")]),
    (put("source_inspection.0.source", "rumour"), [("source_inspection[0].source", "source")]),
    (put("source_inspection.1.evidence_sources_used", ["transcript"]), [("source_inspection[1].evidence_sources_used", "comparison")]),
    (put("source_inspection.1.evidence_sources_used", ["transcript", "native_deck"]), [("source_inspection[1].evidence_sources_used", "source_not_available")]),
    (put("source_inspection.1.comparison_scope", "some"), [("source_inspection[1].comparison_scope", "scope")]),
    (put("source_inspection.+", {"source": "source_comparison", "evidence_sources_used": ["static_slides", "transcript"], "comparison_scope": "full"}), [("source_inspection[2]", "duplicate_comparison")]),
    (put("pattern_score", True), [("pattern_score", "boolean")]),
    (put("pattern_score", 0.5), [("pattern_score", "kind")]),
    (put("pattern_score", {"patterns_used": 2, "antipatterns_detected": "1", "score": 0}), [("pattern_score.patterns_used", "differs"), ("pattern_score.antipatterns_detected", "not_whole")]),
    (put("video_extraction", [1]), [("video_extraction", "not_object")]),
    (put("video_extraction.schema_version", 3), [("video_extraction.schema_version", "version")]),
    (put("video_extraction.pipeline_version", "v 1"), [("video_extraction.pipeline_version", "token")]),
    (put("video_extraction.source_video_path", "/v/y.mp4"), [("video_extraction.source_video_path", "path")]),
    (put("video_extraction.total_frames_extracted", True), [("video_extraction.total_frames_extracted", "count")]),
    (put("video_extraction.total_frames_extracted", 1), [("video_extraction.unique_frame_count", "beyond_total"), ("video_extraction.retained_frames[1].frame_index", "frame")]),
    (put("video_extraction.authored_slide_count", 3), [("video_extraction.authored_slide_count", "not_null")]),
    (put("video_extraction.fps_used", 0), [("video_extraction.fps_used", "rate")]),
    (put("video_extraction.unique_frame_count", 3), [("video_extraction.retained_frames", "length")]),
    (put("video_extraction.retained_frames.1.page_number", 3), [("video_extraction.retained_frames[1].page_number", "page")]),
    (put("video_extraction.retained_frames.1.frame_index", 0), [("video_extraction.retained_frames[1].frame_index", "frame")]),
    (put("video_extraction.retained_frames.1.timestamp_seconds", 0), [("video_extraction.retained_frames[1].timestamp_seconds", "time")]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, json.dumps(body), "x") for i, (body, _) in enumerate(CASES)] + [(1000, "{", "x"), (1001, None, "x")]
    out: dict = {}
    for r in rt.return_findings(spark.createDataFrame(rows, "k int, body string, path string"), "k", "body").collect():
        out.setdefault(r["k"], []).append((r["path"], r["code"]))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_faults(found, i):
    # a lone fault of an item that is no object also lacks what its fields would say
    assert sorted(found.get(i, [])) == sorted(CASES[i][1])


def test_bodies_that_are_no_json(found):
    assert found[1000] == found[1001] == [("$", "not_json")]


def test_catalog(spark):
    rows = spark.createDataFrame([(1, json.dumps(GOOD))], "k int, body string")
    catalog = spark.createDataFrame([("a", "antipattern", True), ("z", "antipattern", False)], "id string, entry_type string, observable boolean")
    got = sorted((r["path"], r["code"]) for r in rt.return_findings(rows, "k", "body", catalog).collect())
    assert got == [("antipatterns_detected[0].pattern_id", "not_observable"), ("applicability_assessments[0].pattern_id", "unknown_id"), ("patterns_detected[0].pattern_id", "wrong_type")]
