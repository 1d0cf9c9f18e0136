"""Budgets, batches, repairs, digests and provider evidence: known answers and boundaries."""

from __future__ import annotations

import random

import pytest

from tallyforge.operators import admission, digests as dg, identity as idn, provider as pv, repairs as rp
from tallyforge.sources import changes as ch, scan
from tallyforge.sources.sinks import VersionedTable


def test_running_sums_do_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(1)
    data = [(f"{rng.random():.12f}", rng.randint(0, 9) if rng.random() < 0.9 else None) for _ in range(400)]
    want, total = {}, 0
    for k, v in sorted(data):
        total += v or 0
        want[k] = total
    for parts, ranges in ((1, 1), (5, 3), (3, 16)):
        rows = spark.createDataFrame(data, "k string, v int").repartition(parts)
        assert {r["k"]: r["s"] for r in admission.running_sums(rows, ["k"], {"s": admission.F.col("v")}, ranges).collect()} == want
    assert admission.running_sums(rows.limit(0), ["k"], {"s": admission.F.col("v")}).count() == 0


def test_admission_stops_at_the_first_row_beyond_a_budget(spark):
    rows = spark.createDataFrame([("a", 5, None), ("b", 90, "pruned"), ("c", 5, None), ("d", 1, None), ("e", 0, None)], "k string, n int, reason string")
    asked = lambda files, size: {r["k"]: r["reason"] for r in admission.admitted(rows, ["k"], {"files": (admission.F.lit(1), files), "bytes": (admission.F.col("n"), size)}).collect()}
    assert asked(9, 10) == {"a": None, "b": "pruned", "c": None, "d": "bytes", "e": "bytes"}  # e would fit, but d stopped it
    assert asked(2, 10) == {"a": None, "b": "pruned", "c": None, "d": "files", "e": "files"}
    assert asked(0, 0)["a"] == "files" and asked(9, 11)["e"] is None


def test_a_scan_lists_prunes_and_reads_no_more_than_its_budget(spark, tmp_path):
    for path, text in {"a/1.txt": "x\ny", "a/deep/er/2.txt": "z", "b/3.txt": "12345", "old/4.txt": "no", "old.txt/5.txt": "5", "c/6.md": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = scan.listing(spark, str(tmp_path), "*.txt")
    assert {r["path"]: (r["name"], r["bytes"]) for r in files.collect()} == {"a/1.txt": ("1.txt", 3), "a/deep/er/2.txt": ("2.txt", 1), "b/3.txt": ("3.txt", 5), "old/4.txt": ("4.txt", 2), "old.txt/5.txt": ("5.txt", 1)}
    found = scan.within_budget(scan.pruned(files, ["old"], scan.F.when(scan.F.col("name") == "nothing", "named"), max_depth=2), 10, 8)
    assert {r["path"]: r["reason"] for r in found.collect()} == {"a/1.txt": None, "a/deep/er/2.txt": "depth", "b/3.txt": None, "old/4.txt": "pruned", "old.txt/5.txt": "input_limit"}
    assert sorted(map(tuple, scan.lines(spark, found).collect())) == [("a/1.txt", "x"), ("a/1.txt", "y"), ("b/3.txt", "12345")]
    assert scan.lines(spark, found.where("reason = 'depth'")).count() == 0


def test_a_batch_is_persisted_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v string, n int")
    assert ch.persist(t, batch((1, "a", 1), (2, "b", 2), (2, "b", 2)), "k") == 1
    assert ch.persist(t, batch((2, "b", 2)), "k") == 1  # a replay
    assert ch.persist(t, batch((2, "c", 2), (3, None, 3), (1, "a", 1)), "k") == 2
    assert ch.persist(t, batch((2, "b", 2)), "k") == 2  # an old return again does not undo a newer one
    assert sorted(map(tuple, t.read(2, "rows").collect())) == [(1, "a", 1), (2, "c", 2), (3, None, 3)]
    assert sorted((r["version"], r["k"], r["change"]) for r in ch.change_log(t).collect()) == [(1, 1, "insert"), (1, 2, "insert"), (2, 2, "update"), (2, 3, "insert")]
    assert t.read(2, "receipts").count() == 4
    for bad in (((4, "x", 1), (4, "y", 1)), ((None, "x", 1), (5, "x", 1))):
        with pytest.raises(ValueError):
            ch.persist(t, batch(*bad), "k")
    with pytest.raises(ValueError):
        ch.persist(t, batch((6, "x", -1)), "k", rules=lambda b: b.where("n < 0").selectExpr("k", "'negative' as code"))
    assert t.version() == 2
    changes = ch.changed(batch((1, "a", 1), (2, "b", 2)), batch((2, "b", 3), (3, None, None)), "k")
    assert {r["k"]: r["change"] for r in changes.collect()} == {1: "delete", 2: "update", 3: "insert"}


def test_repairs_are_made_together_or_not_at_all(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", 7)], "k int, s string, n int")
    said = lambda *x: spark.createDataFrame(x or [], "k int, field string, value string")
    good, against, log = rp.repair(rows, "k", said((1, "s", "a"), (2, "s", None), (3, "n", "7")), said((1, "s", "b"), (2, "s", "z"), (3, "n", "7")), ["s", "n"])
    assert sorted(map(tuple, good.collect())) == [(1, "b", 5), (2, "z", 6), (3, "c", 7)] and against.count() == 0
    assert sorted(map(tuple, log.collect())) == [(1, "s", "a", "b"), (2, "s", None, "z")]  # 3 was 7 before
    same, against, log = rp.repair(rows, "k", said((1, "s", "a"), (2, "s", "x"), (9, "s", "x"), (1, "q", "x")), said((1, "s", "b"), (1, "s", None), (3, "n", "8")), ["s", "n"])
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and log.count() == 0
    assert sorted(map(tuple, against.collect()), key=str) == [(1, "q", "unknown_field"), (1, "s", "conflicting_sets"), (2, "s", "precondition_failed"), (3, "n", "unguarded_set"), (9, "s", "unknown_key")]
    twice = rp.findings(rows.union(rows), "k", said((1, "s", "a")), said((1, "s", "b")), ["s", "n"])
    assert [tuple(r) for r in twice.collect()] == [(1, None, "duplicate_key")]


def test_only_buckets_that_differ_are_compared(spark):
    live = spark.range(1000).selectExpr("cast(id as int) k", "id % 7 as v", "cast(null as string) s")
    stored = live.where("k <> 5").selectExpr("k", "case when k in (6, 7) then null else v end v", "case when k = 8 then 'x' end s")
    stored = stored.union(stored.where("k = 9")).union(spark.createDataFrame([(None, 1, "n"), (2000, 1, "n")], "k int, v long, s string"))
    got = sorted(((r["k"], r["code"], r["field"], r["stored"], r["live"]) for r in dg.assessed(stored, live, ["k"], ["v", "s"]).collect()), key=str)
    want = [(5, "missing", None, None, None), (6, "differs", "v", None, "6"), (8, "differs", "s", "x", None), (9, "duplicate", None, None, None), (2000, "unknown", None, None, None), (None, "unknown", None, None, None)]
    assert got == sorted([*want, (7, "differs", "v", None, "0")], key=str)
    assert dg.differing_buckets(stored, live, ["k"], ["v", "s"], 4096).count() <= 8
    assert dg.differing_buckets(live.repartition(7), live, ["k"], ["v", "s"], 64).count() == 0
    stale = dg.assessed(live, live, ["k"], ["v"], stamps=("a", "b"))
    assert stale.count() == 1000 and {r["code"] for r in stale.collect()} == {"stale_stamp"}
    assert dg.differing_buckets(live, live, ["k"], ["v"], 64, ("a", "b")).count() == 64


META = "video_id string, id string, title string, uploader string, uploader_id string, upload_date string, duration double, webpage_url string, fetched boolean"


def test_provider_evidence(spark):
    url = "https://youtu.be/"
    a, b = "aaaaaaaaaaa", "bbbbbbbbbbb"
    rows = [(a, f" {a} ", " Talk ", "u", "", "20240229", 60.0, url + a, True), (a, b, "", None, None, "20230229", -1.0, None, True), (a, None, "t", "u", "i", "2024", float("inf"), url + b, True)]
    found = pv.evidence(spark.createDataFrame(rows, META), "video_id").collect()
    assert [r["faults"] for r in found] == [[], ["provider_video_id_mismatch", "provider_metadata_incomplete"], ["provider_video_id_mismatch", "provider_webpage_identity_mismatch", "provider_metadata_incomplete"]]
    assert found[0]["evidence"].asDict() == {"video_id": a, "title": "Talk", "uploader": "u", "uploader_id": None, "upload_date": "2024-02-29", "duration_seconds": 60.0, "webpage_url": url + a, "webpage_video_id": a}
    assert [r["missing"] for r in found[1:]] == [["title", "uploader", "upload_date", "duration_seconds", "webpage_url"], ["upload_date", "duration_seconds"]]


@pytest.mark.parametrize("expected,seconds,agrees", [(600.0, 660.0, True), (600.0, 660.5, False), (1200.0, 1260.0, True), (4000.0, 4200.0, True), (4000.0, 4200.5, False), (None, 5.0, None), (5.0, None, None)])
def test_tolerance(spark, expected, seconds, agrees):
    row = spark.createDataFrame([(expected, seconds)], "e double, s double").select(pv.within_tolerance(pv.F.col("e"), pv.F.col("s")).alias("x")).first()
    assert row["x"] is agrees


def test_audit_orders_its_findings(spark):
    ids = [c * 11 for c in "abcd"]
    page = lambda i: "https://youtu.be/" + i
    meta = [(ids[0], ids[0], "Rust in the kernel at GoWorld 2020", "u", None, "20200101", 100.0, page(ids[0]), True), (ids[1], ids[0], "x", "u", None, "20200101", 9.0, page(ids[1]), True), (ids[2], None, None, None, None, None, None, None, False), (ids[3], ids[3], "Of mice and men", "u", None, "20210501", 1800.0, page(ids[3]), True)]
    talks = [(1, ids[0], "Other matters entirely", "RustFest", "2020-06-01", 1800.0, "someone"), (2, ids[1], "x", "GoWorld", None, None, None), (3, ids[2], "x", None, None, None, None), (4, ids[3], "Of mice and men", "RustFest", "2021", 1890.0, "u"), (5, "z" * 11, "x", None, None, None, None)]
    talks = spark.createDataFrame(talks, "talk int, video_id string, title string, conference string, date string, expected_seconds double, stored string")
    found = pv.audit(talks, pv.evidence(spark.createDataFrame(meta, META), "video_id"), "talk", idn.known_aliases(talks), {"uploader": "stored"}).orderBy("talk", "place").collect()
    assert [(r["talk"], r["code"], r["priority"]) for r in found] == [
        (1, "provider_event_mismatch", "high"), (1, "likely_non_delivery_clip", "high"), (1, "provider_title_mismatch", "medium"), (1, "provider_duration_mismatch", "medium"), (1, "provider_upload_predates_catalog", "medium"), (1, "stored_source_identity_differs", "medium"),
        (2, "provider_video_id_mismatch", "high"), (3, "metadata_fetch_failed", "high"),
    ]
