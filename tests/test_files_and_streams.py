"""Readers, writers and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files, sinks
from tallyforge.streaming import leases


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_strict_json(spark, tmp_path):
    good = {"a.json": '{"x": 1}', "b.json": '[{"x": 1}, {"x": 2}]', "c.json": '{"returns": [{"x": 3}]}', "d.json": '{"harvest": [{"x": 4}, {"x": 5}]}'}
    bad = {"e.json": '{"a": 1, "a": 2}', "f.json": '{"a": NaN}', "g.json": '{"a": 1} x', "h.json": "3", "i.json": "{"}
    for n, t in (good | bad).items():
        put(tmp_path, n, t)
    read = files.strict_json(files.whole(spark, str(tmp_path), "*.json"))
    found = {r.path.rsplit("/", 1)[1]: r.defect for r in read.select("path", "defect").collect()}
    assert {n for n, d in found.items() if d is None} == set(good)
    assert found["h.json"] == "not_a_container" and found["e.json"] == "invalid_json"
    each = files.returns(read).select("container", "index", F.try_variant_get("return", "$.x", "int").alias("x")).collect()
    assert sorted((r.container, r["index"], r.x) for r in each) == [("array", 0, 1), ("array", 1, 2), ("harvest", 0, 4), ("harvest", 1, 5), ("single", 0, 1), ("wrapper", 0, 3)]


def test_discovery_remembers_arguments(spark, tmp_path):
    put(tmp_path, "s/a.json", "{}")
    found = files.discover(spark, [str(tmp_path), str(tmp_path / "s")]).collect()
    assert len(found) == 1 and len(found[0].arguments) == 2


def test_captions(spark, tmp_path):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\n<c>Hello</c> there\n\n00:00:02.500 --> 00:00:04.000\nHello there\nand more\n"
    put(tmp_path, "a.vtt", text)
    found = files.captions(files.whole(spark, str(tmp_path), "*.vtt")).orderBy("seq").collect()
    assert [(r.start, r.end, r.text) for r in found] == [(1.0, 2.5, "Hello there"), (2.5, 4.0, "and more")]


def test_deck_with_fences(spark, tmp_path):
    put(tmp_path, "d.md", "# One\n---\n````\n---\n```\n---\n````\ntext\n---\n\n---\n# Last\n---\n")
    found = files.deck_slides(files.whole(spark, str(tmp_path), "*.md")).orderBy("slide").collect()
    assert [(r.first_line, r.last_line) for r in found] == [(0, 0), (2, 7), (11, 11)]


def test_front_matter(spark):
    text = "---\ntitle: A talk\ntags: [x, 'y']\nlinks:\n  - one\n  - two\ntitle: B\n---\nbody"
    row = spark.createDataFrame([(text,), ("none",)], "t string").select(files.front_matter(F.col("t")).alias("m")).collect()
    assert row[0].m == {"title": ["A talk"], "tags": ["x", "y"], "links": ["one", "two"], "_repeated": ["title"]} and row[1].m is None


def test_versions_compare_and_set(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert t.commit(0, spark.range(3)) == 1 and t.read().count() == 3
    assert t.commit(1, spark.range(5)) == 2 and t.read().count() == 5 and t.read(1).count() == 3
    with pytest.raises(sinks.Conflict):
        t.commit(1, spark.range(7))
    with pytest.raises(ValueError):
        t.commit(2, spark.range(7), errors=spark.range(1))
    assert t.version() == 2
    sinks.initialise(spark.range(1), str(tmp_path / "x"))
    with pytest.raises(Exception, match="exists"):
        sinks.initialise(spark.range(1), str(tmp_path / "x"))


def test_packed_forms(spark):
    m = F.create_map(F.lit(10), F.lit("b"), F.lit(2), F.lit("a"))
    row = spark.range(1).select(sinks.packed_notes(m).alias("n"), sinks.background_spec(m).alias("s"), sinks.splice(F.lit("x<b>old<e>y"), "<b>", "<e>", F.lit("new")).alias("p"), sinks.splice(F.lit("<b><b><e>"), "<b>", "<e>", F.lit("n")).alias("q"), sinks.canonical_json("id").alias("j")).first()
    assert tuple(row) == ("2\x1fa\x1e10\x1fb", "2=a;10=b", "x<b>new<e>y", None, '{"id":0}')
    rows = spark.createDataFrame([(1, 1, "Intro", 0, 65), (1, 2, "End", 65, 30)], "d int, n int, title string, start int, seconds int")
    assert sinks.timings(rows, "d", "n", "title", "start").first().text == "0:00 Intro\n1:05 End\n1:35 FINISH"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 40")
    last = events.agg(F.max("ts"), F.min("ts")).first()
    third = (last[0] - last[1]) / 3
    for i in range(3):  # in order of time, as a stream brings them
        low = last[1] + i * third
        part = events.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(low + third))) if i < 2 else events.where(F.col("ts") >= F.lit(low))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = events.limit(1).select(F.lit(10**9).cast("long").alias("event_id"), F.lit(last[0] + 3 * third).cast("timestamp_ntz").alias("ts"), F.lit(10**9).cast("long").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    end.select(events.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = leases.leases(leases.read_events(spark, str(tmp_path / "in")))
    leases.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in leases.leases_batch(events).collect()}
    assert want <= got and len(want) > 10
    assert all(r[2] == "expired" for r in got - want)  # open at the end of the table, expired by the last watermark
