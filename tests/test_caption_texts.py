"""Caption texts that share files."""

from __future__ import annotations

import glob

from tallyforge.plans import trees
from tallyforge.sources import files, scratch


def test_captions_share_files(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "folder", lambda _, name: str(tmp_path / name))
    found = trees.caption_files(spark, sf_dir)
    kept = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert found.select("conv_id").distinct().count() == kept
    written = [p for p in glob.glob(f"{tmp_path}/captions/**", recursive=True) if p.endswith(".txt")]
    assert 0 < len(written) < kept / 2  # a folder and a file for each of them before


def test_parted_texts(spark, tmp_path):
    texts = ["WEBVTT\n\n00:01.000 --> 00:02.000\nhi\r\n\n00:02.000 --> 00:03.000\nhi\n<c>there</c>\n", "WEBVTT\n", "a\n\nb"]
    spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).write.option("lineSep", files.MARK).text(f"{tmp_path}/t")
    found = files.parted(spark, f"{tmp_path}/t")
    assert sorted(r.text for r in found.collect()) == sorted(texts)
    cues = files.captions(found.withColumn("path", found["text"])).collect()
    assert [(r.seq, r.start, r.end, r.text) for r in sorted(cues, key=lambda r: r.seq)] == [(0, 1.0, 2.0, "hi"), (1, 2.0, 3.0, "there")]
