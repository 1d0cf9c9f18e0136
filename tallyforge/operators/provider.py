"""What a provider says of a source: stable fields and faults, and the audit of records against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import numbers as nu, text as tx, times as tm
from tallyforge.operators import evidence as ev, identity as idn

#: Fields of which none may be missing, in the order in which they are named.
REQUIRED = ("title", "uploader", "upload_date", "duration_seconds", "webpage_url")
#: Codes by priority, the gravest first; those of the first line stop the audit of a source.
CRITICAL = ("provider_video_id_mismatch", "provider_webpage_identity_mismatch")
ORDER = (*CRITICAL, "metadata_fetch_failed", "provider_metadata_incomplete", "provider_event_mismatch", "likely_non_delivery_clip", "provider_title_mismatch", "provider_duration_mismatch", "provider_upload_predates_catalog", "stored_source_identity_differs")
HIGH = ORDER[:6]


def _text(column: str | Column) -> Column:
    """A text without blanks around it; null where nothing is left."""
    return F.nullif(F.btrim(column), F.lit(""))


def evidence(metadata: DataFrame, requested: str) -> DataFrame:
    """metadata with `evidence` and `faults`.

    metadata: the requested id and id, title, uploader, uploader_id, upload_date (YYYYMMDD), duration, webpage_url, as a
    provider gives them. evidence keeps blank texts, impossible dates and durations that are not positive and finite as
    null. faults, in order: an id or a page's id that is not the one asked for, and metadata_incomplete where a required
    field is null; `missing` names those fields.
    """
    url = _text("webpage_url")
    day = F.date_format(tm.provider_date(F.col("upload_date")), "yyyy-MM-dd")
    fields = {"video_id": _text("id"), "title": _text("title"), "uploader": _text("uploader"), "uploader_id": _text("uploader_id"), "upload_date": day, "duration_seconds": nu.positive(F.col("duration")).cast("double"), "webpage_url": url, "webpage_video_id": tx.video_id(url)}
    out = metadata.withColumn("evidence", F.struct(*(c.alias(n) for n, c in fields.items())))
    missing = F.array_compact(F.array(*(F.when(F.col(f"evidence.{f}").isNull(), f) for f in REQUIRED)))
    other = ~F.col("evidence.video_id").eqNullSafe(F.col(requested))
    page = F.col("evidence.webpage_url").isNotNull() & ~F.col("evidence.webpage_video_id").eqNullSafe(F.col(requested))
    out = out.withColumn("missing", missing)
    faults = F.array_compact(F.array(F.when(other, CRITICAL[0]), F.when(page, CRITICAL[1]), F.when(F.size("missing") > 0, "provider_metadata_incomplete")))
    return out.withColumn("faults", faults)


def within_tolerance(expected: Column, seconds: Column) -> Column:
    """Durations at most a minute, or a twentieth of the expected one, apart; null where one is unknown."""
    return F.abs(seconds - expected) <= F.greatest(F.lit(60.0), expected * 0.05)


def comparisons(talks: DataFrame, sources: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Each talk with its source: title_agrees, event_agrees, duration_agrees and predates, null where a side says nothing.

    talks: key, video_id, title, conference, date, expected_seconds; sources: rows of evidence() with video_id, its
    requested id. Talks meet sources by their id; those of a source with a critical fault, or without one, are left out.
    """
    good = sources.where(~F.arrays_overlap("faults", F.array(*map(F.lit, CRITICAL)))).select("video_id", "evidence")
    both = talks.join(good, "video_id").withColumn("_title", F.col("evidence.title"))
    both = both.withColumn("title_agrees", tx.titles_agree(_text("title"), F.col("_title")))
    both = both.withColumn("duration_agrees", within_tolerance(F.col("expected_seconds"), F.col("evidence.duration_seconds")))
    on = tm.day_or_year(F.col("date"))
    both = both.withColumn("predates", tm.predates(tm.strict_date(F.col("evidence.upload_date")), on["day"], on["year"]))
    event = idn.event_agreement(both.select(key, "conference", "_title"), key, "conference", "_title", aliases).select(key, F.col("agrees").alias("event_agrees"))
    return both.drop("_title").join(event, key, "left")


def audit(talks: DataFrame, sources: DataFrame, key: str, aliases: DataFrame, stored: dict[str, str]) -> DataFrame:
    """(video_id, key, code, priority, place): findings of sources and of talks, `place` their order within a source.

    sources as of evidence(), with a null evidence.video_id and title where nothing was fetched and `fetched` false;
    stored: field of evidence to the talk's column that holds it. A fault of a source is a finding for each of its talks.
    A source with a critical fault, or that was not fetched, has no other findings.
    """
    fault = F.when(~F.col("fetched"), F.array(F.lit("metadata_fetch_failed"))).otherwise(F.col("faults"))
    of_source = talks.select(key, "video_id").join(sources.select("video_id", F.explode(fault).alias("code")), "video_id")
    seen = comparisons(talks, sources.where("fetched"), key, aliases)
    marked = F.arrays_overlap(tx.all_words(F.col("evidence.title")), F.array(*map(F.lit, ev.CLIP_MARKERS)))
    signals = ev.non_delivery(marked, F.col("title_agrees"), F.col("expected_seconds"), F.col("evidence.duration_seconds"), F.lit(False))
    other = [F.col(column).isNotNull() & F.col(f"evidence.{f}").isNotNull() & (F.col(column).cast("string") != F.col(f"evidence.{f}").cast("string")) for f, column in stored.items()]
    differs = other[0]
    for o in other[1:]:
        differs = differs | o
    said = {"provider_event_mismatch": ~F.col("event_agrees"), "likely_non_delivery_clip": F.size(signals) > 0, "provider_title_mismatch": ~F.col("title_agrees"), "provider_duration_mismatch": ~F.col("duration_agrees"), "provider_upload_predates_catalog": F.col("predates"), "stored_source_identity_differs": differs}
    of_talk = seen.select("video_id", key, F.explode(F.array_compact(F.array(*(F.when(c, code) for code, c in said.items())))).alias("code"))
    out = of_source.select("video_id", key, "code").unionByName(of_talk)
    place = F.coalesce(*(F.when(F.col("code") == c, i) for i, c in enumerate(ORDER)))
    return out.select("video_id", key, "code", F.when(F.col("code").isin(*HIGH), "high").otherwise("medium").alias("priority"), place.alias("place"))
