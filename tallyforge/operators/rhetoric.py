"""Checks over an outline's applied patterns, integrity of its references, and its build sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an outline of this architecture must declare, and how often (no upper number: any).
SPARKLINE = {"call-to-adventure": (1, 1), "call-to-action": (1, 1), "new-bliss": (1, 1), "star-moment": (1, None)}
MOST_INOCULATIONS = 3


def sparkline(outlines: DataFrame, key: str, patterns: DataFrame) -> DataFrame:
    """(key, element, n, status): PASS or FLAG by SPARKLINE, N/A for other architectures.

    patterns: key, pattern. Outlines without any get zeros.
    """
    elements = F.array(*(F.struct(F.lit(k).alias("element"), F.lit(lo).alias("low"), F.lit(hi).cast("int").alias("high")) for k, (lo, hi) in SPARKLINE.items()))
    found = patterns.where(F.col("pattern").isin(*SPARKLINE)).groupBy(F.col(key).alias("_k"), F.col("pattern").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    each = outlines.select(key, (F.coalesce("talk.architecture", F.lit("")) == "sparkline").alias("is"), F.inline(elements))
    both = each.join(found, (F.col(key) == F.col("_k")) & (F.col("element") == F.col("_p")), "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    ok = (F.col("n") >= F.col("low")) & (F.col("high").isNull() | (F.col("n") <= F.col("high")))
    return both.select(key, "element", "n", F.when(~F.col("is"), "N/A").when(ok, "PASS").otherwise("FLAG").alias("status"))


def inoculations(outlines: DataFrame, key: str, patterns: DataFrame) -> DataFrame:
    """(key, n, status, where): INFO without any, FLAG over the most, else PASS; where lists location and vector."""
    own = patterns.where("pattern = 'inoculation'").groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("place", "at", F.concat("location", F.lit(" ("), F.coalesce("vector", F.lit("?")), F.lit(")")).alias("w")))).alias("_w"))
    both = outlines.select(key).join(own, F.col(key) == F.col("_k"), "left")
    n = F.coalesce(F.size("_w"), F.lit(0))
    return both.select(key, n.alias("n"), F.when(n == 0, "INFO").when(n > MOST_INOCULATIONS, "FLAG").otherwise("PASS").alias("status"), F.coalesce(F.transform("_w", lambda x: x["w"]), F.array().cast("array<string>")).alias("where"))


def tree_errors(outlines: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """(key, errors): what breaks the contract of an outline, codes in order; of a partial one slides may be missing."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    chapters, notes = F.coalesce(F.transform("chapters", lambda c: c["id"]), none("string")), F.transform("slides", lambda s: s["n"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    twice = lambda a: size(F.array_distinct(a)) < size(a)
    refs = F.flatten(F.flatten(F.transform("chapters", lambda c: F.transform(c["argument_beats"], lambda b: F.coalesce(b["slide_refs"], none("int"))))))
    speakers = F.coalesce("talk.speakers", none("string"))
    items = F.concat(*(F.coalesce(F.flatten(F.transform(c, lambda s: s["script"])), none("struct<line:string,cue:string,parenthetical:string,speaker:string>")) for c in ("slides", "interludes")))
    lines = F.filter(items, lambda x: x["line"].isNotNull())
    steps = F.exists("slides", lambda s: F.transform(s["builds"], lambda b: b["step"]) != F.when(F.size(s["builds"]) > 0, F.sequence(F.lit(0), F.size(s["builds"]) - 1)).otherwise(none("int")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    codes = [
        ("chapters_missing", size("chapters") == 0), ("slides_missing", (size("slides") == 0) & F.lit(not partial)), ("duplicate_chapter", twice(chapters)),
        ("unknown_chapter", yes(F.exists("slides", lambda s: ~F.array_contains(chapters, s["chapter"]))) | yes(F.exists("interludes", lambda s: ~F.array_contains(chapters, s["chapter"])))),
        ("unknown_slide_ref", size(F.array_except(refs, F.coalesce(notes, none("int")))) > 0), ("unknown_anchor", yes(F.exists("interludes", lambda i: ~F.array_contains(notes, i["after_slide"])))),
        ("duplicate_interlude", twice(F.transform("interludes", lambda i: i["id"]))), ("duplicate_slide", twice(notes)), ("slides_out_of_order", yes(F.array_sort(notes) != notes)),
        ("big_idea_count", (size("slides") > 0) & (size(F.filter("slides", lambda s: yes(s["big_idea"]))) != 1)), ("build_steps", yes(steps)),
        ("speaker_missing", (F.size(F.array_distinct(speakers)) > 1) & yes(F.exists(lines, lambda x: x["speaker"].isNull()))), ("speaker_on_single", (F.size(F.array_distinct(speakers)) <= 1) & yes(F.exists(lines, lambda x: x["speaker"].isNotNull()))),
        ("unknown_speaker", yes(F.exists(items, lambda x: x["speaker"].isNotNull() & ~F.array_contains(speakers, x["speaker"])))),
    ]
    return outlines.select(key, F.array_compact(F.array(*(F.when(c, code) for code, c in codes))).alias("errors"))


def build_manifest(slides: DataFrame, frames: DataFrame, key: str, notes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, missing): frames of each slide with builds in order of step, and steps without a frame.

    slides: key, n, builds (array of steps). frames: key, n, step, frame. notes: key, n, text of the slide. Slides that miss
    a frame are not in the manifest.
    """
    steps = slides.where(F.size("builds") > 0).select(key, "n", F.explode(F.array_distinct("builds")).alias("step"))
    both = steps.join(frames.groupBy(key, "n", "step").agg(F.min("frame").alias("frame")), [key, "n", "step"], "left")
    missing = both.where("frame is null").select(key, "n", "step")
    whole = both.groupBy(key, F.col("n").alias("parent")).agg(F.bool_and(F.col("frame").isNotNull()).alias("_whole"), F.sort_array(F.collect_list(F.struct("step", "frame"))).alias("_f")).where("_whole")
    whole = whole.select(key, "parent", F.transform("_f", lambda x: x["frame"]).alias("frames"))
    if notes is None:
        return whole.withColumn("notes", F.lit("")), missing
    said = notes.select(key, F.col("n").alias("parent"), F.col("text").alias("notes"))
    return whole.join(said, [key, "parent"], "left").withColumn("notes", F.coalesce("notes", F.lit(""))), missing


def packed_builds(manifest: DataFrame, key: str) -> DataFrame:
    """(key, packed): builds by falling parent; fields parted by unit, frames by group, builds by record separators."""
    one = F.concat(F.col("parent").cast("string"), F.lit(chr(31)), "notes", F.lit(chr(31)), F.array_join("frames", chr(29)))
    each = manifest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("parent", one.alias("x"))), asc=False).alias("_all"))
    return each.select(key, F.array_join(F.transform("_all", lambda x: x["x"]), chr(30)).alias("packed"))


def reserved(text: Column) -> Column:
    """A text holds one of the separators that packed forms use."""
    return text.rlike("[\\x1d-\\x1f]")
