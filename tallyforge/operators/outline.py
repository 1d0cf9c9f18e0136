"""Checks over outlines as tables of chapters, slides and lines.

slides: talk, n, chapter, and what each check names. Every check gives talk and its verdict columns, in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def expanded_count(slides: DataFrame, builds: str = "builds") -> DataFrame:
    """Slides with their builds: each counts once at least."""
    return slides.groupBy("talk").agg(F.sum(F.greatest(F.coalesce(F.col(builds), F.lit(0)), F.lit(1))).alias("slides"))


def contiguous_members(rows: DataFrame, group: list[str], number: str, least: int = 2) -> DataFrame:
    """Running gags and progressive lists: numbers 1, 2, ... without a gap, and at least `least` of them."""
    agg = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.col(number).cast("long"))).alias("found"))
    n = F.size("found").cast("long")
    return agg.withColumn("verdict", F.when(n < least, "too_few").when(F.col("found") != F.sequence(F.lit(1).cast("long"), n), "gap").otherwise("ok"))


def callbacks(rows: DataFrame) -> DataFrame:
    """Ledger of callbacks (talk, id, kind plant or pay, n): unpaid, unplanted, early (paid before planted) or ok."""
    at = lambda k, f: f(F.when(F.col("kind") == k, F.col("n")))
    agg = rows.groupBy("talk", "id").agg(at("plant", F.min).alias("planted"), at("pay", F.min).alias("paid"))
    return agg.withColumn("verdict", F.when(F.col("paid").isNull(), "unpaid").when(F.col("planted").isNull(), "unplanted").when(F.col("paid") < F.col("planted"), "early").otherwise("ok"))


def exactly_one(slides: DataFrame, flag: str) -> DataFrame:
    return slides.groupBy("talk").agg(F.count_if(F.col(flag)).alias("n")).withColumn("ok", F.col("n") == 1)


def thesis_order(slides: DataFrame, preview: Column, payoff: Column) -> DataFrame:
    """The last preview comes before the first payoff; null where either is missing."""
    agg = slides.groupBy("talk").agg(F.max(F.when(preview, F.col("n"))).alias("preview"), F.min(F.when(payoff, F.col("n"))).alias("payoff"))
    return agg.withColumn("ok", F.col("preview") < F.col("payoff"))


def opening(slides: DataFrame, mark: Column, share: float = 0.1) -> DataFrame:
    """Whether a mark stands in the first tenth of the slides, one at least."""
    w = W.partitionBy("talk")
    placed = slides.withColumns({"_i": F.row_number().over(w.orderBy("n")), "_of": F.count(F.lit(1)).over(w), "_m": mark})
    first = F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_of") * share).cast("int") + 1)
    return placed.groupBy("talk").agg(F.coalesce(F.bool_or(first & F.col("_m")), F.lit(False)).alias("ok"))


def threading(slides: DataFrame, thread: str, kind: str) -> DataFrame:
    """A story is introduced before it is recalled, and its numbers rise."""
    w = W.partitionBy("talk", thread).orderBy("n")
    rows = slides.where(F.col(thread).isNotNull()).withColumns({"_i": F.row_number().over(w), "_b": F.lag("n").over(w)})
    agg = rows.groupBy("talk", thread).agg(F.bool_and((F.col("_i") > 1) | (F.col(kind) == "introduce")).alias("introduced"), F.bool_and(F.col("_b").isNull() | (F.col("_b") < F.col("n"))).alias("rising"))
    return agg.withColumn("ok", F.col("introduced") & F.col("rising"))


def act_one(chapters: DataFrame, slides: DataFrame, big: Column, low: float = 0.15, high: float = 0.35) -> DataFrame:
    """Share of planned minutes before the chapter of the big idea. chapters: talk, chapter, pos, minutes."""
    idea = slides.where(big).groupBy("talk").agg(F.min_by("chapter", "n").alias("_idea"))
    at = chapters.join(idea, "talk", "left").groupBy("talk").agg(F.min(F.when(F.col("chapter") == F.col("_idea"), F.col("pos"))).alias("_pos"))
    agg = chapters.join(at, "talk").groupBy("talk").agg(F.sum(F.when(F.col("pos") < F.coalesce(F.col("_pos"), F.lit(1)), F.col("minutes")).otherwise(0)).alias("before"), F.sum("minutes").alias("all"))
    share = F.when(F.col("all") > 0, F.col("before") / F.col("all"))
    return agg.select("talk", share.alias("share"), F.when(share.between(low, high), "PASS").when(share.isNull(), "SKIP").otherwise("WARN").alias("verdict"))


def duration_accounting(chapters: DataFrame, talks: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Planned minutes against the talk's length: off by over a fifth warns."""
    agg = chapters.groupBy("talk").agg(F.sum("minutes").alias("planned"))
    both = talks.join(agg, "talk", "left").fillna(0, ["planned"])
    return both.select("talk", "planned", "minutes", F.when(F.abs(F.col("planned") - F.col("minutes")) > tolerance * F.col("minutes"), "WARN").otherwise("PASS").alias("verdict"))


def coverage(slides: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Members of a closed set that a talk lacks."""
    agg = slides.groupBy("talk").agg(F.collect_set(column).alias("_has"))
    return agg.select("talk", F.array_except(F.array(*map(F.lit, wanted)), "_has").alias("missing"))


def events(slides: DataFrame, interludes: DataFrame) -> DataFrame:
    """Slides and interludes (talk, after, text) in order of delivery: talk, place, kind, text."""
    a = slides.select("talk", F.col("n").alias("at"), F.lit(0).alias("rank"), F.lit("slide").alias("kind"), "text")
    b = interludes.select("talk", F.col("after").alias("at"), F.lit(1).alias("rank"), F.lit("interlude").alias("kind"), "text")
    both = a.unionByName(b)
    return both.withColumn("place", F.row_number().over(W.partitionBy("talk").orderBy("at", "rank", "text"))).select("talk", "place", "kind", "text")


def broken_references(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """References within a talk that lead nowhere; column may be an array."""
    one = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    refs = rows.select("talk", one.alias("_to")).where("_to is not null").distinct()
    return refs.join(targets.select("talk", F.col(target).alias("_to")).distinct(), ["talk", "_to"], "left_anti").withColumnRenamed("_to", "reference")


def ordered(slides: DataFrame) -> DataFrame:
    """Slide numbers, in the order written (pos), rise and are unique."""
    before = F.lag("n").over(W.partitionBy("talk").orderBy("pos"))
    return slides.withColumn("_b", before).groupBy("talk").agg(F.bool_and(F.col("_b").isNull() | (F.col("n") > F.col("_b"))).alias("ok"))


def selection(text: str, available: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Slides of a selection: all, remaining, or numbers and ranges as in 1,4-6; only those there are."""
    if text == "all":
        return available.select("n").distinct()
    if text == "remaining":
        return available.select("n").distinct().join(done.select("n"), "n", "left_anti")
    spark = available.sparkSession
    parts = spark.createDataFrame([(p.strip(),) for p in text.split(",") if p.strip()], "p string")
    low = F.regexp_extract("p", r"^(\d+)", 1).cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("p", r"-(\d+)$", 1), F.lit("")).cast("int"), low)
    return parts.select(F.explode(F.sequence(low, high)).alias("n")).distinct().join(available.select("n"), "n", "left_semi")
