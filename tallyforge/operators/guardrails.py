"""Rules over prose, decks and names; each is a column, so a report is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Numeric claims, signs of a source, the signs of a full closing, words of the register rule, and the words
#: of a path that name an artifact's role, in order of precedence.
CLAIM = r"\d{1,3}\s*%|\$\s*\d|\d{4,}\b|\b\d+(?:\.\d+)?\s*(?:k|m|b)\b|\b\d+(?:\.\d+)?\s+(?:million|billion|thousand|trillion)\b"
SOURCE_MARKS = r"\bsource\b|\bcitation\b|\bref\b|\bvia\b|\(20\d{2}\)|\bsurvey\b|\bstudy\b|\baccording to\b|https?://"
CLOSING_SUMMARY = ("summary", "takeaway", "recap", "cheat sheet")
CLOSING_ACTION = ("call to action", "cta", "action item", "this week", "doer", "monday", "next step")
CLOSING_SOCIAL = ("shownotes", "social", "qr", "@")
CLOSING_LINKS = ("@", "http", ".com", ".dev", ".io", "/")
REGISTER_WORDS = ("damn", "hell", "shit", "fuck", "fucking", "ass", "crap", "bullshit")
ROLES = {"backup": ("backup", "backups", "bak", "archive", "archived", "old"), "master": ("master", "masters", "template", "templates", "source"), "static_export": ("static", "export", "exports", "exported")}


#: No case; borders, digits and spaces of any script.
ANY_SCRIPT = "(?iU)"


def unsourced_claim(text: Column) -> Column:
    """A percentage, multiple or sum of money without a sign of its source."""
    return F.coalesce(text.rlike(ANY_SCRIPT + CLAIM) & ~text.rlike(ANY_SCRIPT + SOURCE_MARKS), F.lit(False))


def words_found(text: Column, words: list[str]) -> Column:
    """Of a list of words those that stand whole in a text, whatever their case, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.regexp_like(text, F.concat(F.lit(ANY_SCRIPT + r"\b"), w, F.lit(r"\b"))), F.lit(False)))


def branding(text: Column, elements: list[str]) -> Column:
    """Elements of a footer that a text lacks."""
    return F.filter(F.array(*map(F.lit, elements)), lambda e: ~F.coalesce(F.contains(F.lower(text), F.lower(e)), F.lit(False)))


def closing_missing(last_text: Column) -> Column:
    """What a last chapter's text lacks of summary, CTA and social; thanks are social only beside a link."""
    low = F.lower(last_text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    social = any_of(CLOSING_SOCIAL) | (low.contains("thank") & any_of(CLOSING_LINKS))
    return F.array_compact(F.array(F.when(~any_of(CLOSING_SUMMARY), "summary"), F.when(~any_of(CLOSING_ACTION), "CTA"), F.when(~social, "social")))


def register_verdict(register: Column, on_slide: Column, spoken: Column) -> Column:
    """Strong words (counts of them) against a register: none forbids all, 'never on slide' those on slides, else a warning."""
    low = F.lower(register)
    return F.when(low.contains("none") & (on_slide + spoken > 0), "FAIL").when((on_slide > 0) & low.contains("never on slide"), "FAIL").when(on_slide > 0, "WARN").otherwise("PASS")


def cut_lines(chapters: DataFrame, least: int = 1) -> DataFrame:
    """Talks with too few chapters that may be cut. chapters: talk, cuttable."""
    return chapters.groupBy("talk").agg(F.count_if("cuttable").alias("n")).withColumn("verdict", F.when(F.col("n") < least, "WARN").otherwise("PASS"))


def prose_status(high: Column, medium: Column) -> Column:
    return F.when(high > 0, "FAIL").when(medium > 0, "WARN").otherwise("PASS")


def skip_reason(name: Column, patterns: list[str] = ()) -> Column:
    """Why a deck's file is skipped, the first reason wins: lock, static, conflict_copy or pattern."""
    why = F.when(name.startswith("~$"), "lock").when(F.lower(name).contains("static"), "static").when(name.rlike(r"\(\d+\)\.[A-Za-z]+$"), "conflict_copy")
    for p in patterns:
        why = why.when(F.lower(name).contains(p.lower()), "pattern")
    return why


def artifact_role(path: Column) -> Column:
    """Role by the whole words of a path, the first of ROLES; else delivery."""
    words, role = F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), None
    for name, marks in ROLES.items():
        found = F.arrays_overlap(words, F.array(*map(F.lit, marks)))
        role = F.when(found, name) if role is None else role.when(found, name)
    return role.otherwise("delivery")


def sentences(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?]+(\s|$)"))


def comparison_valid(text: Column, compared: Column, score: Column, expected: Column) -> Column:
    """Codes against a comparison: ten entities at least, the stored score, two to four sentences."""
    return F.array_compact(F.array(F.when(compared < 10, "too_few_compared"), F.when(~score.eqNullSafe(expected), "score_differs"), F.when(~sentences(text).between(2, 4), "sentence_count")))


def recommended(name: Column) -> Column:
    """Family of an image model by its prefix; null for others."""
    low = F.lower(name)
    return F.when(low.startswith("gpt-image"), "gpt-image").when(low.startswith("imagen"), "imagen").when(low.startswith("gemini") | low.startswith("nano-banana"), "gemini")


def stale(reviewed: Column, today: Column, days: int = 90) -> Column:
    return F.date_diff(today, reviewed) > days


def operation_errors(operations: DataFrame) -> DataFrame:
    """Order rules of a deck's operations (deck, line, op): errors by line.

    CELL needs a TABLE, and SERIES a CHART, on the same slide; a CHART needs a SERIES before the next CHART or SLIDE or
    the end; anything but SLIDE needs a slide.
    """
    w = W.partitionBy("deck").orderBy("line")
    before = w.rowsBetween(W.unboundedPreceding, 0)
    rows = operations.withColumn("_slide", F.count_if(F.col("op") == "SLIDE").over(before))
    on = W.partitionBy("deck", "_slide").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_tables": F.count_if(F.col("op") == "TABLE").over(on), "_charts": F.count_if(F.col("op") == "CHART").over(on)})
    part = W.partitionBy("deck", "_slide", "_charts")
    rows = rows.withColumn("_series", F.count_if(F.col("op") == "SERIES").over(part))
    known = F.col("op").isin("SLIDE", "TABLE", "CELL", "CHART", "SERIES", "TEXT", "IMAGE")
    error = F.when(~known, "unknown_operation").when((F.col("_slide") == 0) & (F.col("op") != "SLIDE"), "outside_slide").when((F.col("op") == "CELL") & (F.col("_tables") == 0), "cell_without_table")
    error = error.when((F.col("op") == "SERIES") & (F.col("_charts") == 0), "series_without_chart").when((F.col("op") == "CHART") & (F.col("_series") == 0), "chart_without_series")
    return rows.withColumn("error", error).where("error is not null").select("deck", "line", "op", "error")
