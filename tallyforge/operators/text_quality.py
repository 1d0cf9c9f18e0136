"""Verdict on a transcript's text; the first reason wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import word_count

#: Signs of a crashed tool at a text's start, timing tags of raw captions, and marks of what isn't speech.
CRASHES = ("Traceback (most recent call last)", "AttributeError:", "NameError:", "ModuleNotFoundError:", "ImportError:")
CAPTIONS = r"<(?:\d{2}:)?\d{2}:\d{2}\.\d{3}>|</?c(?:\.[^>]*)?>"
MARKS = ("[Music]", "[Applause]", "[Laughter]", "[музыка]")


def word_floor(requested: Column, seconds: Column) -> Column:
    """Least number of words: thirty a minute, 1 to 400; a request can only raise it."""
    return F.when(seconds.isNull(), requested).otherwise(F.greatest(requested, F.least(F.lit(400), F.greatest(F.lit(1), F.ceil(seconds / 60 * 30).cast("int")))))


def verdict(text: Column, requested: Column, seconds: Column) -> Column:
    marks = sum((F.length(text) - F.length(F.replace(text, F.lit(m))) for m in MARKS), F.lit(0))
    head = F.substring(text, 1, 400)
    crashed = F.lit(False)
    for sign in CRASHES:
        crashed = crashed | head.contains(sign)
    words = word_count(text)
    return (
        F.when(text.isNull() | (F.btrim(text, F.lit(" \t\n\r")) == ""), "empty")
        .when(seconds <= 0, "invalid_parameters")
        .when(crashed, "crash_output")
        .when(F.substring(text, 1, 4000).rlike(CAPTIONS), "raw_captions")
        .when(marks > 0.5 * F.length(text), "non_speech")
        .when(words < word_floor(requested, seconds), "too_few_words")
        .when(words / (seconds / 60) < 30, "too_slow")
        .otherwise("ok")
    )
