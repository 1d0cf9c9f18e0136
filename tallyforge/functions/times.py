"""Date, time and duration column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(text: Column) -> Column:
    """The date of YYYY-MM-DD, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def provider_date(text: Column) -> Column:
    """The date of YYYYMMDD, null for anything else."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def day_or_year(text: Column) -> Column:
    """struct(day, year) of a full date or a bare year."""
    day = strict_date(text)
    year = F.when(text.rlike(r"^\d{4}$"), text.cast("int")).otherwise(F.year(day))
    return F.struct(day.alias("day"), year.alias("year"))


def utc_seconds(text: Column) -> Column:
    """A time with an offset as UTC whole seconds; one without an offset is null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.date_trunc("second", F.try_to_timestamp(text)))


def minutes(text: Column) -> Column:
    """The first whole number, times 60 where hours are named; 0 is null."""
    n = F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("int")
    return F.nullif(n * F.when(text.rlike(r"(?i)\b(hour|hr)s?\b"), 60).otherwise(1), F.lit(0))


def clock_seconds(text: Column) -> Column:
    """Seconds of [HH:]MM:SS.mmm."""
    parts = F.reverse(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return at(0) + 60 * at(1) + 3600 * at(2)


def m_ss(seconds: Column) -> Column:
    """Minutes without padding, seconds with."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def predates(upload: Column, day: Column, year: Column) -> Column:
    """Uploaded over a day before the catalogued date; null where a date is unknown."""
    return upload < F.date_sub(F.coalesce(day, F.make_date(year, F.lit(1), F.lit(1))), 1)


def in_range(value: Column, text: Column) -> Column:
    """value in a range N, A-B or N+; the single form allows half a unit on both sides."""
    low = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    high = F.regexp_extract(text, r"-\s*(\d+(?:\.\d+)?)\s*$", 1).try_cast("double")
    return F.when(text.contains("+"), value >= low).when(high.isNotNull(), value.between(low, high)).otherwise(F.abs(value - low) <= 0.5)
