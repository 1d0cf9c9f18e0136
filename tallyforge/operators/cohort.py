"""Eligibility of entities, generations and the baseline of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import half_even


def generation_reasons(status: Column, fingerprint: Column, version: Column, current_fingerprint: Column, current_version: Column) -> Column:
    """Why a row's scoring is not current, as an array in fixed order; empty if it is."""
    both = F.array_compact(F.array(F.when(~fingerprint.eqNullSafe(current_fingerprint), "fingerprint_mismatch"), F.when(~version.eqNullSafe(current_version), "version_mismatch")))
    return F.when(status.isNull(), F.array(F.lit("missing_generation"))).when(status.startswith("legacy"), F.array(F.lit("legacy_generation"))).otherwise(both)


def partition_cohort(rows: DataFrame, key: str, eligible: Column, reasons: Column, stale: Column, defects: Column, excluded: DataFrame | None = None) -> DataFrame:
    """Eligible rows with a class (current, or why not) and reasons; ineligible and excluded ones are in no class.

    stale, defects: arrays of codes that are looked at in turn, only where nothing was found before. excluded: a table of
    keys, anti-joined before anything is inspected.
    """
    rows = rows.where(eligible)
    if excluded is not None:
        rows = rows.join(excluded.select(key).distinct(), key, "left_anti")
    kind = F.when(F.size(reasons) > 0, "not_current").when(F.size(stale) > 0, "stale_evidence").when(F.size(defects) > 0, "invalid_observations").otherwise("current")
    why = F.when(F.size(reasons) > 0, reasons).when(F.size(stale) > 0, stale).otherwise(defects)
    return rows.withColumns({"class": kind, "reasons": why})


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once: an error before eligibility."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def baseline(current: DataFrame, by: str, score: str, identity: str, any_evaluable: str) -> DataFrame:
    """Count, sum and HALF_EVEN average of scores where all rows share one identity and something is evaluable.

    Where they don't, count and sum are 0 and the average is null, but eligible_count stays.
    """
    agg = current.groupBy(by).agg(F.count(F.lit(1)).alias("eligible_count"), F.sum(F.col(score).cast("decimal(18,2)")).alias("s"), F.countDistinct(identity).alias("identities"), F.bool_or(any_evaluable).alias("some"))
    status = F.when(F.col("eligible_count") == 0, "empty_current_cohort").when(F.col("identities") > 1, "mixed_opportunity_coverage").when(F.col("some"), "available").otherwise("unavailable")
    ok = status == "available"
    return agg.select(
        by,
        status.alias("status"),
        "eligible_count",
        F.when(ok, F.col("eligible_count")).otherwise(0).alias("scored_count"),
        F.when(ok, F.col("s")).otherwise(F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("score_sum"),
        F.when(ok, half_even(F.col("s") / F.col("eligible_count"))).alias("score_average"),
    )


def instrumented(date_text: Column, epoch: str) -> Column:
    """Processed at or after the epoch, compared as text; a missing date is before it."""
    return F.coalesce(date_text, F.lit("")) >= epoch
