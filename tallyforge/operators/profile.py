"""Profiles of cohorts: the bundle of tiers and lists, checks against live rows, and which history may be used."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import opportunity as op
from tallyforge.operators.opportunity import DETECTED

#: The parts of a policy and the thresholds that each must give.
_BAND = ("minimum_evaluable", "minimum_applicable_coverage", "minimum_lower", "maximum_upper_exclusive")
_NONE = ("minimum_applicable", "require_complete_evaluation", "maximum_detections")
POSITIVE = {"signature": ("minimum_applicable", "minimum_lower"), "regular": _BAND, "occasional": _BAND, "rare": ("minimum_evaluable", "minimum_applicable_coverage", "minimum_detections", "maximum_upper_exclusive"), "never_tried": _NONE}
RECURRENCE = {"high_frequency": ("minimum_applicable", "minimum_detections", "minimum_lower"), "moderate_frequency": ("minimum_evaluable", "minimum_applicable_coverage", "minimum_detections", "minimum_lower", "maximum_upper_exclusive"), "occasional": ("minimum_evaluable", "minimum_applicable_coverage", "minimum_detections", "maximum_upper_exclusive"), "confirmed_none": _NONE}
COMBINATIONS = {"eligible_member_classifications": ["regular", "signature"], "member_counts": [2, 3], "maximum_results": 10}
RECURRING = ("high_frequency", "moderate_frequency")


def bundle(outcomes: DataFrame, p: op.Policy = op.Policy()) -> DataFrame:
    """One row a cohort: ids of each tier in order, underused (rare and never tried), strengths (regular and signature), and the mean number of detected patterns an entity."""
    patterns = outcomes.where("polarity = 'pattern'")
    tiers = op.positive_tiers(op.evidence_bounds(op.opportunity_rates(patterns)), p)
    of = lambda *names: F.sort_array(F.collect_list(F.when(F.col("tier").isin(*names), F.col("detector"))))
    lists = tiers.groupBy("cohort").agg(*(of(n).alias(n) for n in POSITIVE), of("rare", "never_tried").alias("underused"), of("regular", "signature").alias("strengths"))
    breadth = patterns.groupBy("cohort").agg((F.count_if(F.col("outcome") == DETECTED) / F.countDistinct("entity")).alias("average_breadth"))
    return lists.join(breadth, "cohort")


def provability(catalog: DataFrame) -> DataFrame:
    """One row: observable entries whose absence can be proven (they have a gate), cannot, and in all."""
    seen = catalog.where("observable")
    return seen.agg(F.count_if(F.col("absence_gate").isNotNull()).alias("provable"), F.count_if(F.col("absence_gate").isNull()).alias("unknowable"), F.count(F.lit(1)).alias("observable"))


def recurring(recurrence: DataFrame, movements: DataFrame, key: str = "cohort") -> DataFrame:
    """Antipatterns of high or moderate recurrence with their movement, null where there is none: key, detector, tier, movement."""
    m = movements.where(F.col("movement").isin("increasing", "decreasing", "stable", "indeterminate")).select(key, "detector", "movement")
    return recurrence.where(F.col("tier").isin(*RECURRING)).select(key, "detector", "tier").join(m, [key, "detector"], "left")


def drivers(movements: DataFrame, key: str = "cohort") -> DataFrame:
    """Detectors that moved, in order: key, drivers."""
    return movements.where(F.col("movement").isin("increasing", "decreasing")).groupBy(key).agg(F.sort_array(F.collect_list("detector")).alias("drivers"))


def live_differences(stored: DataFrame, live: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, code, field): rows that only one side has (missing, unknown), fields that differ (null equals null), repeated rows."""
    twice = stored.groupBy(*key).count().where("count > 1").select(*key, F.lit("duplicate").alias("code"), F.lit(None).cast("string").alias("field"))
    s = stored.dropDuplicates(key).select(*key, F.struct(*fields).alias("_s"))
    both = s.join(live.select(*key, F.struct(*fields).alias("_l")), key, "full_outer")
    side = F.when(F.col("_s").isNull(), "missing").when(F.col("_l").isNull(), "unknown")
    other = F.array_compact(F.array(*(F.when(~F.col(f"_s.{f}").eqNullSafe(F.col(f"_l.{f}")), f) for f in fields)))
    found = F.when(side.isNotNull(), F.array(F.struct(side.alias("code"), F.lit(None).cast("string").alias("field")))).otherwise(F.transform(other, lambda f: F.struct(F.lit("differs").alias("code"), f.alias("field"))))
    return both.select(*key, F.inline(found)).unionByName(twice)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows, repeats counted."""
    return not a.exceptAll(b.select(*a.columns)).limit(1).count() and not b.select(*a.columns).exceptAll(a).limit(1).count()


def history_lane(profile_domains: Column, summary_valid: Column, summary_domains: Column) -> Column:
    """struct(lane, domains): the profile if it has any available domain, else a valid summary block with one, else none.

    domains: map from domain to status; lanes are never mixed.
    """
    some = lambda m: F.array_sort(F.map_keys(F.map_filter(m, lambda _, v: v == "available")))
    none = F.array().cast("array<string>")
    p, s = F.coalesce(some(profile_domains), none), F.coalesce(F.when(summary_valid, some(summary_domains)), none)
    lane = F.when(F.size(p) > 0, "profile").when(F.size(s) > 0, "summary").otherwise("none")
    return F.struct(lane.alias("lane"), F.when(lane == "profile", p).when(lane == "summary", s).otherwise(none).alias("domains"))


def policy_errors(policy: dict) -> list[str]:
    """What is wrong with a classification policy, by path; empty if nothing is. A policy is configuration, checked on the driver."""
    out = []

    def number(value, path, whole):
        if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or (value < 0 if whole else not 0 <= value <= 1):
            out.append(f"{path} must be {'a whole number from 0 on' if whole else 'a number from 0 to 1'}")

    def rules(part, known):
        given = policy.get(part) if isinstance(policy.get(part), dict) else {}
        if set(given) != set(known):
            out.append(f"{part} must have exactly {sorted(known)}")
        for tier, fields in known.items():
            rule = given.get(tier) if isinstance(given.get(tier), dict) else {}
            if set(rule) != set(fields):
                out.append(f"{part}.{tier} must have exactly {sorted(fields)}")
                continue
            for f, v in rule.items():
                path = f"{part}.{tier}.{f}"
                if f == "require_complete_evaluation":
                    out.extend([] if v is True else [f"{path} must be true"])
                else:
                    number(v, path, f in ("minimum_applicable", "minimum_evaluable", "minimum_detections", "maximum_detections"))
                if f == "minimum_lower" and part == "positive_patterns" and v == 0:
                    out.append(f"{path} must be over zero")
            if rule.get("maximum_detections", 0) != 0:
                out.append(f"{part}.{tier}.maximum_detections must be 0")

    if policy.get("schema_version") != 1 or isinstance(policy.get("schema_version"), bool):
        out.append("schema_version must be 1")
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,63}", str(policy.get("policy_id") or "")):
        out.append("policy_id is no identifier")
    if isinstance(policy.get("policy_version"), bool) or not isinstance(policy.get("policy_version"), int) or policy["policy_version"] < 1:
        out.append("policy_version must be a positive whole number")
    rules("positive_patterns", POSITIVE)
    rules("antipattern_recurrence", RECURRENCE)
    joint = policy.get("signature_combinations") if isinstance(policy.get("signature_combinations"), dict) else {}
    for f, v in COMBINATIONS.items():
        if joint.get(f) != v:
            out.append(f"signature_combinations.{f} must be {v}")
    for f in ("minimum_applicable", "minimum_detections"):
        number(joint.get(f), f"signature_combinations.{f}", True)
    number(joint.get("minimum_lower"), "signature_combinations.minimum_lower", False)
    return out


def resolved_policy(override: dict | None, bundled: dict) -> dict:
    """The override where there is one, else the bundled policy; an override that is there but wrong is an error, no default."""
    policy = bundled if override is None else override
    if errors := policy_errors(policy):
        raise ValueError("; ".join(errors))
    return policy
