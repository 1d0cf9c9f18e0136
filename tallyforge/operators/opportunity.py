"""Outcome matrices: rates with honest denominators, bounds, tiers, combinations, identities and scores.

An outcome table has a row for each entity and detector: entity, cohort, detector, polarity, absence_capable, outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallyforge.functions.numbers import ratio

DETECTED, UNDETECTED, NOT_EVALUABLE, NOT_APPLICABLE = "detected", "undetected", "not_evaluable", "not_applicable"


@dataclass(frozen=True)
class Detector:
    """A named test of an entity, as SQL expressions over its columns."""

    name: str
    polarity: str
    applicable: str
    evaluable: str
    detected: str
    absence_capable: bool = True


@dataclass(frozen=True)
class Policy:
    """Fixed thresholds of the classification."""

    signature_n: int = 8
    signature_lower: float = 0.7
    evaluable_n: int = 8
    coverage: float = 0.8
    regular_lower: float = 0.4
    regular_upper: float = 0.7
    occasional_lower: float = 0.15
    occasional_upper: float = 0.4
    rare_upper: float = 0.15
    high_n: int = 8
    high_detected: int = 4
    high_lower: float = 0.5
    moderate_detected: int = 3
    moderate_lower: float = 0.25
    moderate_upper: float = 0.5
    joint_n: int = 8
    joint_detected: int = 4
    joint_lower: float = 0.4
    joint_kept: int = 10


def outcome_of(applicable: Column, evaluable: Column, detected: Column) -> Column:
    """The one of four states; a null test counts as failed."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(applicable), NOT_APPLICABLE).when(~yes(evaluable), NOT_EVALUABLE).when(yes(detected), DETECTED).otherwise(UNDETECTED)


def derive_outcomes(entities: DataFrame, detectors: list[Detector], entity: str, cohort: str) -> DataFrame:
    """Every entity with every detector: exhaustive, made in the scan's own stage, without a join."""
    states = F.array(*(F.struct(F.lit(d.name).alias("detector"), F.lit(d.polarity).alias("polarity"), F.lit(d.absence_capable).alias("absence_capable"), outcome_of(F.expr(d.applicable), F.expr(d.evaluable), F.expr(d.detected)).alias("outcome")) for d in detectors))
    return entities.select(F.col(entity).alias("entity"), F.col(cohort).alias("cohort"), F.inline(states))


def opportunity_rates(outcomes: DataFrame, detectors: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts of the four states for each cohort and detector, coverage E/N and rate D/E (null where nothing is evaluable).

    detectors (detector, polarity, absence_capable), a small dimension, gives a row even to those without outcomes.
    """
    keys = ["cohort"] if by is None else by
    is_ = lambda s: F.count_if(F.col("outcome") == s)
    counts = outcomes.groupBy(*keys, "detector", "polarity", "absence_capable").agg(is_(DETECTED).alias("d"), (is_(DETECTED) + is_(UNDETECTED)).alias("e"), is_(NOT_EVALUABLE).alias("u"), is_(NOT_APPLICABLE).alias("na"), F.count(F.lit(1)).alias("n"))
    if detectors is not None:
        scaffold = counts.select(*keys).distinct().crossJoin(F.broadcast(detectors)) if keys else detectors
        counts = scaffold.join(counts, [*keys, "detector", "polarity", "absence_capable"], "left").fillna(0, ["d", "e", "u", "na", "n"])
    return counts.withColumns({"coverage": ratio(F.col("e"), F.col("n")), "rate": ratio(F.col("d"), F.col("e"))})


def evidence_bounds(rates: DataFrame) -> DataFrame:
    """Adds applicable A = N - NA, applicable_coverage E/A, lower D/A and upper (D + U)/A; null where A is 0."""
    a = F.col("n") - F.col("na")
    return rates.withColumn("a", a).withColumns({"applicable_coverage": ratio(F.col("e"), F.col("a")), "lower": ratio(F.col("d"), F.col("a")), "upper": ratio(F.col("d") + F.col("u"), F.col("a"))})


def observation_status() -> Column:
    certain = F.col("absence_capable") & (F.col("e") == F.col("a"))
    return F.when(F.col("a") == 0, "unavailable").when(F.col("d") > 0, "observed").when(certain, "confirmed_absent").otherwise("not_yet_observed")


def positive_tiers(bounds: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Tier of each pattern, first match wins, and its observation status."""
    d, e, a, cov, low, up = map(F.col, ("d", "e", "a", "applicable_coverage", "lower", "upper"))
    enough = (e >= p.evaluable_n) & (cov >= p.coverage)
    certain = F.col("absence_capable") & (e == a)
    tier = (
        F.when(a == 0, "unclassified")
        .when((d > 0) & (a >= p.signature_n) & (low >= p.signature_lower), "signature")
        .when((d > 0) & enough & (low >= p.regular_lower) & (up < p.regular_upper), "regular")
        .when((d > 0) & enough & (low >= p.occasional_lower) & (up < p.occasional_upper), "occasional")
        .when(enough & (d >= 1) & (up < p.rare_upper), "rare")
        .when(certain & (a >= p.signature_n) & (d <= 0), "never_tried")
        .when((d == 0) & ~certain, "not_yet_observed")
        .otherwise("unclassified")
    )
    return bounds.where("polarity = 'pattern'").withColumns({"tier": tier, "status": observation_status()})


def recurrence_tiers(bounds: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Tier of each antipattern, first match wins, and its observation status."""
    d, e, a, cov, low, up = map(F.col, ("d", "e", "a", "applicable_coverage", "lower", "upper"))
    enough = (e >= p.evaluable_n) & (cov >= p.coverage)
    tier = (
        F.when(a == 0, "unclassified")
        .when((a >= p.high_n) & (d >= p.high_detected) & (low >= p.high_lower), "high_frequency")
        .when(enough & (d >= p.moderate_detected) & (low >= p.moderate_lower) & (up < p.moderate_upper), "moderate_frequency")
        .when(enough & (d >= 1) & (up < p.moderate_lower), "occasional")
        .when(F.col("absence_capable") & (a >= p.high_n) & (e == a) & (d <= 0), "confirmed_none")
        .otherwise("unclassified")
    )
    return bounds.where("polarity = 'antipattern'").withColumns({"tier": tier, "status": observation_status()})


def insufficiency(bounds: DataFrame, least_a: int = 8, least_e: int = 8, least_coverage: float = 0.8) -> DataFrame:
    """Adds reasons (array) why evidence is too thin; no applicable entity is a reason of its own."""
    some = F.array_compact(F.array(F.when(F.col("a") < least_a, "too_few_applicable"), F.when(F.col("e") < least_e, "too_few_evaluable"), F.when(F.col("applicable_coverage") < least_coverage, "coverage_too_low")))
    return bounds.withColumn("reasons", F.when(F.col("a") == 0, F.array(F.lit("no_applicable_entities"))).otherwise(some))


def joint_outcome(members: Column) -> Column:
    """Outcome of several: all detected; all evaluable; any not applicable; else not evaluable."""
    return (
        F.when(F.forall(members, lambda o: o == DETECTED), DETECTED)
        .when(F.forall(members, lambda o: o.isin(DETECTED, UNDETECTED)), UNDETECTED)
        .when(F.exists(members, lambda o: o == NOT_APPLICABLE), NOT_APPLICABLE)
        .otherwise(NOT_EVALUABLE)
    )


def combinations(outcomes: DataFrame, members: DataFrame, size: int, p: Policy = Policy()) -> DataFrame:
    """Pairs or triples of member detectors that occur together often enough; the best joint_kept of each cohort.

    members: (cohort, detector), the regular and signature patterns. An entity's member outcomes are one array, so the
    combinations are made in place instead of by self-joins over all outcomes.
    """
    rows = outcomes.join(members, ["cohort", "detector"])
    each = rows.groupBy("cohort", "entity").agg(F.sort_array(F.collect_list(F.struct("detector", "outcome"))).alias("all"))
    all_ = F.col("all")
    tails = lambda x, xs: F.filter(xs, lambda y: y["detector"] > x["detector"])
    combos = F.flatten(F.transform(all_, lambda x: F.transform(tails(x, all_), lambda y: F.array(x, y))))
    if size == 3:
        combos = F.flatten(F.transform(combos, lambda xy: F.transform(tails(F.element_at(xy, 2), all_), lambda z: F.concat(xy, F.array(z)))))
    each = each.select("cohort", F.explode(combos).alias("c"))
    each = each.select("cohort", F.array_join(F.transform("c", lambda x: x["detector"]), "+").alias("combination"), joint_outcome(F.transform("c", lambda x: x["outcome"])).alias("outcome"))
    is_ = lambda s: F.count_if(F.col("outcome") == s)
    counts = each.groupBy("cohort", "combination").agg(is_(DETECTED).alias("d"), (is_(DETECTED) + is_(UNDETECTED)).alias("e"), is_(NOT_EVALUABLE).alias("u"), F.count_if(F.col("outcome") != NOT_APPLICABLE).alias("a"))
    counts = counts.withColumns({"lower": ratio(F.col("d"), F.col("a")), "upper": ratio(F.col("d") + F.col("u"), F.col("a"))})
    kept = counts.where((F.col("a") >= p.joint_n) & (F.col("d") >= p.joint_detected) & (F.col("lower") >= p.joint_lower))
    rank = F.row_number().over(W.partitionBy("cohort").orderBy(F.col("lower").desc(), F.col("d").desc(), "combination"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= p.joint_kept)


def identity(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over the sorted states of all detectors, detected and undetected alike as evaluable."""
    state = F.when(F.col("outcome").isin(DETECTED, UNDETECTED), "evaluable").otherwise(F.col("outcome"))
    states = F.sort_array(F.collect_list(F.struct("detector", state.alias("state"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(states, lambda s: F.concat(F.lit('["'), s["detector"], F.lit('","'), s["state"], F.lit('"]'))), ","), F.lit("]"))
    return outcomes.groupBy(*by).agg(F.sha2(text, 256).alias("identity"), F.bool_or(F.col("outcome").isin(DETECTED, UNDETECTED)).alias("any_evaluable"))


#: Weight of a detection by confidence.
WEIGHTS = {"strong": "1.00", "moderate": "0.50", "weak": "0.25"}


def weighted_scores(detections: DataFrame, by: str) -> DataFrame:
    """Weighted patterns less weighted antipatterns, exact, two places. detections: by, polarity, confidence."""
    weight = F.lit(None).cast("decimal(10,2)")
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("confidence") == name, F.lit(w).cast("decimal(10,2)")).otherwise(weight)
    signed = F.when(F.col("polarity") == "pattern", weight).otherwise(-weight)
    return detections.groupBy(by).agg(F.sum(signed).cast("decimal(18,2)").alias("score"), F.count(F.lit(1)).alias("detections"))


def lane_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one of two tables has: key columns and side (missing: only left, unknown: only right)."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown")))
