"""Gates of evidence, derived outcomes, and audits of stored evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .opportunity import DETECTED, NOT_APPLICABLE, NOT_EVALUABLE, UNDETECTED

#: Fixed value: the source that a group of several sources needs as well.
COMPARISON = "source_comparison"


def group_complete(group: Column, available: Column) -> Column:
    """All sources of one AND-group are there; a group of several also needs the comparison between them."""
    return (F.size(F.array_except(group, available)) == 0) & ((F.size(group) <= 1) | F.array_contains(available, COMPARISON))


def gate_open(groups: Column, available: Column) -> Column:
    """Any group of an OR of AND-groups is complete; a null gate is never open."""
    return F.coalesce(F.exists(groups, lambda g: group_complete(g, available)), F.lit(False))


def qualifying_groups(groups: Column, available: Column) -> Column:
    return F.filter(groups, lambda g: group_complete(g, available))


#: Entries that a catalog may have.
CATALOG = 10_000


def source_satisfies(groups: Column, source: Column, available: Column) -> Column:
    """Some open group names the source of a detection."""
    return F.coalesce(F.exists(groups, lambda g: F.array_contains(g, source) & group_complete(g, available)), F.lit(False))


def derive(entities: DataFrame, catalog: DataFrame, detections: DataFrame) -> DataFrame:
    """Outcome and reason of every entity with every observable catalog entry.

    entities: entity, available (sources), not_applicable (assessed entries). catalog, a small dimension: entry,
    applicability_gate, absence_gate, evaluable_from. detections: entity, entry. In turn: detected; applicability gate
    shut; assessed not applicable; no absence gate (positive only, or pending where evaluable_from is null); absence gate
    shut; undetected. Every entity gets every entry, so the catalog goes to all tasks; one of over CATALOG rows is refused.
    """
    if catalog.limit(CATALOG + 1).count() > CATALOG:
        raise ValueError(f"a catalog has at most {CATALOG} entries")
    each = entities.crossJoin(F.broadcast(catalog)).join(detections.select("entity", "entry", F.lit(True).alias("_hit")).distinct(), ["entity", "entry"], "left")
    has = F.col("_hit").isNotNull()
    closed = F.col("applicability_gate").isNotNull() & ~gate_open(F.col("applicability_gate"), F.col("available"))
    away = F.coalesce(F.array_contains("not_applicable", F.col("entry")), F.lit(False))
    no_gate, shut = F.col("absence_gate").isNull(), ~gate_open(F.col("absence_gate"), F.col("available"))
    outcome = F.when(has, DETECTED).when(closed, NOT_EVALUABLE).when(away, NOT_APPLICABLE).when(no_gate | shut, NOT_EVALUABLE).otherwise(UNDETECTED)
    reason = F.when(has, F.lit(None)).when(closed, "applicability_incomplete").when(away, "assessed").when(no_gate & F.col("evaluable_from").isNull(), "pending").when(no_gate, "positive_only").when(shut, "inspection_incomplete")
    return each.select("entity", "entry", outcome.alias("outcome"), reason.alias("reason"))


def freshness(stored: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Reasons why stored evidence is stale, by field; a value that was not observed is unknown, not different."""
    o = observed.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = stored.join(o, stored[key] == F.col("_k"), "left")
    reasons = F.array_compact(F.array(*(F.when(F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), f"{f}_changed") for f in fields)))
    state = F.when(F.col("_k").isNull(), "unverified").when(F.size(reasons) > 0, "stale").otherwise("current")
    return both.select(key, state.alias("state"), reasons.alias("reasons"))


def detection_audit(detections: DataFrame, catalog: DataFrame) -> DataFrame:
    """Codes of each detection (entity, entry, polarity, confidence, dimensions) against the catalog (entry, polarity, dimensions)."""
    c = catalog.select(F.col("entry").alias("_e"), F.col("polarity").alias("_p"), F.col("dimensions").alias("_d"))
    both = detections.join(c, F.col("entry") == F.col("_e"), "left")
    known = F.col("_e").isNotNull()
    drift = known & ~F.col("dimensions").eqNullSafe(F.col("_d"))
    same_set = F.sort_array("dimensions").eqNullSafe(F.sort_array("_d"))
    codes = F.array_compact(F.array(F.when(F.col("entry").isNull(), "missing_id"), F.when(F.col("entry").isNotNull() & ~known, "unknown_id"), F.when(known & (F.col("polarity") != F.col("_p")), "wrong_lane"), F.when(~F.coalesce(F.col("confidence").isin("strong", "moderate", "weak"), F.lit(False)), "bad_confidence"), F.when(drift & same_set, "dimension_order"), F.when(drift & ~same_set, "dimension_membership")))
    return both.select("entity", "entry", codes.alias("codes"))


def code_histogram(audits: DataFrame, subject: str = "entity") -> DataFrame:
    """For each code: how many subjects have it, the first and the last of them; code_subjects has them all as rows."""
    return code_subjects(audits, subject).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(subject).alias("first"), F.max(subject).alias("last"))


def code_subjects(audits: DataFrame, subject: str = "entity") -> DataFrame:
    """(code, subject) of each code that a subject has, once."""
    return audits.select(F.explode(F.array_distinct("codes")).alias("code"), subject).distinct()


def cited_outside(citations: DataFrame, inspected: DataFrame, key: str) -> DataFrame:
    """Citations (key, start, end) that no inspected range (key, low, high) holds."""
    r = inspected.groupBy(key).agg(F.collect_list(F.struct("low", "high")).alias("_r"))
    both = citations.join(r, key, "left")
    held = F.coalesce(F.exists("_r", lambda x: (x["low"] <= F.col("start")) & (x["high"] >= F.col("end"))), F.lit(False))
    return both.where(~held).drop("_r")


def score_resolution(stored: Column, computed: Column) -> Column:
    """agrees, missing or differs, compared as exact two-place numbers."""
    d = lambda c: c.cast("decimal(18,2)")
    return F.when(stored.isNull(), "missing").when(d(stored) == d(computed), "agrees").otherwise("differs")


#: Words of a title that mark a clip.
CLIP_MARKERS = ("clip", "demo", "excerpt", "highlight", "highlights", "preview", "promo", "short", "teaser", "trailer")


def non_delivery(marked: Column, title_agrees: Column, expected_seconds: Column, seconds: Column, lightning: Column) -> Column:
    """Signals that a recording is no full delivery, kept only where one is strong or a marker has support.

    marked: the title has a clip marker. Durations are strong signals; a marker needs a title that disagrees, or under
    fifteen minutes. Ratios count from ten expected minutes on, and two minutes are enough for a lightning talk.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    ratio = yes((expected_seconds >= 600) & (seconds / expected_seconds < 0.55))
    brief, mismatch = yes((seconds < 120) & ~lightning), yes(~title_agrees & (seconds < 600))
    signals = F.array_compact(F.array(F.when(yes(marked), "clip_marker"), F.when(ratio, "short_ratio"), F.when(brief, "under_two_minutes"), F.when(mismatch, "mismatch_under_ten_minutes")))
    kept = ratio | brief | mismatch | (yes(marked) & (yes(~title_agrees) | yes(seconds < 900)))
    return F.when(kept, signals).otherwise(F.array().cast("array<string>"))


def disposition(verdict: Column, selected: Column, stored: Column) -> Column:
    """What to do with a stored binding."""
    return (
        F.when(stored.isNull(), "unbound")
        .when((verdict == "matched") & (selected == stored), "confirmed")
        .when(verdict == "matched", "contradicted")
        .when(verdict.isin("ambiguous", "conflicting", "review"), "review")
        .otherwise("unproven")
    )


def goal_comparability(goals: DataFrame, baseline: dict) -> DataFrame:
    """Whether each goal (fingerprint, version, identity) can be compared with the current baseline, and why not."""
    differs = {f: ~F.col(f).eqNullSafe(F.lit(baseline.get(f))) for f in ("fingerprint", "version", "identity")}
    why = F.array_compact(F.array(*(F.when(c, f"{f}_differs") for f, c in differs.items())))
    kind = F.when(F.col("fingerprint").isNull(), "legacy_unknown").when(F.size(why) > 0, "not_comparable").otherwise("comparable")
    return goals.withColumns({"comparability": kind, "why": why})


def batch_match(claimed: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Differences between a claimed batch and its returns: not_returned, not_claimed, returned_twice."""
    n = returned.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = claimed.select(key, F.lit(True).alias("_c")).join(n, key, "full_outer")
    code = F.when(F.col("_n").isNull(), "not_returned").when(F.col("_c").isNull(), "not_claimed").when(F.col("_n") > 1, "returned_twice")
    return both.select(key, code.alias("code")).where("code is not null")


def title_ledger(pairs: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of titles that a ledger approves, on keys that have been put in normal form."""
    return pairs.join(ledger.select(*keys).distinct(), keys, "left_semi")


def capabilities(**present: Column) -> Column:
    """Names of the sources that are present, in the order given."""
    return F.array_compact(F.array(*(F.when(c, n) for n, c in present.items())))
