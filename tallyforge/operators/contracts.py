"""Contracts of stored and returned records, each as an array of codes: empty means that the record keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.admission import running_sums

from tallyforge.functions import nested, numbers as nu
from tallyforge.operators.opportunity import DETECTED, NOT_APPLICABLE, NOT_EVALUABLE, UNDETECTED

#: Versions, states and statuses that a record may have.
CLAIM_VERSIONS = (1, 2, 3, 4, 5, 6)
SNAPSHOT_CLAIM_VERSIONS = (3, 4, 5, 6)
CLAIM_STATES = ("claimed", "completed", "stale_recovered", "superseded")
CLAIMABLE = ("pending", "needs-reprocessing", "skipped_download_failed")
ANALYSIS_STATUSES = ("processed", "processed_partial")
RETURN_STATUSES = ("processed", "processed_partial", "skipped_no_sources", "skipped_download_failed", "skipped_duplicate")
UNAVAILABLE_REASONS = ("empty_current_cohort", "mixed_opportunity_coverage", "no_evaluable_pattern_opportunities")
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
DIGEST = "^[0-9a-f]{64}$"
CHANNELS = {"transcript": ("transcript", "timed_transcript"), "static_slides": ("slides", "slide_sequence"), "native_deck": ("slides", "slide_sequence"), "delivery_video": ("video",)}
METADATA = "talk_metadata"


def codes(*pairs: tuple[str, Column]) -> Column:
    """Codes whose condition holds, in order; a condition that is null holds not."""
    return F.array_compact(F.array(*(F.when(c, code) for code, c in pairs)))


def no(c: Column) -> Column:
    """A demand that is not met, or can't be judged."""
    return ~F.coalesce(c, F.lit(False))


def claim_errors(claim: Column, historical: bool = False) -> Column:
    """Codes of a queue claim: version, run_id, batch_id, claimed_at, previous_status, generation, state, required_version."""
    named = lambda c: c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$")
    snapshot = claim["schema_version"].isin(*SNAPSHOT_CLAIM_VERSIONS)
    own = [
        ("claim_missing", claim.isNull()), ("version_newer", claim["schema_version"] > max(CLAIM_VERSIONS)), ("version_unsupported", no(claim["schema_version"].isin(*CLAIM_VERSIONS)) & no(claim["schema_version"] > max(CLAIM_VERSIONS))),
        ("run_id_invalid", no(named(claim["run_id"]))), ("batch_id_invalid", no(named(claim["batch_id"]))), ("claimed_at_invalid", F.try_to_timestamp(claim["claimed_at"]).isNull()),
        ("previous_status_not_restorable", no(claim["previous_status"].isin(*CLAIMABLE))), ("generation_invalid", no(claim["reprocess_generation"] >= 1)), ("state_invalid", no(claim["state"].isin(*CLAIM_STATES))),
        ("claimed_at_not_canonical", snapshot & no(claim["claimed_at"].rlike(STAMP))), ("required_version_differs", snapshot & no(claim["required_return_schema_version"] == claim["schema_version"])),
        ("history_still_claimed", F.lit(historical) & (claim["state"] == "claimed")),
    ]
    return F.when(claim.isNull(), F.array(F.lit("claim_missing"))).otherwise(codes(*own[1:]))


def archived(claim: Column, history: Column, now: Column) -> Column:
    """The history with the current claim put after it; one that is still held is superseded, with time and reason."""
    held = claim["state"] == "claimed"
    moved = claim.withField("state", F.when(held, "superseded").otherwise(claim["state"])).withField("released_at", F.when(held, now).otherwise(claim["released_at"])).withField("release_reason", F.when(held, "new_generation_claimed").otherwise(claim["release_reason"]))
    return F.when(claim.isNull(), history).when(history.isNull(), F.array(moved)).otherwise(F.array_append(history, moved))


def active_claims(talks: DataFrame) -> DataFrame:
    """One row: talks that a writer holds, by status or by claim, counted once each."""
    return talks.agg(F.count_if((F.col("status") == "reprocessing-inflight") | F.coalesce(F.col("claim_state") == "claimed", F.lit(False))).alias("active_claims"))


def baseline_errors(b: Column) -> Column:
    """Codes of an adherence baseline of the current schema: counts, sum, average, identity, comparison and exclusions.

    The average must be the sum over the count, to two places, halves to even.
    """
    n, eligible, total = b["scored_talk_count"], b["eligible_talk_count"], b["pattern_score_sum"]
    average = nu.half_even(total.cast("decimal(28,10)") / n)
    available, why = b["raw_score_comparison_status"] == "available", b["raw_score_comparison_reason"]
    reason_fits = ((why == "empty_current_cohort") & (eligible == 0)) | ((why == "mixed_opportunity_coverage") & (eligible >= 2)) | ((why == "no_evaluable_pattern_opportunities") & (eligible >= 1))
    return codes(
        ("as_of_not_canonical", no(b["as_of"].rlike(STAMP))), ("excluded_not_sorted", no(b["excluded_filenames"] == F.array_sort(F.array_distinct(b["excluded_filenames"])))),
        ("excluded_without_batch", ~b["active_batch_excluded"] & (F.size(b["excluded_filenames"]) > 0)), ("fingerprint_invalid", no(b["pattern_catalog_fingerprint"].rlike(DIGEST))), ("scoring_version_invalid", no(b["pattern_scoring_schema_version"] >= 1)),
        ("count_invalid", no(n >= 0)), ("sum_without_talks", (n == 0) & no(total == 0)), ("average_without_talks", (n == 0) & b["average_pattern_score"].isNotNull()), ("average_differs", (n > 0) & no(b["average_pattern_score"].cast("decimal(18,2)") == average)),
        ("identity_invalid", b["opportunity_coverage_identity"].isNotNull() & no(b["opportunity_coverage_identity"].rlike(DIGEST))), ("identity_missing", (n > 0) & b["opportunity_coverage_identity"].isNull()), ("identity_without_talks", (n == 0) & b["opportunity_coverage_identity"].isNotNull()),
        ("comparison_status_invalid", no(b["raw_score_comparison_status"].isin("available", "unavailable"))), ("available_without_basis", available & (why.isNotNull() | no(n >= 1) | no(eligible == n))),
        ("unavailable_reason_invalid", ~available & no(why.isin(*UNAVAILABLE_REASONS))), ("unavailable_with_talks", ~available & no(n == 0)), ("reason_disagrees", ~available & why.isin(*UNAVAILABLE_REASONS) & no(reason_fits)),
    )


def opportunity_errors(row: DataFrame, cohort: Column) -> DataFrame:
    """Adds errors to opportunity rows (detected, evaluable, unevaluable, not_applicable, eligible, out_of, times, coverage, rate).

    cohort: the number of entities that each row must account for.
    """
    count = lambda *names: [(f"{n}_invalid", no(F.col(n) >= 0)) for n in names]
    same = lambda a, b: a.eqNullSafe(b) | (F.abs(a - b) < 1e-12)
    found = codes(
        *count("detected", "evaluable", "unevaluable", "not_applicable", "eligible", "out_of", "times"),
        ("eligible_differs", F.col("eligible") != cohort), ("detected_over_evaluable", F.col("detected") > F.col("evaluable")), ("counts_do_not_add_up", F.col("evaluable") + F.col("unevaluable") + F.col("not_applicable") != cohort),
        ("out_of_differs", F.col("out_of") != F.col("evaluable")), ("times_differs", F.col("times") != F.col("detected")), ("coverage_differs", no(same(F.col("coverage"), nu.ratio(F.col("evaluable"), cohort)))), ("rate_differs", no(same(F.col("rate"), nu.ratio(F.col("detected"), F.col("evaluable"))))),
    )
    return row.withColumn("errors", found)


def lane_errors(rows: DataFrame, catalog: DataFrame, key: str = "pattern_id") -> DataFrame:
    """(key, code): ids that a lane has twice, lacks, or has without the catalog's knowing."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = n.join(catalog.select(key, F.lit(True).alias("_there")).distinct(), key, "full_outer")
    code = F.when(F.col("_n").isNull(), "missing").when(F.col("_there").isNull(), "unknown_or_wrong_polarity").when(F.col("_n") > 1, "duplicate")
    return both.select(key, code.alias("code")).where("code is not null")


def projection_reasons(o: Column) -> Column:
    """Why stored lanes don't follow from stored outcomes.

    o: pattern_outcomes (pattern_id, outcome), patterns_detected, antipatterns_detected and not_evaluable (ids), and
    applicability_assessments (pattern_id, result).
    """
    none = F.array().cast("array<string>")
    lanes = ("patterns_detected", "antipatterns_detected", "not_evaluable")

    def read(o):
        outcomes, lists = o["pattern_outcomes"], {f: F.coalesce(o[f], none) for f in lanes}
        of = lambda kind: F.transform(F.filter(outcomes, lambda x: x["outcome"] == kind), lambda x: x["pattern_id"])
        lane_ok = lambda f: F.coalesce(o[f].isNotNull() & F.forall(o[f], lambda i: i.isNotNull() & (i != "")) & (F.size(F.array_distinct(o[f])) == F.size(o[f])), F.lit(False))
        valid = outcomes.isNotNull() & F.forall(outcomes, lambda x: x["pattern_id"].isNotNull() & (x["pattern_id"] != "") & x["outcome"].isin(DETECTED, UNDETECTED, NOT_EVALUABLE, NOT_APPLICABLE))
        named = F.transform(outcomes, lambda x: x["pattern_id"])
        assessed = F.coalesce(F.transform(o["applicability_assessments"], lambda a: a["pattern_id"]), none)
        away = F.coalesce(F.transform(F.filter(o["applicability_assessments"], lambda a: a["result"] == "not_applicable"), lambda a: a["pattern_id"]), none)
        odd = F.exists(o["applicability_assessments"], lambda a: no(a["result"].isin("applicable", "not_applicable")))
        each = {"valid": valid, "named": named, "assessed": assessed, "away": away, "odd": odd, "detected": F.array_union(lists["patterns_detected"], lists["antipatterns_detected"]), "is_detected": of(DETECTED), "is_not_evaluable": of(NOT_EVALUABLE), "is_not_applicable": of(NOT_APPLICABLE)}
        return F.struct(*(c.alias(n) for n, c in each.items()), *(c.alias(n) for n, c in lists.items()), *(lane_ok(f).alias(f"{f}_ok") for f in lanes))

    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)

    def judged(r):
        ok = F.coalesce(r["valid"] & (F.size(F.array_distinct(r["named"])) == F.size(r["named"])), F.lit(False))
        detected, open_ = r["detected"], r["not_evaluable"]
        return codes(
            ("pattern_outcomes_projection_invalid", ~ok), *((f"{f}_ids_invalid", ~r[f"{f}_ok"]) for f in lanes),
            ("applicability_assessment_results_invalid", r["odd"]),
            ("pattern_detection_polarity_overlap", F.arrays_overlap(r["patterns_detected"], r["antipatterns_detected"])), ("pattern_observation_lane_overlap", F.arrays_overlap(detected, F.array_union(open_, r["assessed"])) | F.arrays_overlap(open_, r["away"])),
            ("pattern_outcomes_unknown_lane_ids", ok & (F.size(F.array_except(F.array_union(F.array_union(detected, open_), r["assessed"]), F.coalesce(r["named"], none))) > 0)),
            ("pattern_outcomes_detected_projection_drift", ok & r["patterns_detected_ok"] & r["antipatterns_detected_ok"] & differ(r["is_detected"], detected)), ("pattern_outcomes_not_evaluable_projection_drift", ok & r["not_evaluable_ok"] & differ(r["is_not_evaluable"], open_)),
            ("pattern_outcomes_not_applicable_projection_drift", ok & differ(r["is_not_applicable"], r["away"])),
        )

    return nested.bound(o, lambda o: nested.bound(read(o), judged))


def swapped(evidence_is_dimensions: Column, dimensions_is_text: Column, evidence: Column, dimensions: Column) -> Column:
    """The repair of an exact swap, struct(evidence, dimensions), where each side has the other's shape in full; else null."""
    return F.when(evidence_is_dimensions & dimensions_is_text, F.struct(dimensions.alias("evidence"), evidence.alias("dimensions")))


def variant_swap(detection: Column) -> Column:
    """swapped() of a VARIANT detection: evidence an array of whole numbers from 1 to 14, dimensions a text that is not blank."""
    numbers = F.try_variant_get(detection, "$.evidence", "array<int>")
    text = F.try_variant_get(detection, "$.dimensions", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(detection, path, "variant"))
    listed = kind("$.evidence").startswith("ARRAY<BIGINT") & (F.size(numbers) > 0) & F.forall(numbers, lambda d: d.between(1, 14)) & (F.size(F.array_distinct(numbers)) == F.size(numbers))
    said = (kind("$.dimensions") == "STRING") & (F.btrim(text) != "")
    return swapped(F.coalesce(listed, F.lit(False)), F.coalesce(said, F.lit(False)), numbers, text)


def inspections(rows: DataFrame, key: str) -> DataFrame:
    """Canonical inspections of sources: (key, source, ranges, complete, absence_complete, error).

    rows: key, source, ranges (array<struct<start, end>>), upper (pages, lines or whole seconds of the source; null where it
    was not verified), absence_capable. Ranges come out sorted and joined; a source is complete when they reach from 1 to upper.
    """
    n = rows.groupBy(F.col(key).alias("_k"), F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    both = rows.join(n, (F.col(key) == F.col("_k")) & (F.col("source") == F.col("_s")), "left")
    joined = nested.page_ranges(F.col("ranges"), F.col("upper"))
    error = F.when(F.col("source").isNull() | ~F.col("source").isin(*CHANNELS), "source_unsupported").when(F.col("_n") > 1, "source_duplicate").when(no(F.col("upper") >= 1), "source_unverified").when(no(F.size("ranges") > 0), "ranges_missing").when(joined.isNull(), "ranges_invalid")
    done = error.isNull() & (F.size(joined) == 1) & (F.element_at(joined, 1)["start"] == 1) & (F.element_at(joined, 1)["end"] == F.col("upper"))
    out = both.withColumns({"_ranges": F.when(error.isNull(), joined), "complete": F.coalesce(done, F.lit(False)), "error": error})
    return out.select(key, "source", F.col("_ranges").alias("ranges"), "complete", (F.col("complete") & F.coalesce("absence_capable", F.lit(False))).alias("absence_complete"), "error")


def citation_errors(source: Column, used: Column, channels: Column, citations: Column) -> Column:
    """Codes of a detection's citations (array<struct<source, channel>>).

    Each must belong to the sources the detection names (of a comparison those it used, two at least), fit its source and be
    a channel that the catalog permits; every source needs one that is no metadata.
    """
    both = source == "source_comparison"
    expected = F.when(both, used).otherwise(F.array(source))
    fits = lambda c: F.coalesce(F.arrays_overlap(F.array(c["channel"]), F.try_element_at(F.create_map(*(x for k, v in CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, (*v, METADATA)))))), c["source"])), F.lit(False))
    covered = F.transform(F.filter(citations, lambda c: c["channel"] != METADATA), lambda c: c["source"])
    return codes(
        ("source_missing", source.isNull()), ("comparison_without_sources", both & no(F.size(used) >= 2)), ("citations_missing", no(F.size(citations) > 0)), ("citation_of_other_source", F.exists(citations, lambda c: no(F.array_contains(expected, c["source"])))),
        ("channel_does_not_fit", F.exists(citations, lambda c: ~fits(c))), ("channel_not_permitted", F.exists(citations, lambda c: no(F.array_contains(channels, c["channel"])))), ("source_not_located", F.size(F.array_except(expected, F.coalesce(covered, F.array().cast("array<string>")))) > 0),
    )


def return_errors(r: Column) -> Column:
    """Codes of one return as a whole.

    r: filename, status, schema_version, claim (its codes), slide_source, slides_readable, prose (map of texts), patterns and
    antipatterns (ids), not_evaluable (ids), score, computed_score, detection_errors (codes of all its detections).
    """
    analysed = r["status"].isin(*ANALYSIS_STATUSES)
    lists = [F.coalesce(r[f], F.array().cast("array<string>")) for f in ("patterns", "antipatterns", "not_evaluable")]
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    return codes(
        ("filename_missing", no(F.btrim(r["filename"]) != "")), ("status_invalid", no(r["status"].isin(*RETURN_STATUSES))), ("version_unsupported", no(r["schema_version"].isin(*CLAIM_VERSIONS))), ("claim_invalid", F.size(r["claim"]) > 0),
        ("slide_source_missing", analysed & r["slide_source"].isNull()), ("processed_without_slides", (r["status"] == "processed") & no(r["slides_readable"])), ("prose_blank", analysed & no(F.forall(F.map_values(r["prose"]), lambda t: F.btrim(t) != ""))),
        ("skipped_with_results", ~analysed & (F.size(F.concat(*lists)) > 0)), ("duplicate_ids", twice(lists[0]) | twice(lists[1]) | twice(lists[2])), ("both_polarities", F.arrays_overlap(lists[0], lists[1])),
        ("detected_and_not_evaluable", F.arrays_overlap(F.concat(lists[0], lists[1]), lists[2])), ("score_differs", analysed & no(r["score"].cast("decimal(18,2)") == r["computed_score"].cast("decimal(18,2)"))), ("detections_invalid", analysed & (F.size(r["detection_errors"]) > 0)),
    )


def usable(talks: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Talks whose stored observations may be rendered: those without any, and those whose audit has no code."""
    bad = audits.where(F.size("codes") > 0).select(key).distinct()
    return talks.join(bad, key, "left_anti")


def counters(rows: DataFrame) -> DataFrame:
    """One row: accepted, rejected and invalid returns, accepted and invalid entries. rows: kind (return, entry), state."""
    n = lambda kind, state: F.count_if((F.col("kind") == kind) & (F.col("state") == state))
    return rows.agg(n("return", "accepted").alias("accepted_returns"), n("return", "rejected").alias("rejected_returns"), n("return", "invalid").alias("invalid_returns"), n("entry", "accepted").alias("accepted_entries"), n("entry", "invalid").alias("invalid_entries"))


def database_errors(talks: DataFrame, key: str, statuses: tuple[str, ...]) -> DataFrame:
    """(key, code) of a tracking table: blank or repeated keys, unknown statuses, claims that break their contract, scores that differ.

    talks: key, status, claim_errors (codes), score, observed_score. Repeated keys are one row each.
    """
    n = talks.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    both = talks.join(n, F.col(key) == F.col("_k"), "left")
    found = codes(("key_blank", no(F.btrim(key) != "")), ("key_repeated", F.col("_n") > 1), ("status_unknown", no(F.col("status").isin(*statuses))), ("claim_invalid", F.size("claim_errors") > 0), ("in_flight_without_claim", (F.col("status") == "reprocessing-inflight") & F.col("claim_errors").isNull()), ("score_differs", F.col("observed_score").isNotNull() & no(F.col("score") == F.col("observed_score"))))
    return both.select(key, F.explode(found).alias("code")).distinct()


def provenance_key(path: Column, index: Column, filename: Column, talk: Column, lane: Column, entry: Column) -> Column:
    """What records are sorted by: missing texts as empty, missing numbers as -1."""
    t, n = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(c, F.lit(-1)))
    return F.struct(t(path).alias("path"), n(index).alias("index"), t(filename).alias("filename"), t(talk).alias("talk"), t(lane).alias("lane"), n(entry).alias("entry"))


#: What findings of a catalog are sorted by.
CATALOG_ORDER = ("code", "path", "entry_id", "field", "related_id", "message")


def in_issue_order(issues: DataFrame, provenance: str | None = None) -> DataFrame:
    """Findings by code, where they come from (a provenance key), and what they say; of a catalog by code, path, entry and field."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return issues.orderBy(blank("code"), provenance, blank("message")) if provenance else issues.orderBy(*map(blank, CATALOG_ORDER))


def issue_places(issues: DataFrame, provenance: str | None = None) -> DataFrame:
    """issues with `place`, from 1, in the order of in_issue_order; findings that are equal throughout have one row and
    `times`. Places are prefix sums over ranges of the order, so no code is gathered and nothing is sorted in one task."""
    names = ["code", provenance, "message"] if provenance else list(CATALOG_ORDER)
    blank = {n: F.col(n) if n == provenance else F.coalesce(F.col(n), F.lit("")) for n in names}
    once = issues.withColumns(blank).groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    summed = running_sums(once, names, {"_end": F.col("times")})
    return summed.select(*names, "times", (F.col("_end") - F.col("times") + 1).alias("place"))


def chosen(values: Column, identity=None) -> Column:
    """struct(value, conflict) of an array: the first value that is there; conflict where another one differs.

    identity: what tells whether two values are one, such as an address without its form; by default the value itself.
    """
    found = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.btrim(v) != "")))
    kinds = F.array_distinct(F.transform(found, identity)) if identity else found
    return F.struct(F.get(found, F.lit(0)).alias("value"), ((F.size(found) > 1) & (F.size(kinds) > 1)).alias("conflict"))
