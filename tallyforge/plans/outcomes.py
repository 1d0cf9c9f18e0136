"""Queries over the outcome matrix of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import cohort, opportunity as op
from tallyforge.operators.opportunity import Detector
from tallyforge.sources import scratch
from tallyforge.sources.tables import table

D = Detector
DETECTORS = [
    D("multi_line", "pattern", "true", "w >= 5", "nl > 1"),
    D("accented", "pattern", "lang <> 'en'", "w >= 5", "nonascii"),
    D("long_form", "pattern", "true", "true", "w >= 200"),
    D("very_long", "pattern", "true", "true", "w >= 400"),
    D("has_digit", "pattern", "true", "w >= 5", "digit"),
    D("no_article_en", "pattern", "lang = 'en'", "w >= 20", "NOT article"),
    D("question", "pattern", "true", "true", "ask"),
    D("question_positive_only", "pattern", "true", "true", "ask", absence_capable=False),
    D("good_label", "pattern", "true", "quality IS NOT NULL", "quality = 1"),
    D("stub", "antipattern", "true", "true", "w < 200"),
    D("exact_copy", "antipattern", "true", "true", "dup > 1"),
    D("shouting", "antipattern", "true", "w >= 5", "caps"),
    D("bang", "antipattern", "true", "true", "bang"),
    D("question_anti", "antipattern", "true", "true", "ask"),
    D("toxic", "antipattern", "true", "quality IS NOT NULL", "toxic = 1"),
]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """What the detectors look at, one row a document; the text itself goes no further than the scan."""
    t = F.col("text")
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.md5("text").alias("digest"), F.regexp_count(t, F.lit(r"\S+")).alias("w"), (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).alias("nl"),
        (F.octet_length(t) != F.length(t)).alias("nonascii"), t.rlike("[0-9]").alias("digit"), ((F.col("lang") == "en") & t.rlike(r"(^|[^A-Za-z])[Tt]he([^A-Za-z]|$)")).alias("article"), t.contains("?").alias("ask"), t.rlike("[A-Z]{3,}").alias("caps"), t.contains("!").alias("bang"),
    )
    # only digests that stand twice come back, so a large group of copies is no key of its own for the others
    copies = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("dup")).where("dup > 1")
    return docs.join(copies, "digest", "left").withColumn("dup", F.coalesce("dup", F.lit(1))).join(table(spark, sf, "labels"), "doc_id", "left")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return op.derive_outcomes(features(spark, sf), DETECTORS, "doc_id", "source")


_FEATURES = """f AS (SELECT d.doc_id, d.lang, d.source, len(regexp_extract_all(d.text, '\\S+')) AS w, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS nl,
  regexp_matches(d.text, '[^\\x00-\\x7F]') AS nonascii, regexp_matches(d.text, '[0-9]') AS digit, regexp_matches(d.text, '(^|[^A-Za-z])[Tt]he([^A-Za-z]|$)') AS article,
  contains(d.text, '?') AS ask, regexp_matches(d.text, '[A-Z]{3,}') AS caps, contains(d.text, '!') AS bang,
  count(*) OVER (PARTITION BY d.text) AS dup, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_OUTCOMES = f"WITH {_FEATURES}, o AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS entity, source AS cohort, '{d.name}' AS detector, '{d.polarity}' AS polarity, {str(d.absence_capable).lower()} AS absence_capable, CASE WHEN NOT coalesce({d.applicable}, false) THEN 'not_applicable' WHEN NOT coalesce({d.evaluable}, false) THEN 'not_evaluable' WHEN coalesce({d.detected}, false) THEN 'detected' ELSE 'undetected' END AS outcome FROM f"
    for d in DETECTORS
) + ")"
_RATES = _OUTCOMES + """, c AS (SELECT cohort, detector, polarity, absence_capable, count(*) FILTER (outcome = 'detected') AS d, count(*) FILTER (outcome IN ('detected', 'undetected')) AS e,
  count(*) FILTER (outcome = 'not_evaluable') AS u, count(*) FILTER (outcome = 'not_applicable') AS na, count(*) AS n FROM o GROUP BY ALL),
r AS (SELECT *, e::DOUBLE / nullif(n, 0) AS coverage, d::DOUBLE / nullif(e, 0) AS rate FROM c),
b AS (SELECT *, n - na AS a, e::DOUBLE / nullif(n - na, 0) AS applicable_coverage, d::DOUBLE / nullif(n - na, 0) AS lower, (d + u)::DOUBLE / nullif(n - na, 0) AS upper FROM r)"""
_STATUS = "CASE WHEN a = 0 THEN 'unavailable' WHEN d > 0 THEN 'observed' WHEN absence_capable AND e = a THEN 'confirmed_absent' ELSE 'not_yet_observed' END AS status"
_POSITIVE = """CASE WHEN a = 0 THEN 'unclassified' WHEN d > 0 AND a >= 8 AND lower >= 0.7 THEN 'signature'
  WHEN d > 0 AND e >= 8 AND applicable_coverage >= 0.8 AND lower >= 0.4 AND upper < 0.7 THEN 'regular'
  WHEN d > 0 AND e >= 8 AND applicable_coverage >= 0.8 AND lower >= 0.15 AND upper < 0.4 THEN 'occasional'
  WHEN e >= 8 AND applicable_coverage >= 0.8 AND d >= 1 AND upper < 0.15 THEN 'rare' WHEN absence_capable AND a >= 8 AND e = a AND d <= 0 THEN 'never_tried'
  WHEN d = 0 AND NOT (absence_capable AND e = a) THEN 'not_yet_observed' ELSE 'unclassified' END AS tier"""


def rates(spark, sf):
    return op.opportunity_rates(outcomes(spark, sf))


def bounds_tiers(spark, sf):
    return op.positive_tiers(op.evidence_bounds(rates(spark, sf))).drop("polarity")


def recurrence(spark, sf):
    return op.recurrence_tiers(op.evidence_bounds(rates(spark, sf))).drop("polarity")


def insufficient(spark, sf):
    found = op.insufficiency(op.evidence_bounds(rates(spark, sf)))
    return found.select("cohort", "detector", F.array_join("reasons", ",").alias("reasons"))


def _joint(size):
    def query(spark, sf):
        # counts and combinations read one written matrix, so each rule runs over the texts once
        rows = scratch.written(outcomes(spark, sf).where("polarity = 'pattern'"), "outcomes")
        tiers = op.positive_tiers(op.evidence_bounds(op.opportunity_rates(rows))).where("tier IN ('regular', 'signature')").select("cohort", "detector")
        return op.combinations(rows, tiers, size)

    return query


def _joint_sql(size):
    tables = ["o1", "o2", "o3"][:size]
    joins = " ".join(f"JOIN m {t} ON {t}.entity = o1.entity AND {t}.detector > {p}.detector" for p, t in zip(tables, tables[1:]))
    alls = lambda cond: " AND ".join(cond.format(t) for t in tables)
    anys = " OR ".join(f"{t}.outcome = 'not_applicable'" for t in tables)
    name = " || '+' || ".join(f"{t}.detector" for t in tables)
    detected, evaluable = alls("{}.outcome = 'detected'"), alls("{}.outcome IN ('detected', 'undetected')")
    return _RATES + f""", t AS (SELECT *, {_POSITIVE} FROM b WHERE polarity = 'pattern'),
m AS (SELECT o.* FROM o JOIN t USING (cohort, detector) WHERE t.tier IN ('regular', 'signature')),
j AS (SELECT o1.cohort, {name} AS combination, CASE WHEN {detected} THEN 'detected' WHEN {evaluable} THEN 'undetected' WHEN {anys} THEN 'not_applicable' ELSE 'not_evaluable' END AS outcome FROM m o1 {joins}),
g AS (SELECT cohort, combination, count(*) FILTER (outcome = 'detected') AS d, count(*) FILTER (outcome IN ('detected', 'undetected')) AS e, count(*) FILTER (outcome = 'not_evaluable') AS u, count(*) FILTER (outcome <> 'not_applicable') AS a FROM j GROUP BY ALL),
k AS (SELECT *, d::DOUBLE / nullif(a, 0) AS lower, (d + u)::DOUBLE / nullif(a, 0) AS upper FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY lower DESC, d DESC, combination) AS rank FROM k WHERE a >= 8 AND d >= 4 AND lower >= 0.4) WHERE rank <= 10"""


def identities(spark, sf):
    return op.identity(outcomes(spark, sf), ["entity", "cohort"])


_IDENTITY = """SELECT entity, cohort, sha256('[' || string_agg('["' || detector || '","' || CASE WHEN outcome IN ('detected', 'undetected') THEN 'evaluable' ELSE outcome END || '"]', ',' ORDER BY detector) || ']') AS identity,
  bool_or(outcome IN ('detected', 'undetected')) AS any_evaluable FROM o GROUP BY entity, cohort"""


def _detections(spark, sf):
    found = outcomes(spark, sf).where("outcome = 'detected'")
    return found.withColumn("confidence", F.when(F.length("detector") >= 10, "strong").when(F.length("detector") >= 8, "moderate").otherwise("weak"))


def scores(spark, sf):
    return op.weighted_scores(_detections(spark, sf), "entity").select("entity", F.col("score").cast("double").alias("score"), "detections")


_SCORE = """s AS (SELECT entity, sum((CASE polarity WHEN 'pattern' THEN 1 ELSE -1 END) * (CASE WHEN length(detector) >= 10 THEN 100 WHEN length(detector) >= 8 THEN 50 ELSE 25 END)) AS cents, count(*) AS detections FROM o WHERE outcome = 'detected' GROUP BY entity)"""


def _cohort(spark, sf):
    ident = identities(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("entity"), "lang", F.col("n_chars"))
    rows = ident.join(docs, "entity")
    status = F.when(F.col("entity") % 13 == 0, F.lit(None).cast("string")).when(F.col("entity") % 11 == 0, "legacy_unbaselineable").otherwise("current")
    reasons = cohort.generation_reasons(status, F.col("lang"), (F.col("entity") % 5).cast("int"), F.lit("en"), F.when(F.col("entity") % 5 == 4, F.lit(0)).otherwise(F.col("entity") % 5).cast("int"))
    stale = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "too_short")))
    defects = F.array_compact(F.array(F.when(F.col("n_chars") > 20_000, "too_long")))
    excluded = docs.where("entity % 17 = 0").select("entity")
    return cohort.partition_cohort(rows, "entity", F.col("entity") % 3 != 0, reasons, stale, defects, excluded)


def partition(spark, sf):
    return _cohort(spark, sf).select("entity", "cohort", "class", F.array_join("reasons", ",").alias("reasons"))


_PARTITION = """, i AS (""" + _IDENTITY + """),
p AS (SELECT i.*, d.lang, d.n_chars, CASE WHEN i.entity % 13 = 0 THEN 'missing_generation' WHEN i.entity % 11 = 0 THEN 'legacy_generation'
  ELSE concat_ws(',', CASE WHEN d.lang IS DISTINCT FROM 'en' THEN 'fingerprint_mismatch' END, CASE WHEN i.entity % 5 = 4 THEN 'version_mismatch' END) END AS gen
  FROM i JOIN documents d ON d.doc_id = i.entity WHERE i.entity % 3 <> 0 AND i.entity % 17 <> 0),
q AS (SELECT entity, cohort, identity, any_evaluable, CASE WHEN gen <> '' THEN 'not_current' WHEN n_chars < 500 THEN 'stale_evidence' WHEN n_chars > 20000 THEN 'invalid_observations' ELSE 'current' END AS class,
  CASE WHEN gen <> '' THEN gen WHEN n_chars < 500 THEN 'too_short' WHEN n_chars > 20000 THEN 'too_long' ELSE '' END AS reasons FROM p)"""


def baselines(spark, sf):
    rows = _cohort(spark, sf).where("class = 'current'").join(op.weighted_scores(_detections(spark, sf), "entity"), "entity", "left").fillna(0, ["score"])
    found = cohort.baseline(rows.withColumn("group", F.concat("cohort", F.lit("/"), F.substring("identity", 1, 1))), "group", "score", "identity", "any_evaluable")
    return found.withColumns({"score_sum": F.col("score_sum").cast("double"), "score_average": F.col("score_average").cast("double")})


_BASELINE = f""", {_SCORE}, g AS (SELECT cohort || '/' || substr(identity, 1, 1) AS "group", count(*) AS eligible_count, sum(coalesce(cents, 0)) AS cents, count(DISTINCT identity) AS ids, bool_or(any_evaluable) AS has_some
  FROM q LEFT JOIN s USING (entity) WHERE class = 'current' GROUP BY 1), h AS (SELECT *, CASE WHEN ids > 1 THEN 'mixed_opportunity_coverage' WHEN has_some THEN 'available' ELSE 'unavailable' END AS status FROM g)
SELECT "group", status, eligible_count, CASE WHEN status = 'available' THEN eligible_count ELSE 0 END AS scored_count, CASE WHEN status = 'available' THEN cents / 100.0 ELSE 0 END::DOUBLE AS score_sum,
  CASE WHEN status = 'available' THEN round_even((cents::DECIMAL(18, 0) * 10000000000 // (eligible_count * 100))::DECIMAL(38, 0) / 10000000000.0, 2) END::DOUBLE AS score_average FROM h"""


def lanes(spark, sf):
    """Which pairs of a customer and a month the orders lack, and which pairs of orders no customer stands for."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    left = customers.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 4).alias("m"))
    return op.lane_differences(left, orders.select(F.col("o_custkey").alias("k"), F.month("o_orderdate").cast("long").alias("m")), ["k", "m"])


QUERIES = {
    "opportunity_rates": rates,
    "evidence_bounds_tiers": bounds_tiers,
    "recurrence_tiers": recurrence,
    "insufficiency_reasons": insufficient,
    "joint_pairs": _joint(2),
    "joint_triples": _joint(3),
    "opportunity_identity": identities,
    "weighted_scores": scores,
    "cohort_partition": partition,
    "cohort_baseline": baselines,
    "lane_differences": lanes,
}
ORACLES = {
    "opportunity_rates": _RATES + " SELECT * FROM r",
    "evidence_bounds_tiers": _RATES + f" SELECT * EXCLUDE (polarity), {_POSITIVE}, {_STATUS} FROM b WHERE polarity = 'pattern'",
    "recurrence_tiers": _RATES + f""" SELECT * EXCLUDE (polarity), CASE WHEN a = 0 THEN 'unclassified' WHEN a >= 8 AND d >= 4 AND lower >= 0.5 THEN 'high_frequency'
  WHEN e >= 8 AND applicable_coverage >= 0.8 AND d >= 3 AND lower >= 0.25 AND upper < 0.5 THEN 'moderate_frequency' WHEN e >= 8 AND applicable_coverage >= 0.8 AND d >= 1 AND upper < 0.25 THEN 'occasional'
  WHEN absence_capable AND a >= 8 AND e = a AND d <= 0 THEN 'confirmed_none' ELSE 'unclassified' END AS tier, {_STATUS} FROM b WHERE polarity = 'antipattern'""",
    "insufficiency_reasons": _RATES + """ SELECT cohort, detector, CASE WHEN a = 0 THEN 'no_applicable_entities' ELSE concat_ws(',', CASE WHEN a < 8 THEN 'too_few_applicable' END, CASE WHEN e < 8 THEN 'too_few_evaluable' END, CASE WHEN applicable_coverage < 0.8 THEN 'coverage_too_low' END) END AS reasons FROM b""",
    "joint_pairs": _joint_sql(2),
    "joint_triples": _joint_sql(3),
    "opportunity_identity": _OUTCOMES + " " + _IDENTITY,
    "weighted_scores": _OUTCOMES + f", {_SCORE} SELECT entity, cents / 100.0::DOUBLE AS score, detections FROM s",
    "cohort_partition": _OUTCOMES + _PARTITION + " SELECT entity, cohort, class, reasons FROM q",
    "cohort_baseline": _OUTCOMES + _PARTITION + _BASELINE,
    "lane_differences": "WITH l AS (SELECT c_custkey AS k, c_nationkey % 4 AS m FROM customer), r AS (SELECT o_custkey AS k, extract(month FROM o_orderdate)::BIGINT AS m FROM orders) SELECT *, 'missing' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'unknown' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)",
}
