"""Preflights as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import preflight as pre
from tallyforge.sources.tables import table


def preflight_run(spark, sf):
    """Rules on texts, sources and lengths of all documents in one scan: every finding, and the counters of the rules."""
    text = F.col("text")
    rules = {
        "text": {"blank": ("error", F.btrim(text) == ""), "no_end": ("warning", ~F.rtrim(text).rlike(r"[.!?]$")), "shouts": ("note", text.rlike("[A-Z]{6,}")), "copied_line": ("note", text.contains("\n\n\n"))},
        "source": {"missing": ("error", F.col("source").isNull()), "foreign": ("note", F.col("lang") != "en")},
        "length": {"differs": ("error", F.col("n_chars") != F.length(text)), "long": ("warning", F.col("n_chars") > 20_000)},
    }
    found, report = pre.run(table(spark, sf, "documents"), "doc_id", rules)
    none = F.lit(None)
    rows = found.select("of", "rule", "severity", "doc_id", none.cast("long").alias("broken"), none.cast("long").alias("rows"), none.cast("boolean").alias("passed"))
    return rows.unionByName(report.withColumn("doc_id", none.cast("long")))


_RULES = [("text", "blank", "error", "trim(text) = ''"), ("text", "no_end", "warning", "NOT regexp_matches(rtrim(text), '[.!?]$')"), ("text", "shouts", "note", "regexp_matches(text, '[A-Z]{6,}')"), ("text", "copied_line", "note", "contains(text, chr(10) || chr(10) || chr(10))"),
          ("source", "missing", "error", "source IS NULL"), ("source", "foreign", "note", "lang <> 'en'"), ("length", "differs", "error", "n_chars <> length(text)"), ("length", "long", "warning", "n_chars > 20000")]
_PREFLIGHT = (
    "WITH f AS (" + " UNION ALL ".join(f"SELECT '{s}' AS of, '{r}' AS rule, '{v}' AS severity, doc_id FROM documents WHERE {c}" for s, r, v, c in _RULES) + "), k AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{r}', '{v}')" for s, r, v, _ in _RULES) + """) t(of, rule, severity)),
n AS (SELECT k.*, count(f.doc_id) AS broken FROM k LEFT JOIN f USING (of, rule, severity) GROUP BY ALL)
SELECT of, rule, severity, doc_id, NULL AS broken, NULL AS rows, NULL AS passed FROM f UNION ALL
SELECT of, rule, severity, NULL, broken, (SELECT count(*) FROM documents), NOT coalesce(bool_or(severity = 'error' AND broken > 0) OVER (PARTITION BY of), false) FROM n"""
)

QUERIES = {"preflight_run": preflight_run}
ORACLES = {"preflight_run": _PREFLIGHT}
