"""Queries that reconcile rows and apply rules, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyforge.operators import guardrails as gr, reconcile as rc
from tallyforge.sources.tables import table


def differences(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    other = c.where("c_custkey % 9 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return rc.field_differences(c, other, "c_custkey", ["c_mktsegment", "c_nationkey"])


def proposed(spark, sf):
    c = table(spark, sf, "customer")
    stored = c.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    new = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "NEW").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rc.proposals(stored, new, "c_custkey", ["c_name", "c_mktsegment"])


def relations(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") - F.col("c_custkey") % 11).alias("to"), (F.col("c_custkey") % 3).alias("v"))
    return rc.relation_findings(rows, "c_custkey", "to", "v")


def overlaps(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").cast("double").alias("start"), (F.col("l_orderkey") + F.col("l_quantity")).cast("double").alias("end"))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 20).cast("double").alias("low"), (F.col("s_suppkey") * 20 + 900).cast("double").alias("high"))
    return rc.overlapping(lines, asked, "k", 200.0).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


def plan(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    one = orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit(1).alias("step"), F.lit("O").alias("expect"), F.lit("P").alias("set"))
    two = orders.where("o_orderkey % 12 = 0").select("o_orderkey", F.lit(2).alias("step"), F.lit("P").alias("expect"), F.lit("F").alias("set"))
    candidate, errors = rc.mutation_plan(orders, one.union(two), "o_orderkey", "o_orderstatus")
    return candidate.join(errors, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce(F.array_join("steps", ","), F.lit("")).alias("failed"))


_PLAN = """WITH s AS (SELECT o_orderkey, o_orderstatus AS s0, CASE WHEN o_orderkey % 6 = 0 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS s1 FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 AND s1 = 'P' THEN 'F' ELSE s1 END AS o_orderstatus, concat_ws(',', CASE WHEN o_orderkey % 6 = 0 AND s0 <> 'O' THEN '1' END, CASE WHEN o_orderkey % 12 = 0 AND s1 <> 'P' THEN '2' END) AS failed FROM s"""


def requeued(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "Done").otherwise("pending").alias("status"), F.lit(0).alias("generation"), F.lit(None).cast("string").alias("reason"))
    current = rows.where("o_orderkey % 3 = 0").select("o_orderkey")
    return rc.requeue(rc.legacy_statuses(rows, {"Done": "processed"}), current, "o_orderkey")


def prose(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", gr.unsourced_claim(F.col("text")).alias("unsourced"), F.array_join(gr.words_found(F.col("text"), ["license", "the", "und"]), ",").alias("words"), gr.sentences(F.col("text")).alias("sentences"), F.array_join(gr.branding(F.col("text"), ["License", "version"]), ",").alias("lacks"))


def bordered(pattern: str) -> str:
    """A pattern for an engine whose word border knows ASCII alone: letters, digits and underscores of any script instead."""
    pattern = re.sub(r"(^|[|(:])\\b", r"\1(?:^|[^\\p{L}\\p{N}_])", pattern)
    return "(?i)" + re.sub(r"\\b", r"(?:[^\\p{L}\\p{N}_]|$)", pattern)


_WORD = lambda w: f"CASE WHEN regexp_matches(text, '{bordered(chr(92) + 'b' + w + chr(92) + 'b')}') THEN '{w}' END"
_PROSE = rf"""SELECT doc_id, regexp_matches(text, '{bordered(gr.CLAIM)}') AND NOT regexp_matches(text, '{bordered(gr.SOURCE_MARKS)}') AS unsourced,
 concat_ws(',', {", ".join(map(_WORD, ("license", "the", "und")))}) AS words,
 len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS sentences, concat_ws(',', CASE WHEN NOT contains(lower(text), 'license') THEN 'License' END, CASE WHEN NOT contains(lower(text), 'version') THEN 'version' END) AS lacks FROM documents"""


def names(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat(F.when(F.col("p_partkey") % 9 == 0, "~$").otherwise(""), F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_partkey") % 4 == 0, " (2)").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, " old").otherwise(""), F.lit(".pptx"))
    return p.select("p_partkey", gr.skip_reason(name, ["small"]).alias("skip"), gr.artifact_role(name).alias("role"))


_NAMES = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'lock' WHEN contains(lower(p_name), 'static') THEN 'static' WHEN p_partkey % 4 = 0 AND p_partkey % 5 <> 0 THEN 'conflict_copy' WHEN contains(lower(p_name), 'small') THEN 'pattern' END AS skip,
 CASE WHEN p_partkey % 5 = 0 OR list_has_any(w, ['backup', 'backups', 'bak', 'archive', 'archived', 'old']) THEN 'backup' WHEN list_has_any(w, ['master', 'masters', 'template', 'templates', 'source']) THEN 'master' WHEN list_has_any(w, ['static', 'export', 'exports', 'exported']) THEN 'static_export' ELSE 'delivery' END AS role FROM (SELECT *, string_split(lower(p_name), ' ') AS w FROM part)"""

QUERIES = {"field_differences": differences, "proposal_fields": proposed, "relation_findings": relations, "span_overlaps": overlaps, "mutation_plan": plan, "requeue_stale": requeued, "prose_rules": prose, "deck_names": names}
ORACLES = {
    "field_differences": "SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS stored, NULL AS fetched FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, 'x' FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 = 0",
    "proposal_fields": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE 'existing' END AS entry, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 2 <> 0 THEN 'add' ELSE 'unchanged' END AS c_name,
 CASE WHEN c_custkey % 3 = 2 THEN 'absent' WHEN c_custkey % 7 = 0 THEN 'add' WHEN c_custkey % 3 = 1 THEN 'unchanged' ELSE 'review' END AS c_mktsegment FROM customer""",
    "relation_findings": """WITH r AS (SELECT c_custkey, c_custkey - c_custkey % 11 AS t FROM customer WHERE c_custkey % 2 = 0), x AS (SELECT r.*, CASE WHEN t = r.c_custkey THEN 'self' WHEN c.c_custkey IS NULL THEN 'unknown_target' WHEN t % 3 <> r.c_custkey % 3 THEN 'other_identity' END AS code FROM r LEFT JOIN customer c ON c.c_custkey = t)
SELECT c_custkey, t AS "to", code FROM x WHERE code IS NOT NULL""",
    "span_overlaps": "SELECT s_suppkey AS id, count(*) AS n, min(l_orderkey)::DOUBLE AS first, max(l_orderkey + l_quantity)::DOUBLE AS last FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey + l_quantity > s_suppkey * 20 AND l_orderkey < s_suppkey * 20 + 900 GROUP BY 1",
    "mutation_plan": _PLAN,
    "requeue_stale": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'processed' ELSE 'needs-reprocessing' END AS status, (o_orderstatus = 'O' AND o_orderkey % 3 <> 0)::INT AS generation, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN 'stale_generation' END AS reason FROM orders",
    "prose_rules": _PROSE,
    "deck_names": _NAMES,
}
