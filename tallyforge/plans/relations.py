"""Queries over orders, parts, events and other keyed tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text as tx, times as tm
from tallyforge.operators import bands, findings, matching, opportunity as op, sequences, state, trend
from tallyforge.operators.opportunity import Detector
from tallyforge.sources.tables import table

#: Detectors of orders; the third can be judged for some segments only, the fourth not for some orders.
ORDER_DETECTORS = [
    Detector("pricey", "pattern", "true", "true", "o_totalprice > 150000"),
    Detector("urgent", "pattern", "true", "true", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    Detector("late_half", "pattern", "true", "c_mktsegment <> 'BUILDING'", "month(o_orderdate) > 6"),
    Detector("first_clerk", "pattern", "c_mktsegment <> 'MACHINERY'", "o_custkey % 3 <> 0 OR o_orderkey % 9 <> 0", "o_orderkey % 2 = 0"),
]


def _halves(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return trend.last_halves(orders, "o_custkey", ["o_orderdate", "o_orderkey"])


def _half_outcomes(spark, sf):
    halves = _halves(spark, sf)
    states = op.derive_outcomes(halves.withColumn("_e", F.struct("o_custkey", "half", "o_orderkey")), ORDER_DETECTORS, "_e", "o_custkey")
    return states.select("entity.*", "detector", "outcome")


_HALVES = "h AS (SELECT * FROM (SELECT o.*, c.c_mktsegment, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders o JOIN customer c ON o_custkey = c_custkey) WHERE k >= 10 AND rn <= 10)"
_HALF_OUTCOMES = "x AS (" + " UNION ALL ".join(f"SELECT o_custkey, CASE WHEN rn <= 5 THEN 'recent' ELSE 'prior' END AS half, o_orderkey, '{d.name}' AS detector, CASE WHEN NOT ({d.applicable}) THEN 'not_applicable' WHEN NOT ({d.evaluable}) THEN 'not_evaluable' WHEN {d.detected} THEN 'detected' ELSE 'undetected' END AS outcome FROM h" for d in ORDER_DETECTORS) + ")"


def trend_halves(spark, sf):
    found = trend.score_trend(_halves(spark, sf), "o_custkey", "o_totalprice", threshold=20000)
    return found.select("o_custkey", F.col("prior_sum").cast("double").alias("prior_sum"), F.col("recent_sum").cast("double").alias("recent_sum"), "status")


def movement(spark, sf):
    return trend.movements(_half_outcomes(spark, sf), "o_custkey").select("o_custkey", "detector", "prior_d", "recent_d", "movement")


def availability(spark, sf):
    return trend.trend_availability(op.identity(_half_outcomes(spark, sf), ["o_custkey", "o_orderkey"]), "o_custkey")


_SIZES = [(1, "0.50"), (10, "1.00"), (25, "1.20"), (40, "1.50")]
_BANDS_SQL = "(VALUES " + ", ".join(f"({k}, {v}, {i})" for i, (k, v) in enumerate(_SIZES)) + ") b(band, budget, place)"


def _paced(spark, sf):
    rows = bands.as_of(table(spark, sf, "lineitem").where("l_quantity > 0"), F.col("l_quantity"), _SIZES)
    spent = F.col("l_extendedprice") / (F.col("l_quantity") * 1000)
    return rows.withColumns({"band_size": F.col("band.band"), "ratio": spent / F.col("band.value").cast("double")})


def pacing(spark, sf):
    return trend.pacing(_paced(spark, sf), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "ratio")


_PACED = f"p AS (SELECT *, (l_extendedprice / (l_quantity * 1000)) / (SELECT CASE WHEN count(*) FILTER (band <= l_quantity) > 0 THEN max_by(budget, band) FILTER (band <= l_quantity) ELSE min_by(budget, band) END FROM {_BANDS_SQL})::DOUBLE AS ratio, (SELECT CASE WHEN count(*) FILTER (band <= l_quantity) > 0 THEN max(band) FILTER (band <= l_quantity) ELSE min(band) END FROM {_BANDS_SQL})::DOUBLE AS band_size FROM lineitem WHERE l_quantity > 0)"


def pacing_worst(spark, sf):
    return _paced(spark, sf).orderBy(F.col("ratio").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(10).select("l_orderkey", "l_linenumber", "l_partkey", "band_size", "ratio")


def nearest_budget(spark, sf):
    rows = bands.nearest(table(spark, sf, "part"), F.col("p_size"), [(5, 8), (15, 14), (30, 31), (45, 40)])
    return rows.select("p_partkey", "p_size", F.col("band.value").alias("budget"), bands.budget_verdict(F.col("p_size"), F.col("band.value")).alias("verdict"))


def shortlist(spark, sf):
    tiers = {"p_brand": ["Brand#11", "Brand#12", "Brand#13"], "p_container": ["SM BOX", "MED BOX", "LG BOX"]}
    tiers = {c: t for c, t in tiers.items() if c in table(spark, sf, "part").columns}
    return matching.shortlist(table(spark, sf, "part"), "p_partkey", F.col("p_size") <= 25, tiers, "p_partkey", 50)


def shortlist_sql():
    place = "CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#13' THEN 2 ELSE 3 END"
    return f"SELECT * FROM (SELECT p_partkey, ({place})::BIGINT AS cost, row_number() OVER (ORDER BY {place}, p_partkey) AS rank FROM part WHERE p_size <= 25) WHERE rank <= 50"


def status_rollup(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"))
    return findings.rollup(events, ["event_type", "severity"])


def keep_apart(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return sequences.keep_apart(events, "user_id", ["ts", "event_id"], "value", 8.0).select("user_id", "event_id", "value")


_KEEP = """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT user_id, event_id, value, i, value AS held, true AS kept FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN abs(e.value - k.held) > 8 THEN e.value ELSE k.held END, abs(e.value - k.held) > 8 FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
SELECT user_id, event_id, value FROM k WHERE kept"""


def changed(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return sequences.changed(lines, "doc_id", "n", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_lines"))


def coverage(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("s"), (F.col("l_linenumber") + F.col("l_quantity") % 2).cast("long").alias("e"))
    return sequences.complete(lines, "l_orderkey", "s", "e", F.lit(1), F.lit(4)).select("l_orderkey", "islands", "first", "last", "complete")


_ISLANDS = """l AS (SELECT l_orderkey, l_linenumber::BIGINT AS s, max(l_linenumber + l_quantity % 2)::BIGINT AS e FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM l),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM m),
g AS (SELECT l_orderkey, i, min(s) AS s, max(e) AS e FROM n GROUP BY ALL)"""


def containment(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("s"), (F.col("l_linenumber") + F.col("l_quantity") % 2).cast("long").alias("e"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).cast("long").alias("s"), F.lit(3).cast("long").alias("e"))
    return sequences.contained(asked, lines, "l_orderkey", "s", "e").select("l_orderkey", "inside")


def timings(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("seconds", F.bround(F.length("text") / 15, 0).cast("long"))
    found = sequences.offsets(turns, "conv_id", "turn", F.col("seconds"), gap=0, name="start")
    return found.select("conv_id", "turn", tm.m_ss(F.col("start")).alias("at"))


def contiguous(spark, sf):
    return sequences.contiguity(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def duplicates(spark, sf):
    docs = table(spark, sf, "documents")
    return findings.duplicates(docs, F.md5("text"), "doc_id", F.col("doc_id") % 4 == 0)


def references(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    customers, users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, sf, "events").select("user_id")
    both = findings.orphans(docs, labels, "doc_id", "unlabelled").unionByName(findings.orphans(labels, docs, "doc_id", "label_without_document"))
    return both.unionByName(findings.orphans(customers, users, "user_id", "customer_without_events")).unionByName(findings.orphans(users, customers, "user_id", "events_without_customer"))


def edges(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "user_id").where("dst is not null")
    pairs = steps.select("src", "dst").union(table(spark, sf, "nation").select(F.col("n_name").alias("src"), F.lit("click").alias("dst")))
    nodes = table(spark, sf, "events").where("event_type <> 'error'").select(F.col("event_type").alias("node")).distinct()
    return findings.edge_findings(pairs, nodes)


_EDGES = """WITH s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events),
e AS (SELECT DISTINCT src, dst FROM s WHERE dst IS NOT NULL UNION SELECT n_name, 'click' FROM nation),
n AS (SELECT DISTINCT event_type AS node FROM events WHERE event_type <> 'error')
SELECT src, dst, 'self_reference' AS code FROM e WHERE src = dst UNION ALL SELECT src, dst, 'dangling' FROM e WHERE dst NOT IN (SELECT node FROM n)
UNION ALL SELECT src, dst, 'non_reciprocal' FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)"""


def _aliases(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry"), F.explode(F.array(tx.alias(F.col("s_name")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))).alias("alias"))


def collisions(spark, sf):
    return findings.alias_collisions(_aliases(spark, sf)).select("a", "b", F.array_join("aliases", ",").alias("aliases"))


def claims(spark, sf):
    return findings.alias_claims(_aliases(spark, sf))


def difference(spark, sf):
    nation = table(spark, sf, "nation")
    other = nation.where("n_nationkey % 5 <> 0").select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 0, "X").otherwise(F.col("n_name")).alias("n_name"), (F.col("n_regionkey") + (F.col("n_nationkey") % 3 == 0).cast("int")).alias("n_regionkey"))
    return findings.index_difference(nation.where("n_nationkey % 6 <> 0"), other, "n_nationkey", ["n_name", "n_regionkey"])


_DIFFERENCE = """WITH a AS (SELECT * FROM nation WHERE n_nationkey % 6 <> 0), b AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'X' ELSE n_name END AS n_name, n_regionkey + (n_nationkey % 3 = 0)::INT AS n_regionkey FROM nation WHERE n_nationkey % 5 <> 0),
j AS (SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, CASE WHEN b.n_nationkey IS NULL THEN 'missing' WHEN a.n_nationkey IS NULL THEN 'orphan' WHEN a.n_name IS DISTINCT FROM b.n_name OR a.n_regionkey IS DISTINCT FROM b.n_regionkey THEN 'drift' END AS code,
 concat_ws(',', CASE WHEN a.n_name IS DISTINCT FROM b.n_name THEN 'n_name' END, CASE WHEN a.n_regionkey IS DISTINCT FROM b.n_regionkey THEN 'n_regionkey' END) AS f FROM a FULL JOIN b ON a.n_nationkey = b.n_nationkey)
SELECT n_nationkey, code, CASE WHEN code = 'drift' THEN f END AS fields FROM j WHERE code IS NOT NULL"""


def _queue(spark, sf):
    events = table(spark, sf, "events")
    first = events.groupBy(F.col("user_id").alias("key")).agg(F.min("ts").cast("timestamp").alias("first"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    live = F.col("key") % 4 == 0
    return first.select("key", F.when(live, "in-progress").when(F.col("key") % 3 == 0, "done").otherwise("pending").alias("status"), (F.col("bought") > 3).alias("claimable"), F.when(live, "old").alias("run_id"), F.when(live, "b0").alias("batch_id"), F.when(live, F.col("first")).alias("claimed_at"), F.when(live, "claimed").alias("claim_state"))


_QUEUE = "q AS (SELECT user_id AS key, min(ts) AS first, count(*) FILTER (event_type = 'purchase') > 3 AS claimable, CASE WHEN user_id % 4 = 0 THEN 'in-progress' WHEN user_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM events GROUP BY user_id)"


def lease_claim(spark, sf):
    found = state.claim(_queue(spark, sf), "key", "run1", "b1", F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return found.select("key", "status", "run_id", "batch_id", "taken")


def lease_recover(spark, sf):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return state.recover(_queue(spark, sf).withColumn("status", F.when(F.col("key") % 8 == 0, "done").otherwise(F.col("status"))), now, 3600).select("key", "age", "recovery")


def run_batches(spark, sf):
    q = _queue(spark, sf)
    return state.reconstruct_run(q, "key", "old").select("batch_id", "key", "keys")


def upserted(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").where("c_custkey % 10 <> 1")
    new = table(spark, sf, "customer").where("c_custkey % 5 = 1").select("c_custkey", F.concat(F.lit("new "), F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return state.upsert(customers, new, "c_custkey")


_UPSERT = """WITH t AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1), s AS (SELECT c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 5 = 1)
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment, CASE WHEN s.c_custkey IS NULL THEN 'kept' WHEN t.c_custkey IS NULL THEN 'added' ELSE 'updated' END AS action FROM t FULL JOIN s ON t.c_custkey = s.c_custkey"""


def patched(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    patches = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("O").alias("expect"), F.lit("X").alias("set"))
    return state.patch(orders, patches, "o_orderkey", "o_orderstatus")


def latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return state.latest(events, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


def merged(spark, sf):
    events = table(spark, sf, "events")
    old = events.where("event_id % 2 = 0").select((F.col("event_id") / 2).cast("long").alias("k"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("old"), F.lit("1")).alias("a"))
    new = events.where("event_id % 2 = 1").select(((F.col("event_id") - 1) / 2).cast("long").alias("k"), F.create_map(F.lit("kind"), F.when(F.col("value") > 50, F.col("event_type")).otherwise(""), F.lit("new"), F.lit("0")).alias("b"))
    both = old.join(new, "k", "full_outer").withColumn("m", state.merge_maps(F.col("a"), F.col("b")))
    return both.select("k", F.col("m.kind").alias("kind"), F.col("m.old").alias("old"), F.col("m.new").alias("new"))


_MERGED = """WITH a AS (SELECT event_id // 2 AS k, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT (event_id - 1) // 2 AS k, CASE WHEN value > 50 THEN event_type ELSE '' END AS kind FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.kind IS NULL OR b.kind = '' THEN a.event_type ELSE b.kind END AS kind, CASE WHEN a.k IS NOT NULL THEN '1' END AS old, CASE WHEN b.k IS NOT NULL THEN '0' END AS new FROM a FULL JOIN b ON a.k = b.k"""


def feedback(spark, sf):
    """Occurrences, distinct talkers and lanes of each catalogued id, in order of weight."""
    events = table(spark, sf, "events").select("event_type", "user_id", "event_id", (F.col("event_id") % 3).alias("lane"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("user_id").alias("talks"), F.countDistinct(F.struct("user_id", "lane")).alias("sources"), *(F.count_if(F.col("lane") == i).alias(f"lane{i}") for i in range(3)))


def suggestions(spark, sf):
    """Groups of normal forms with their variants, and whether the polarities given for them agree."""
    rows = table(spark, sf, "part").select(tx.slug(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("id"), F.col("p_brand").alias("variant"), F.when(F.col("p_size") > 40, "pattern").when(F.col("p_size") < 6, "antipattern").alias("polarity"))
    variants = rows.groupBy("id", "variant").agg(F.count(F.lit(1)).alias("n"), F.collect_set("polarity").alias("p"), F.count_if(F.col("polarity").isNull()).alias("open"))
    agg = variants.groupBy("id").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("variants"), F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"), F.sum("open").alias("open"))
    status = F.when(F.size("p") > 1, "conflict").when((F.size("p") == 1) & (F.col("open") > 0), "partial").when(F.size("p") == 1, "consistent").otherwise("none")
    return agg.select("id", "occurrences", "variants", status.alias("status"))


QUERIES = {
    "trend_last10_halves": trend_halves, "movement_intervals": movement, "trend_availability": availability, "pacing_adherence": pacing, "pacing_worst_n": pacing_worst, "nearest_band_budget": nearest_budget,
    "shortlist_rank": shortlist, "status_rollup": status_rollup, "keep_last_fold": keep_apart, "consecutive_lines": changed, "range_coverage": coverage, "island_containment": containment, "cumulative_timings": timings,
    "contiguity_check": contiguous, "duplicate_waivers": duplicates, "fk_findings": references, "edge_reciprocity": edges, "alias_collisions": collisions, "alias_claims": claims, "index_difference": difference, "lease_claim": lease_claim,
    "lease_recover": lease_recover, "run_batches": run_batches, "upsert_merge": upserted, "expectation_patch": patched, "latest_generation": latest, "deep_merge_maps": merged, "feedback_groups": feedback, "suggestion_groups": suggestions,
}
ORACLES = {
    "trend_last10_halves": f"WITH {_HALVES}, g AS (SELECT o_custkey, sum(CASE WHEN rn > 5 THEN o_totalprice::DECIMAL(28,4) END) AS p, sum(CASE WHEN rn <= 5 THEN o_totalprice::DECIMAL(28,4) END) AS r FROM h GROUP BY 1) SELECT o_custkey, p::DOUBLE AS prior_sum, r::DOUBLE AS recent_sum, CASE WHEN r - p >= 100000 THEN 'improving' WHEN r - p <= -100000 THEN 'declining' ELSE 'stable' END AS status FROM g",
    "movement_intervals": f"WITH {_HALVES}, {_HALF_OUTCOMES}, c AS (SELECT o_custkey, detector, " + ", ".join(f"count(*) FILTER (half = '{h}' AND outcome IN ({s})) AS {h}_{c}" for h in ("prior", "recent") for c, s in (("d", "'detected'"), ("e", "'detected','undetected'"), ("u", "'not_evaluable'"))) + """ FROM x GROUP BY ALL)
SELECT o_custkey, detector, prior_d, recent_d, CASE WHEN prior_e + prior_u <> 5 OR recent_e + recent_u <> 5 THEN 'unavailable' WHEN recent_d - (prior_d + prior_u) >= 1 THEN 'increasing' WHEN recent_d + recent_u - prior_d <= -1 THEN 'decreasing' WHEN recent_d + recent_u - prior_d < 1 AND recent_d - (prior_d + prior_u) > -1 THEN 'stable' ELSE 'indeterminate' END AS movement FROM c""",
    "trend_availability": f"WITH {_HALVES}, {_HALF_OUTCOMES}, i AS (SELECT o_custkey, o_orderkey, string_agg(detector || CASE WHEN outcome IN ('detected','undetected') THEN 'e' ELSE outcome END, ',' ORDER BY detector) AS ident, bool_or(outcome IN ('detected','undetected')) AS has_some FROM x GROUP BY ALL) SELECT o_custkey, CASE WHEN count(DISTINCT ident) > 1 THEN 'incomparable_opportunity_identities' WHEN NOT bool_or(has_some) THEN 'no_evaluable_outcomes' ELSE 'available' END AS availability FROM i GROUP BY 1",
    "pacing_adherence": f"WITH {_PACED}, w AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS k FROM p), g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (ratio > 1) AS over, avg(ratio) FILTER (i <= k // 2) AS a, avg(ratio) FILTER (i > k // 2) AS b FROM w GROUP BY 1) SELECT l_suppkey, n, over, over::DOUBLE / n AS over_rate, CASE WHEN n < 4 THEN 'insufficient' WHEN b - a > 0.1 THEN 'worsening' WHEN a - b > 0.1 THEN 'improving' ELSE 'stable' END AS trend FROM g",
    "pacing_worst_n": f"WITH {_PACED} SELECT l_orderkey, l_linenumber, l_partkey, band_size, ratio FROM p ORDER BY ratio DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10",
    "nearest_band_budget": "SELECT p_partkey, p_size, budget, CASE WHEN p_size > budget THEN 'FAIL' WHEN p_size >= budget * 0.95 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT p_partkey, p_size, (SELECT arg_min(budget, abs(p_size - band) * 100 + place) FROM (VALUES (5, 8, 0), (15, 14, 1), (30, 31, 2), (45, 40, 3)) b(band, budget, place)) AS budget FROM part)",
    "shortlist_rank": shortlist_sql(),
    "status_rollup": "SELECT event_type, severity, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity FROM events) GROUP BY GROUPING SETS ((event_type), (severity))",
    "keep_last_fold": _KEEP,
    "consecutive_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM l) SELECT doc_id, count(*) AS kept_lines FROM m WHERE b IS NULL OR line <> b GROUP BY 1",
    "range_coverage": f"WITH {_ISLANDS} SELECT l_orderkey, count(*) AS islands, min(s) AS first, max(e) AS last, count(*) = 1 AND min(s) <= 1 AND max(e) >= 4 AS complete FROM g GROUP BY 1",
    "island_containment": f"WITH {_ISLANDS} SELECT o_orderkey AS l_orderkey, EXISTS (SELECT 1 FROM g WHERE g.l_orderkey = o_orderkey AND s <= 2 AND e >= 3) AS inside FROM orders",
    "cumulative_timings": "WITH t AS (SELECT conv_id, turn, coalesce(sum(round_even(length(text) / 15.0, 0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations) SELECT conv_id, turn, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS at FROM t",
    "contiguity_check": "SELECT l_orderkey, count(*) AS n, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1",
    "duplicate_waivers": "SELECT md5(text) AS value, count(*) AS members, count(*) FILTER (doc_id % 4 <> 0) AS unwaived, min(doc_id) AS first, count(*) FILTER (doc_id % 4 <> 0) > 1 AS finding FROM documents GROUP BY 1 HAVING count(*) > 1",
    "fk_findings": "SELECT DISTINCT 'unlabelled' AS code, doc_id::VARCHAR AS subject FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT 'label_without_document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION SELECT 'customer_without_events', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION SELECT 'events_without_customer', user_id::VARCHAR FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)",
    "edge_reciprocity": _EDGES,
    "alias_collisions": "WITH n AS (SELECT DISTINCT s_suppkey AS entry, unnest([array_to_string(regexp_extract_all(lower(s_name), '[a-z0-9]+'), '-'), 'n' || s_nationkey]) AS alias FROM supplier) SELECT a.entry AS a, b.entry AS b, string_agg(a.alias, ',' ORDER BY a.alias) AS aliases FROM n a JOIN n b ON a.alias = b.alias AND a.entry < b.entry GROUP BY 1, 2",
    "alias_claims": "WITH n AS (SELECT DISTINCT s_suppkey AS entry, unnest([array_to_string(regexp_extract_all(lower(s_name), '[a-z0-9]+'), '-'), 'n' || s_nationkey]) AS alias FROM supplier) SELECT a.alias, a.entry, min(b.entry) AS other, count(*) + 1 AS claims FROM n a JOIN n b ON a.alias = b.alias AND a.entry <> b.entry GROUP BY 1, 2",
    "index_difference": _DIFFERENCE,
    "lease_claim": f"WITH {_QUEUE}, f AS (SELECT key FROM q WHERE status = 'pending' AND claimable ORDER BY key LIMIT 5) SELECT q.key, CASE WHEN f.key IS NOT NULL THEN 'in-progress' ELSE status END AS status, CASE WHEN f.key IS NOT NULL THEN 'run1' WHEN q.key % 4 = 0 THEN 'old' END AS run_id, CASE WHEN f.key IS NOT NULL THEN 'b1' WHEN q.key % 4 = 0 THEN 'b0' END AS batch_id, f.key IS NOT NULL AS taken FROM q LEFT JOIN f ON f.key = q.key",
    "lease_recover": f"WITH {_QUEUE}, r AS (SELECT key, CASE WHEN key % 8 = 0 THEN 'done' ELSE status END AS status, CASE WHEN key % 4 = 0 THEN floor(epoch(TIMESTAMP '2024-01-01 12:00:00'))::BIGINT - floor(epoch(first))::BIGINT END AS age FROM q) SELECT key, age, CASE WHEN key % 4 <> 0 THEN 'none' WHEN status <> 'in-progress' THEN 'drifted' WHEN age < 0 THEN 'clock_error' WHEN age >= 3600 THEN 'expired' ELSE 'live' END AS recovery FROM r",
    "run_batches": f"WITH {_QUEUE} SELECT 'b0' AS batch_id, key, count(*) OVER () AS keys FROM q WHERE key % 4 = 0",
    "upsert_merge": _UPSERT,
    "expectation_patch": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus IS NOT DISTINCT FROM 'O' END AS applied FROM orders",
    "latest_generation": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "deep_merge_maps": _MERGED,
    "feedback_groups": "SELECT event_type, count(*) AS occurrences, count(DISTINCT user_id) AS talks, count(DISTINCT (user_id, event_id % 3)) AS sources, count(*) FILTER (event_id % 3 = 0) AS lane0, count(*) FILTER (event_id % 3 = 1) AS lane1, count(*) FILTER (event_id % 3 = 2) AS lane2 FROM events GROUP BY 1",
    "suggestion_groups": "WITH r AS (SELECT trim(regexp_replace(regexp_replace(lower(regexp_extract(p_name, '^(\\S+)', 1)), '[^\\w]+', '-', 'g'), '_+', '-', 'g'), '-') AS id, p_brand, CASE WHEN p_size > 40 THEN 'pattern' WHEN p_size < 6 THEN 'antipattern' END AS pol FROM part) SELECT id, count(*) AS occurrences, count(DISTINCT p_brand) AS variants, CASE WHEN count(DISTINCT pol) > 1 THEN 'conflict' WHEN count(DISTINCT pol) = 1 AND count(*) > count(pol) THEN 'partial' WHEN count(DISTINCT pol) = 1 THEN 'consistent' ELSE 'none' END AS status FROM r GROUP BY 1",
}
