"""Queries over outline rules, gates, ledgers, queues and packed forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import nested, numbers as nu, times as tm
from tallyforge.operators import cohort, evidence as ev, guardrails as gr, opportunity as op, outline as ol, reconcile as rc
from tallyforge.plans import outcomes as oc
from tallyforge.sources import sinks
from tallyforge.sources.tables import table


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("talk"), F.col("turn").alias("n"), F.col("role").alias("chapter"), F.length("text").alias("k"))


_T = "t AS (SELECT conv_id AS talk, turn AS n, role AS chapter, length(text) AS k FROM conversations)"


def pacing_rules(spark, sf):
    """Conversations as talks: roles are chapters in order of their first turn, a text of a length divisible by five is the idea."""
    t = _turns(spark, sf)
    chapters = t.groupBy("talk", "chapter").agg(F.min("n").alias("first"), F.sum("k").alias("minutes")).withColumn("pos", F.row_number().over(W.partitionBy("talk").orderBy("first")))
    act = ol.act_one(chapters, t, F.col("k") % 5 == 0).select("talk", F.round("share", 9).alias("share"), F.col("verdict").alias("act_one"))
    length = ol.duration_accounting(chapters, t.groupBy("talk").agg((F.max("n") * 60).alias("minutes"))).select("talk", F.col("verdict").alias("length"))
    lack = ol.coverage(t.withColumn("register", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("k") % 4 + 1).cast("int"))), "register", list("ABCD")).select("talk", F.array_join("missing", "").alias("lacks"))
    rising = ol.ordered(t.select("talk", F.col("n").alias("pos"), F.when(F.col("k") % 9 == 0, 0).otherwise(F.col("n")).alias("n"))).select("talk", F.col("ok").alias("rising"))
    return act.join(length, "talk").join(lack, "talk").join(rising, "talk")


_PACING = f"""WITH {_T}, c AS (SELECT talk, chapter, min(n) AS first, sum(k) AS minutes FROM t GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY first) AS pos FROM c), i AS (SELECT talk, min_by(chapter, n) AS idea FROM t WHERE k % 5 = 0 GROUP BY 1),
a AS (SELECT p.talk, sum(CASE WHEN pos < coalesce((SELECT pos FROM p q JOIN i ON i.talk = q.talk AND q.chapter = i.idea WHERE q.talk = p.talk), 1) THEN minutes ELSE 0 END)::DOUBLE / sum(minutes) AS share, sum(minutes) AS total FROM p GROUP BY 1),
o AS (SELECT talk, n, CASE WHEN k % 9 = 0 THEN 0 ELSE n END AS m, lag(CASE WHEN k % 9 = 0 THEN 0 ELSE n END) OVER (PARTITION BY talk ORDER BY n) AS b FROM t), r AS (SELECT talk, bool_and(b IS NULL OR m > b) AS rising FROM o GROUP BY 1),
g AS (SELECT talk, max(n) * 60 AS planned, concat(CASE WHEN count(*) FILTER (k % 4 = 0) = 0 THEN 'A' ELSE '' END, CASE WHEN count(*) FILTER (k % 4 = 1) = 0 THEN 'B' ELSE '' END, CASE WHEN count(*) FILTER (k % 4 = 2) = 0 THEN 'C' ELSE '' END, CASE WHEN count(*) FILTER (k % 4 = 3) = 0 THEN 'D' ELSE '' END) AS lacks FROM t GROUP BY 1)
SELECT talk, round(share, 9) AS share, CASE WHEN share IS NULL THEN 'SKIP' WHEN share BETWEEN 0.15 AND 0.35 THEN 'PASS' ELSE 'WARN' END AS act_one, CASE WHEN abs(total - planned) > 0.2 * planned THEN 'WARN' ELSE 'PASS' END AS length, lacks, rising FROM a JOIN g USING (talk) JOIN r USING (talk)"""


def threads(spark, sf):
    t = _turns(spark, sf).select("talk", "n", F.when(F.col("k") % 3 != 0, "chapter").alias("x"), F.col("chapter").alias("story"), F.when(F.col("k") % 4 == 0, "recall").otherwise("introduce").alias("kind"))
    return ol.threading(t.withColumn("story", F.when(F.col("x").isNotNull(), F.col("story"))), "story", "kind").select("talk", "story", "introduced", "ok")


_THREADS = f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY talk, chapter ORDER BY n) AS i FROM t WHERE k % 3 <> 0) SELECT talk, chapter AS story, bool_and(i > 1 OR k % 4 <> 0) AS introduced, bool_and(i > 1 OR k % 4 <> 0) AS ok FROM r GROUP BY ALL"""


def deliveries(spark, sf):
    t = _turns(spark, sf).withColumn("text", F.concat("chapter", F.col("k").cast("string")))
    between = t.where("k % 3 = 0").select("talk", F.col("n").alias("after"), F.concat(F.lit("i"), "text").alias("text"))
    return sinks.listing(ol.events(t, between), "talk", ["place"], F.concat("kind", F.lit(" "), "text"))


_DELIVERIES = f"""WITH {_T}, e AS (SELECT talk, n, 0 AS r, 'slide ' || chapter || k AS x FROM t UNION ALL SELECT talk, n, 1, 'interlude i' || chapter || k FROM t WHERE k % 3 = 0) SELECT talk, string_agg(x, chr(10) ORDER BY n, r) AS text FROM e GROUP BY 1"""


def references(spark, sf):
    """Lines of orders that refer to lines, also in arrays, some of which are not there."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("talk"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("q"))
    one = ol.broken_references(lines.select("talk", (F.col("n") + F.col("q") % 3).alias("to")), "to", lines, "n").withColumn("kind", F.lit("single"))
    many = ol.broken_references(lines.select("talk", F.array(F.col("n"), F.col("n") - 1).alias("to")), "to", lines, "n").withColumn("kind", F.lit("listed"))
    return one.unionByName(many)


_REFERENCES = """WITH l AS (SELECT l_orderkey AS talk, l_linenumber::INT AS n, l_quantity::INT AS q FROM lineitem), r AS (SELECT talk, n + q % 3 AS "reference", 'single' AS kind FROM l UNION SELECT talk, n, 'listed' FROM l UNION SELECT talk, n - 1, 'listed' FROM l)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.talk = r.talk AND l.n = r."reference")"""


def operations(spark, sf):
    """Events of users as operations on a deck, in the order they came in."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("deck"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("line"), F.element_at(F.array(*map(F.lit, ("SLIDE", "TABLE", "CELL", "CHART", "SERIES", "TEXT", "ODD"))), (F.col("event_id") % 7 + 1).cast("int")).alias("op"))
    return gr.operation_errors(e).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("deck").alias("decks"))


_OPERATIONS = """WITH e AS (SELECT user_id AS deck, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, (['SLIDE','TABLE','CELL','CHART','SERIES','TEXT','ODD'])[event_id % 7 + 1] AS op FROM events), s AS (SELECT *, count(*) FILTER (op = 'SLIDE') OVER (PARTITION BY deck ORDER BY line) AS s FROM e),
c AS (SELECT *, count(*) FILTER (op = 'TABLE') OVER (PARTITION BY deck, s ORDER BY line) AS t, count(*) FILTER (op = 'CHART') OVER (PARTITION BY deck, s ORDER BY line) AS h FROM s), g AS (SELECT *, count(*) FILTER (op = 'SERIES') OVER (PARTITION BY deck, s, h) AS r FROM c),
x AS (SELECT deck, CASE WHEN op = 'ODD' THEN 'unknown_operation' WHEN s = 0 AND op <> 'SLIDE' THEN 'outside_slide' WHEN op = 'CELL' AND t = 0 THEN 'cell_without_table' WHEN op = 'SERIES' AND h = 0 THEN 'series_without_chart' WHEN op = 'CHART' AND r = 0 THEN 'chart_without_series' END AS error FROM g)
SELECT error, count(*) AS n, count(DISTINCT deck) AS decks FROM x WHERE error IS NOT NULL GROUP BY 1"""


def closings(spark, sf):
    """Made-up closing words, registers and comparisons of parts."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    said = F.concat(F.when(k % 2 == 0, "A recap. ").otherwise(""), F.when(k % 3 == 0, "Next step: go. ").otherwise(""), F.when(k % 5 == 0, "Thanks, see x.org/a. ").when(k % 5 == 1, "Thank you. ").otherwise(""))
    register = F.when(k % 4 == 0, "none at all").when(k % 4 == 1, "never on slide").otherwise("mild")
    return p.select(k, F.array_join(gr.closing_missing(said), ",").alias("closing"), gr.register_verdict(register, k % 3 % 2, k % 2).alias("register"), gr.prose_status(k % 7 % 2, k % 5 % 2).alias("prose"), F.array_join(gr.comparison_valid(said, k % 20, (k % 6).cast("double"), F.lit(3.0)), ",").alias("comparison"))


_CLOSINGS = """WITH p AS (SELECT p_partkey AS k, (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 < 2)::INT AS dots FROM part)
SELECT k AS p_partkey, concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'summary' END, CASE WHEN k % 3 <> 0 THEN 'CTA' END, CASE WHEN k % 5 <> 0 THEN 'social' END) AS closing,
 CASE WHEN k % 4 = 0 AND k % 3 % 2 + k % 2 > 0 THEN 'FAIL' WHEN k % 3 % 2 > 0 AND k % 4 = 1 THEN 'FAIL' WHEN k % 3 % 2 > 0 THEN 'WARN' ELSE 'PASS' END AS register, CASE WHEN k % 7 % 2 > 0 THEN 'FAIL' WHEN k % 5 % 2 > 0 THEN 'WARN' ELSE 'PASS' END AS prose,
 concat_ws(',', CASE WHEN k % 20 < 10 THEN 'too_few_compared' END, CASE WHEN k % 6 <> 3 THEN 'score_differs' END, CASE WHEN dots < 2 THEN 'sentence_count' END) AS comparison FROM p"""


def cut_lines(spark, sf):
    return gr.cut_lines(_turns(spark, sf).select("talk", (F.col("k") % 6 == 0).alias("cuttable")))


def gates(spark, sf):
    """Gates over the sources of parts: which are open, which source satisfies, and whether the record is new enough."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    there = F.array_compact(F.array(F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "c"), F.when(k % 7 == 0, ev.COMPARISON)))
    groups = F.when(k % 11 != 0, nested.or_groups(F.lit("a+b|c")))
    return p.select(k, ev.gate_open(groups, there).alias("open"), ev.source_satisfies(groups, F.when(k % 4 == 0, "a").otherwise("c"), there).alias("satisfied"), F.array_join(F.transform(ev.qualifying_groups(groups, there), lambda g: F.array_join(g, "+")), "|").alias("groups"), cohort.instrumented(F.when(k % 3 != 0, F.concat(F.lit("2024-0"), k % 9 + 1)), "2024-05").alias("instrumented"))


_GATES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 6 = 0 AND p_partkey % 7 = 0 AS ab, p_partkey % 5 = 0 AS c, p_partkey % 11 <> 0 AS gate FROM part)
SELECT k AS p_partkey, gate AND (ab OR c) AS open, gate AND CASE WHEN k % 4 = 0 THEN ab ELSE c END AS satisfied, CASE WHEN gate THEN concat_ws('|', CASE WHEN ab THEN 'a+b' END, CASE WHEN c THEN 'c' END) END AS "groups", k % 3 <> 0 AND k % 9 + 1 >= 5 AS instrumented FROM p"""


def ledgers(spark, sf):
    """Values that a ledger has rejected before, and pairs of titles that one approves."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select("p_brand", k, F.concat(F.lit("u"), k % 13).alias("v"))
    ledger = rows.where(k % 4 == 0).select("p_brand", k.alias("place"), F.concat(F.lit("r"), k % 3).alias("reason"), "v")
    back = rc.rejected_again(rows, ledger, "p_brand", F.col("v"), F.col("v")).select("p_partkey", F.col("reason").alias("found"))
    pairs = rows.select("p_partkey", F.col("p_brand").alias("a"), F.col("v").alias("b"))
    good = ev.title_ledger(pairs, ledger.where("place % 8 = 0").select(F.col("p_brand").alias("a"), F.col("v").alias("b")), ["a", "b"]).select("p_partkey", F.lit("approved").alias("found"))
    return back.unionByName(good)


_LEDGERS = """WITH r AS (SELECT p_brand, p_partkey AS k, 'u' || p_partkey % 13 AS v FROM part), l AS (SELECT p_brand, v, min_by('r' || k % 3, k) AS reason FROM r WHERE k % 4 = 0 GROUP BY ALL), g AS (SELECT DISTINCT p_brand, v FROM r WHERE k % 8 = 0)
SELECT k AS p_partkey, reason AS found FROM r JOIN l USING (p_brand, v) UNION ALL SELECT k, 'approved' FROM r JOIN g USING (p_brand, v)"""


def closed_claims(spark, sf):
    """Claims closed by their returns, batches that don't hold together, and rows brought to the present generation."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    queue = o.select(k, F.when(k % 3 == 0, "run1").otherwise("run2").alias("run_id"), F.when(k % 4 == 0, "claimed").otherwise("completed").alias("claim_state"), (k % 2).alias("schema_version"))
    done = rc.close_claims(queue, o.where(k % 5 == 0).select(k), "o_orderkey", "run1")
    now = rc.migrate(done, {"generation": F.lit(0)}, 2)
    return now.groupBy("run_id", "claim_state", "generation", "schema_version").agg(F.count(F.lit(1)).alias("n"))


_CLOSED = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'run1' ELSE 'run2' END AS run_id, CASE WHEN o_orderkey % 4 <> 0 OR (o_orderkey % 15 = 0) THEN 'completed' ELSE 'claimed' END AS claim_state, 0 AS generation, 2 AS schema_version, count(*) AS n FROM orders GROUP BY 1, 2"""


def consistency(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    members = F.collect_set("n_name").over(W.partitionBy("n_regionkey"))
    rows = n.select(F.lit("r").alias("run_id"), F.col("n_regionkey").alias("batch_id"), F.col("n_name").alias("key"), F.when((F.col("n_regionkey") == 1) & (k % 2 == 0), "later").otherwise("then").alias("claimed_at"), F.when(F.col("n_regionkey") == 2, F.array(F.lit("other"))).when((F.col("n_regionkey") == 3) & (k % 2 == 0), F.array(F.lit("x"))).otherwise(F.sort_array(members)).alias("exclusions"))
    return rc.claim_consistency(rows).select("batch_id", F.array_join("codes", ",").alias("codes"))


_CONSISTENCY = """WITH g AS (SELECT n_regionkey AS batch_id, count(DISTINCT n_nationkey % 2) AS p FROM nation GROUP BY 1) SELECT batch_id, CASE batch_id WHEN 1 THEN 'several_times' WHEN 2 THEN 'exclusions_differ' WHEN 3 THEN CASE WHEN p = 2 THEN 'several_snapshots' ELSE 'exclusions_differ' END END AS codes FROM g WHERE (batch_id IN (1, 3) AND p = 2) OR batch_id = 2 OR (batch_id = 3 AND p = 1 AND (SELECT min(n_nationkey % 2) FROM nation WHERE n_regionkey = 3) = 0)"""


def packed_forms(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    paths = F.map_from_arrays(F.array(k.cast("int") % 50 + 10, F.lit(2)), F.array(F.concat(F.lit("p"), k), F.lit("q")))
    return c.select(k, sinks.background_spec(paths).alias("spec"), nu.hamming(F.array(k, k * 3), F.array(k + 1, k)).cast("long").alias("bits"), nu.half_even(k / 8.0, 2).cast("double").alias("rounded"), nu.finite(F.when(k % 3 == 0, float("nan")).when(k % 3 == 1, k.cast("double"))).alias("finite"), tm.clock_seconds(F.concat(F.lpad((k % 3).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":07,25"))).alias("seconds"))


_PACKED = """SELECT c_custkey, '2=q;' || (c_custkey % 50 + 10) || '=p' || c_custkey AS spec, (bit_count(xor(c_custkey, c_custkey + 1)) + bit_count(xor(c_custkey * 3, c_custkey)))::BIGINT AS bits, round_even(c_custkey / 8.0::DECIMAL(18, 4), 2)::DOUBLE AS rounded, c_custkey % 3 = 1 AS finite, (c_custkey % 3 * 3600 + c_custkey % 60 * 60)::DOUBLE + 7.25 AS seconds FROM customer"""


def scaffolded(spark, sf):
    """Rates with a row for every detector and cohort, those without an outcome too."""
    some = oc.outcomes(spark, sf).where(~((F.col("detector") == "bang") & (F.length("cohort") % 2 == 0)))
    return op.opportunity_rates(some, spark.createDataFrame([(d.name, d.polarity, d.absence_capable) for d in oc.DETECTORS], "detector string, polarity string, absence_capable boolean")).select("cohort", "detector", "d", "e", "n", "rate")


_SCAFFOLD = oc._RATES + " SELECT cohort, detector, CASE WHEN detector = 'bang' AND length(cohort) % 2 = 0 THEN 0 ELSE d END AS d, CASE WHEN detector = 'bang' AND length(cohort) % 2 = 0 THEN 0 ELSE e END AS e, CASE WHEN detector = 'bang' AND length(cohort) % 2 = 0 THEN 0 ELSE n END AS n, CASE WHEN NOT (detector = 'bang' AND length(cohort) % 2 = 0) THEN rate END AS rate FROM r"


def selections(spark, sf):
    turns = _turns(spark, sf).select(F.col("n").cast("int").alias("n")).distinct()
    done = turns.where("n < 3")
    each = [(name, ol.selection(text, turns, done)) for name, text in (("all", "all"), ("remaining", "remaining"), ("listed", "1, 4-6,900"))]
    out = None
    for name, found in each:
        rows = found.select(F.lit(name).alias("selection"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "pacing_rules": pacing_rules, "story_threads": threads, "delivery_order": deliveries, "broken_references": references, "deck_operations": operations, "closing_rules": closings, "cut_lines": cut_lines, "evidence_gates": gates, "rejection_ledgers": ledgers,
    "closed_claims": closed_claims, "claim_consistency": consistency, "packed_forms": packed_forms, "scaffolded_rates": scaffolded, "slide_selections": selections,
}
ORACLES = {
    "pacing_rules": _PACING,
    "story_threads": _THREADS,
    "delivery_order": _DELIVERIES,
    "broken_references": _REFERENCES,
    "deck_operations": _OPERATIONS,
    "closing_rules": _CLOSINGS,
    "cut_lines": f"WITH {_T} SELECT talk, count(*) FILTER (k % 6 = 0) AS n, CASE WHEN count(*) FILTER (k % 6 = 0) < 1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM t GROUP BY 1",
    "evidence_gates": _GATES,
    "rejection_ledgers": _LEDGERS,
    "closed_claims": _CLOSED,
    "claim_consistency": _CONSISTENCY,
    "packed_forms": _PACKED,
    "scaffolded_rates": _SCAFFOLD,
    "slide_selections": "WITH t AS (SELECT DISTINCT turn::INT AS n FROM conversations) SELECT 'all' AS selection, n FROM t UNION ALL SELECT 'remaining', n FROM t WHERE n >= 3 UNION ALL SELECT 'listed', n FROM t WHERE n IN (1, 4, 5, 6, 900)",
}
