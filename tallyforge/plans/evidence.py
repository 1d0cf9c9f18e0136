"""Queries over evidence, outlines and nested values on the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import nested
from tallyforge.operators import evidence as ev, matching, outline as ol, trend
from tallyforge.sources import sinks
from tallyforge.sources.tables import table


def derived(spark, sf):
    """Outcomes of documents: sources by language, gates over them, detections by length."""
    docs = table(spark, sf, "documents")
    available = F.array_compact(F.array(F.lit("text"), F.when(F.col("lang") == "en", "audio"), F.when(F.col("doc_id") % 2 == 0, "slides"), F.when(F.col("doc_id") % 3 == 0, ev.COMPARISON)))
    entities = docs.select(F.col("doc_id").alias("entity"), available.alias("available"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("assessed"))).otherwise(F.array().cast("array<string>")).alias("not_applicable"))
    catalog = spark.createDataFrame([("plain", None, [["text"]], "x"), ("spoken", [["audio"]], [["text"]], "x"), ("both", None, [["audio", "slides"]], "x"), ("assessed", None, [["text"]], "x"), ("open", None, None, None), ("positive", None, None, "x")], "entry string, applicability_gate array<array<string>>, absence_gate array<array<string>>, evaluable_from string")
    hits = docs.where("n_chars > 2000").select(F.col("doc_id").alias("entity"), F.explode(F.array(F.lit("plain"), F.lit("both"))).alias("entry"))
    return ev.derive(entities, catalog, hits)


_DERIVED = """WITH d AS (SELECT doc_id AS entity, lang, n_chars, doc_id % 2 = 0 AS slides, doc_id % 3 = 0 AS compared FROM documents), c AS (SELECT unnest(['plain', 'spoken', 'both', 'assessed', 'open', 'positive']) AS entry),
x AS (SELECT *, entry IN ('plain', 'both') AND n_chars > 2000 AS hit, entry = 'spoken' AND lang <> 'en' AS closed, entry = 'assessed' AND entity % 7 = 0 AS away, entry IN ('open', 'positive') AS nogate, entry = 'both' AND NOT (lang = 'en' AND slides AND compared) AS shut FROM d, c)
SELECT entity, entry, CASE WHEN hit THEN 'detected' WHEN closed THEN 'not_evaluable' WHEN away THEN 'not_applicable' WHEN nogate OR shut THEN 'not_evaluable' ELSE 'undetected' END AS outcome,
 CASE WHEN hit THEN NULL WHEN closed THEN 'applicability_incomplete' WHEN away THEN 'assessed' WHEN entry = 'open' THEN 'pending' WHEN nogate THEN 'positive_only' WHEN shut THEN 'inspection_incomplete' END AS reason FROM x"""


def fresh(spark, sf):
    stored = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "lang")
    observed = stored.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("digest")).alias("digest"), F.when(F.col("doc_id") % 4 != 0, F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))).alias("lang"))
    return ev.freshness(stored, observed, "doc_id", ["digest", "lang"]).select("doc_id", "state", F.array_join("reasons", ",").alias("reasons"))


_FRESH = """WITH r AS (SELECT doc_id, doc_id % 5 = 0 AS missing, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'digest_changed' END, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 = 0 THEN 'lang_changed' END) AS reasons FROM documents)
SELECT doc_id, CASE WHEN missing THEN 'unverified' WHEN reasons <> '' THEN 'stale' ELSE 'current' END AS state, CASE WHEN missing THEN '' ELSE reasons END AS reasons FROM r"""


def audited(spark, sf):
    names = ["ECONOMY", "PROMO", "STANDARD", "SMALL"]
    catalog = spark.createDataFrame([(n, "pattern" if i % 2 else "antipattern", [i, i + 1]) for i, n in enumerate(names)], "entry string, polarity string, dimensions array<int>")
    p = table(spark, sf, "part")
    found = p.select(F.col("p_partkey").alias("entity"), F.element_at(F.split("p_type", " "), 1).alias("entry"), F.when(F.col("p_size") % 2 == 0, "pattern").otherwise("antipattern").alias("polarity"), F.when(F.col("p_size") < 40, "strong").alias("confidence"), F.array(F.lit(2), F.lit(1)).alias("dimensions"))
    return ev.code_histogram(ev.detection_audit(found, catalog))


_AUDITED = """WITH c AS (SELECT * FROM (VALUES ('ECONOMY', 'antipattern', 0), ('PROMO', 'pattern', 1), ('STANDARD', 'antipattern', 2), ('SMALL', 'pattern', 3)) t(entry, pol, d)),
p AS (SELECT p_partkey, p_size, c.entry, c.pol, c.d, CASE WHEN p_size % 2 = 0 THEN 'pattern' ELSE 'antipattern' END AS polarity FROM part LEFT JOIN c ON c.entry = string_split(p_type, ' ')[1]),
x AS (SELECT p_partkey, 'unknown_id' AS code FROM p WHERE entry IS NULL UNION ALL SELECT p_partkey, 'wrong_lane' FROM p WHERE polarity <> pol UNION ALL SELECT p_partkey, 'bad_confidence' FROM p WHERE NOT p_size < 40
 UNION ALL SELECT p_partkey, 'dimension_order' FROM p WHERE d = 1 UNION ALL SELECT p_partkey, 'dimension_membership' FROM p WHERE d <> 1) SELECT code, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM x GROUP BY 1"""


def citations(spark, sf):
    lines = table(spark, sf, "lineitem")
    cited = lines.where("l_quantity > 40").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    seen = lines.where("l_quantity > 10").select("l_orderkey", F.lit(1).alias("low"), F.col("l_linenumber").alias("high"))
    return ev.cited_outside(cited, seen, "l_orderkey").select("l_orderkey", "start", "end")


def batches(spark, sf):
    orders = table(spark, sf, "orders")
    claimed = orders.where("o_orderkey % 3 = 0").select("o_orderkey")
    back = orders.where("o_orderkey % 4 = 0").select("o_orderkey")
    return ev.batch_match(claimed, back.union(back.where("o_orderkey % 5 = 0")), "o_orderkey")


def dispositions(spark, sf):
    p = table(spark, sf, "part")
    verdict = F.element_at(F.array(*map(F.lit, ("matched", "ambiguous", "conflicting", "unmatched"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    stored = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    return p.select("p_partkey", ev.disposition(verdict, F.col("p_size") % 10, stored % 20).alias("disposition"), F.array_join(ev.non_delivery(F.col("p_size") % 7 == 0, F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 2 == 0), F.lit(1200), F.col("p_size") * 30, F.col("p_partkey") % 4 == 0), ",").alias("signals"))


def callbacks(spark, sf):
    """Views and purchases of users as callbacks that are planted and paid."""
    events = table(spark, sf, "events").where("event_type IN ('view', 'purchase')")
    rows = events.select(F.lit(1).alias("talk"), F.concat("user_id", F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("id"), F.when(F.col("event_type") == "view", "plant").otherwise("pay").alias("kind"), F.col("event_id").alias("n"))
    return ol.callbacks(rows).drop("talk")


_CALLBACKS = """WITH c AS (SELECT user_id || '/' || event_id % 5 AS id, min(event_id) FILTER (event_type = 'view') AS planted, min(event_id) FILTER (event_type = 'purchase') AS paid FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1)
SELECT *, CASE WHEN paid IS NULL THEN 'unpaid' WHEN planted IS NULL THEN 'unplanted' WHEN paid < planted THEN 'early' ELSE 'ok' END AS verdict FROM c"""


def outlines(spark, sf):
    """Conversations as outlines: turns are slides, their lengths decide what each shows."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("talk"), F.col("turn").alias("n"), F.col("role").alias("chapter"), (F.length("text") % 4).alias("builds"), (F.length("text") % 5 == 0).alias("big"), F.col("role").alias("kind"))
    count = ol.expanded_count(turns)
    one = ol.exactly_one(turns, "big").select("talk", F.col("ok").alias("one_idea"))
    order = ol.thesis_order(turns, F.col("big"), ~F.col("big")).select("talk", F.col("ok").alias("thesis"))
    first = ol.opening(turns, F.col("big")).select("talk", F.col("ok").alias("opening"))
    lack = ol.coverage(turns, "chapter", ["assistant", "system", "user"]).select("talk", F.array_join("missing", ",").alias("missing"))
    return count.join(one, "talk").join(order, "talk").join(first, "talk").join(lack, "talk")


_OUTLINES = """WITH t AS (SELECT conv_id AS talk, turn AS n, role, length(text) % 4 AS b, length(text) % 5 = 0 AS big, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT talk, sum(greatest(b, 1))::BIGINT AS slides, count(*) FILTER (big) = 1 AS one_idea, max(n) FILTER (big) < min(n) FILTER (NOT big) AS thesis, coalesce(bool_or(big AND i <= greatest(1, floor(k * 0.1) + 1)), false) AS opening,
 concat_ws(',', CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'assistant' END, CASE WHEN count(*) FILTER (role = 'system') = 0 THEN 'system' END, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'user' END) AS missing FROM t GROUP BY 1"""


def members(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("talk"), F.col("l_returnflag").alias("id"), F.col("l_linenumber").alias("i"))
    return ol.contiguous_members(rows, ["talk", "id"], "i").select("talk", "id", "verdict")


_MEMBERS = "SELECT l_orderkey AS talk, l_returnflag AS id, CASE WHEN count(*) < 2 THEN 'too_few' WHEN list_sort(list(l_linenumber::BIGINT)) <> range(1, count(*) + 1) THEN 'gap' ELSE 'ok' END AS verdict FROM lineitem GROUP BY 1, 2"


def listings(spark, sf):
    """The lines of each conversation as one text, and its timings."""
    turns = table(spark, sf, "conversations")
    text = sinks.listing(turns, "conv_id", ["turn"], F.concat("turn", F.lit(". "), "role", F.lit(": "), F.length("text")))
    notes = turns.groupBy("conv_id").agg(sinks.packed_notes(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("int"), "role")))).alias("notes"))
    return text.join(notes, "conv_id").select("conv_id", "text", F.md5("notes").alias("notes"))


_LISTINGS = "SELECT conv_id, string_agg(turn || '. ' || role || ': ' || length(text), chr(10) ORDER BY turn) AS text, md5(string_agg(turn || chr(31) || role, chr(30) ORDER BY turn)) AS notes FROM conversations GROUP BY 1"


def unique(spark, sf):
    return matching.unique_keys(table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size"), F.lit("/"), F.col("p_type")).alias("k")), "k")


def digests(spark, sf):
    n = table(spark, sf, "nation")
    return n.groupBy("n_regionkey").agg(nested.fingerprint(F.collect_list(F.struct(F.col("n_name").alias("path"), F.col("n_nationkey").cast("string").alias("text")))).alias("fingerprint"), F.count(F.lit(1)).alias("n")).withColumn("digest", nested.digest(F.col("n_regionkey"), F.col("n"), F.lit(None)))


_DIGESTS = "SELECT n_regionkey, sha256(string_agg(n_name || chr(0) || n_nationkey || chr(0), '' ORDER BY n_name)) AS fingerprint, count(*) AS n, sha256(n_regionkey || chr(0) || count(*) || chr(0)) AS digest FROM nation GROUP BY 1"


def halves(spark, sf):
    found = trend.last_halves(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"])
    return found.groupBy("user_id", "half").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


QUERIES = {"derived_outcomes": derived, "evidence_freshness": fresh, "detection_audit": audited, "citations_outside": citations, "batch_match": batches, "dispositions": dispositions, "callback_ledger": callbacks, "outline_checks": outlines, "contiguous_members": members, "rendered_listings": listings, "unique_keys": unique, "digests": digests, "last_halves": halves}
ORACLES = {
    "derived_outcomes": _DERIVED,
    "evidence_freshness": _FRESH,
    "detection_audit": _AUDITED,
    "citations_outside": "SELECT l_orderkey, l_linenumber AS start, l_linenumber + 1 AS \"end\" FROM lineitem c WHERE l_quantity > 40 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = c.l_orderkey AND s.l_quantity > 10 AND s.l_linenumber >= c.l_linenumber + 1)",
    "batch_match": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'not_returned' WHEN o_orderkey % 3 <> 0 THEN 'not_claimed' ELSE 'returned_twice' END AS code FROM orders WHERE (o_orderkey % 3 = 0) <> (o_orderkey % 4 = 0) OR (o_orderkey % 12 = 0 AND o_orderkey % 5 = 0)",
    "dispositions": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unbound' WHEN p_partkey % 4 = 0 AND p_size % 10 = p_size % 20 THEN 'confirmed' WHEN p_partkey % 4 = 0 THEN 'contradicted' WHEN p_partkey % 4 IN (1, 2) THEN 'review' ELSE 'unproven' END AS disposition,
 CASE WHEN p_size * 30 < 660 OR (p_partkey % 3 <> 0 AND p_partkey % 2 = 1 AND p_size * 30 < 600) OR (p_size % 7 = 0 AND ((p_partkey % 3 <> 0 AND p_partkey % 2 = 1) OR p_size * 30 < 900)) THEN concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'clip_marker' END, CASE WHEN p_size * 30 < 660 THEN 'short_ratio' END, CASE WHEN p_size * 30 < 120 AND p_partkey % 4 <> 0 THEN 'under_two_minutes' END, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 1 AND p_size * 30 < 600 THEN 'mismatch_under_ten_minutes' END) ELSE '' END AS signals FROM part""",
    "callback_ledger": _CALLBACKS,
    "outline_checks": _OUTLINES,
    "contiguous_members": _MEMBERS,
    "rendered_listings": _LISTINGS,
    "unique_keys": "WITH k AS (SELECT p_partkey, p_brand || '/' || p_size || '/' || p_type AS k FROM part) SELECT k, p_partkey FROM k WHERE k IN (SELECT k FROM k GROUP BY 1 HAVING count(*) = 1)",
    "digests": _DIGESTS,
    "last_halves": "SELECT user_id, half, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, CASE WHEN rn <= 5 THEN 'recent' ELSE 'prior' END AS half FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS k FROM events) WHERE rn <= 10 AND k >= 10) GROUP BY 1, 2",
}
