"""Queries over budgets, batches, repairs, recomputed profiles and provider evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import digests as dg, identity as idn, provider as pv, repairs as rp
from tallyforge.plans import outcomes as oc
from tallyforge.sources import changes as ch, scan, scratch
from tallyforge.sources.sinks import VersionedTable
from tallyforge.sources.tables import table


def budgeted_scan(spark, sf):
    """Orders as text files, a folder for each month; a year is pruned, a month skipped, the rest read within a budget."""
    orders = table(spark, sf, "orders")
    root = scratch.folder(spark, "scan")
    line = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    orders.select(line.alias("value"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).repartition("year", "month").write.partitionBy("year", "month").text(root)
    files = scan.pruned(scan.listing(spark, root, "*.txt"), ["year=1995"], F.when(F.element_at("folders", -1) == "month=7", "skipped"))
    files = scratch.written(scan.within_budget(files, 50, 200_000, F.floor(F.col("bytes") / 2), 90_000), "admitted")
    read = scan.lines(spark, files).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    return files.join(read, "path", "left").select(F.array_join("folders", "/").alias("folder"), "bytes", "reason", F.coalesce("lines", F.lit(0)).alias("lines"))


_SCAN = """WITH f AS (SELECT 'year=' || extract(year FROM o_orderdate) || '/month=' || extract(month FROM o_orderdate) AS folder, sum(octet_length(encode(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority))) + 1)::BIGINT AS bytes, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT *, CASE WHEN folder LIKE 'year=1995/%' THEN 'pruned' WHEN folder LIKE '%/month=7' THEN 'skipped' END AS why FROM f),
s AS (SELECT *, count(*) FILTER (why IS NULL) OVER w AS files, sum(CASE WHEN why IS NULL THEN bytes ELSE 0 END) OVER w AS b, sum(CASE WHEN why IS NULL THEN bytes // 2 ELSE 0 END) OVER w AS o FROM k WINDOW w AS (ORDER BY folder || '/' ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN why IS NULL THEN CASE WHEN files > 50 THEN 'file_limit' WHEN b > 200000 THEN 'input_limit' WHEN o > 90000 THEN 'output_limit' END END AS broken FROM s),
e AS (SELECT min(folder || '/') AS edge, arg_min(broken, folder || '/') AS said FROM x WHERE broken IS NOT NULL)
SELECT folder, bytes, coalesce(why, CASE WHEN folder || '/' >= edge THEN said END) AS reason, CASE WHEN coalesce(why, CASE WHEN folder || '/' >= edge THEN said END) IS NULL THEN n ELSE 0 END AS lines FROM x, e"""


def change_log(spark, sf):
    """Customers in two batches, each persisted twice: what every version changed."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    first = c.where("c_custkey % 5 <> 0")
    second = c.where("c_custkey % 5 = 0").union(first.where("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit(None).cast("string"))).union(first.where("c_custkey % 3 = 0 and c_custkey % 7 <> 0"))
    stored = VersionedTable(spark, scratch.folder(spark, "persisted"))
    for batch in (first, first, second, first, second):
        ch.persist(stored, batch, "c_custkey")
    return ch.change_log(stored)


_JSON = lambda segment: f"sha256('{{\"c_custkey\":' || c_custkey || {segment} || ',\"c_nationkey\":' || c_nationkey || '}}')"
_NAMED = """',"c_mktsegment":"' || c_mktsegment || '"'"""
_CHANGES = f"""SELECT 1 AS version, c_custkey, 'insert' AS change, NULL AS old, {_JSON(_NAMED)} AS new FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 2, c_custkey, 'insert', NULL, {_JSON(_NAMED)} FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 2, c_custkey, 'update', {_JSON(_NAMED)}, {_JSON("''")} FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0"""


def repair_plan(spark, sf):
    """Two plans over orders: one that holds everywhere, and one that expects what some orders are not."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    some = orders.where("o_orderkey % 4 = 0")
    holds = some.select("o_orderkey", F.lit("o_orderstatus").alias("field"), F.col("o_orderstatus").alias("value"))
    hopes = some.select("o_orderkey", F.lit("o_orderstatus").alias("field"), F.lit("O").alias("value")).union(some.where("o_orderkey % 8 = 0").select(-F.col("o_orderkey") - 1, F.lit("o_orderstatus"), F.lit("O")))
    sets = some.select("o_orderkey", F.lit("o_orderstatus").alias("field"), F.lit("P").alias("value"))
    out = []
    for name, asked in (("holds", holds), ("hopes", hopes)):
        after, against = rp.settled(orders, "o_orderkey", asked, sets, ["o_orderstatus", "o_orderpriority"])
        out.append(after.select(F.lit(name).alias("plan"), "o_orderkey", "o_orderstatus", F.when(F.size("_changes") > 0, "changed").alias("what")))
        out.append(against.select(F.lit(name).alias("plan"), "o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.col("code").alias("what")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


_REPAIR = """SELECT 'holds' AS plan, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'P' THEN 'changed' END AS what FROM orders
UNION ALL SELECT 'hopes', o_orderkey, o_orderstatus, NULL FROM orders
UNION ALL SELECT 'hopes', o_orderkey, NULL, 'precondition_failed' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus <> 'O'
UNION ALL SELECT 'hopes', -o_orderkey - 1, NULL, 'unknown_key' FROM orders WHERE o_orderkey % 8 = 0"""

_COUNTS = ["d", "e", "u"]


def profile_recompute(spark, sf):
    """Stored rates of detectors, some of them wrong, against the rates of the live outcomes of all documents."""
    live = scratch.written(oc.rates(spark, sf).select("cohort", "detector", *_COUNTS), "live")
    stored = live.where("detector <> 'bang'").withColumn("d", F.when(F.col("detector") == "question", F.col("d") + 1).otherwise(F.col("d")))
    stored = stored.withColumn("e", F.when(F.col("detector").isin("question", "stub"), None).otherwise(F.col("e")))
    stored = stored.union(stored.where("detector = 'toxic'")).union(stored.where("detector = 'shouting'").withColumn("detector", F.lit("gone")))
    return dg.assessed(stored, live, ["cohort", "detector"], _COUNTS)


_PROFILE = oc._RATES + """ SELECT cohort, detector, 'missing' AS code, NULL AS field, NULL AS stored, NULL AS live FROM b WHERE detector = 'bang'
UNION ALL SELECT cohort, 'gone', 'unknown', NULL, NULL, NULL FROM b WHERE detector = 'shouting'
UNION ALL SELECT cohort, detector, 'duplicate', NULL, NULL, NULL FROM b WHERE detector = 'toxic'
UNION ALL SELECT cohort, detector, 'differs', 'd', (d + 1)::VARCHAR, d::VARCHAR FROM b WHERE detector = 'question'
UNION ALL SELECT cohort, detector, 'differs', 'e', NULL, e::VARCHAR FROM b WHERE detector IN ('question', 'stub')"""


def _metadata(spark, sf):
    """Parts as what a provider says of films: some ids, pages, dates, lengths and titles are not as they should be."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    vid = F.lpad(k.cast("string"), 11, "0")
    other = F.lpad((k + 1).cast("string"), 11, "0")
    day = F.concat(F.lit("2020"), F.lpad((k % 13).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    return p.select(
        k, vid.alias("video_id"), F.when(k % 17 == 0, other).otherwise(F.concat(F.lit(" "), vid)).alias("id"), F.when(k % 23 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("uploader"), F.lit(None).cast("string").alias("uploader_id"),
        day.alias("upload_date"), ((F.col("p_size") - 1) * 60).alias("duration"), F.when(k % 19 == 0, F.concat(F.lit("https://youtu.be/"), other)).when(k % 29 != 0, F.concat(F.lit("https://www.youtube.com/watch?v="), vid)).alias("webpage_url"), (k % 31 != 0).alias("fetched"), "p_name", "p_size", "p_type",
    )


def provider_evidence(spark, sf):
    found = pv.evidence(_metadata(spark, sf), "video_id")
    return found.select("p_partkey", "evidence.title", "evidence.upload_date", "evidence.duration_seconds", "evidence.webpage_video_id", F.array_join("missing", ",").alias("missing"), F.array_join("faults", ",").alias("faults"))


_FILMS = """f AS (SELECT *, p_partkey AS k, lpad(p_partkey::VARCHAR, 11, '0') AS vid, lpad((p_partkey + 1)::VARCHAR, 11, '0') AS other, CASE WHEN p_partkey % 23 <> 0 THEN p_name END AS title,
CASE WHEN p_partkey % 13 <> 0 THEN '2020-' || lpad((p_partkey % 13)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS upload_date, CASE WHEN p_size > 1 THEN ((p_size - 1) * 60)::DOUBLE END AS duration_seconds FROM part),
e AS (SELECT *, CASE WHEN k % 19 = 0 THEN other WHEN k % 29 <> 0 THEN vid END AS webpage_video_id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN upload_date IS NULL THEN 'upload_date' END, CASE WHEN duration_seconds IS NULL THEN 'duration_seconds' END, CASE WHEN k % 19 <> 0 AND k % 29 = 0 THEN 'webpage_url' END) AS missing FROM f),
g AS (SELECT *, concat_ws(',', CASE WHEN k % 17 = 0 THEN 'provider_video_id_mismatch' END, CASE WHEN k % 19 = 0 THEN 'provider_webpage_identity_mismatch' END, CASE WHEN missing <> '' THEN 'provider_metadata_incomplete' END) AS faults FROM e)"""


def identity_audit(spark, sf):
    """Two records for each part, with titles, lengths, dates and stored fields that agree with the provider or not."""
    sources = pv.evidence(_metadata(spark, sf), "video_id")
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    talks = p.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    talks = talks.select(
        (k * 2 + F.col("n")).alias("talk"), F.lpad(k.cast("string"), 11, "0").alias("video_id"), F.when((k % 5 == 0) & (F.col("n") == 1), "wholly other matters").otherwise(F.col("p_name")).alias("title"), F.concat("p_type", F.lit(" Summit")).alias("conference"),
        F.when(k % 3 == 0, "2020-06-15").when(k % 3 == 1, "2021").alias("date"), F.when(k % 4 != 0, (F.col("p_size") * 60 + F.when(F.col("n") == 1, 120).otherwise(0)).cast("double")).alias("expected_seconds"), F.when(k % 7 == 0, "someone").otherwise(F.col("p_brand")).alias("stored_uploader"),
    )
    return pv.audit(talks, sources, "talk", idn.known_aliases(talks), {"uploader": "stored_uploader"})


_AUDIT = f"""WITH {_FILMS}, t AS (SELECT g.*, n, k * 2 + n AS talk, CASE WHEN k % 5 = 0 AND n = 1 THEN 'wholly other matters' ELSE p_name END AS said, CASE WHEN k % 3 = 0 THEN DATE '2020-06-15' WHEN k % 3 = 1 THEN DATE '2021-01-01' END AS day,
CASE WHEN k % 4 <> 0 THEN (p_size * 60 + n * 120)::DOUBLE END AS expected FROM g, (SELECT unnest([0, 1]) AS n)),
q AS (SELECT *, CASE WHEN title IS NOT NULL THEN NOT (k % 5 = 0 AND n = 1) END AS title_agrees, k % 31 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AS good FROM t),
z AS (SELECT *, coalesce(expected >= 600 AND duration_seconds / expected < 0.55, false) AS ratio, coalesce(duration_seconds < 120, false) AS brief, coalesce(NOT title_agrees AND duration_seconds < 600, false) AS mismatch FROM q),
x AS (SELECT vid AS video_id, talk, 'metadata_fetch_failed' AS code FROM z WHERE k % 31 = 0
UNION ALL SELECT vid, talk, unnest(string_split(faults, ',')) FROM z WHERE k % 31 <> 0 AND faults <> ''
UNION ALL SELECT vid, talk, 'provider_title_mismatch' FROM z WHERE good AND NOT title_agrees
UNION ALL SELECT vid, talk, 'provider_duration_mismatch' FROM z WHERE good AND abs(duration_seconds - expected) > greatest(60, expected * 0.05)
UNION ALL SELECT vid, talk, 'provider_upload_predates_catalog' FROM z WHERE good AND upload_date::DATE < day - 1
UNION ALL SELECT vid, talk, 'stored_source_identity_differs' FROM z WHERE good AND k % 7 = 0
UNION ALL SELECT vid, talk, 'likely_non_delivery_clip' FROM z WHERE good AND (ratio OR brief OR mismatch))
SELECT video_id, talk, code, CASE WHEN list_position({list(pv.ORDER)!r}, code) <= 6 THEN 'high' ELSE 'medium' END AS priority, (list_position({list(pv.ORDER)!r}, code) - 1)::INTEGER AS place FROM x"""

QUERIES = {"budgeted_scan": budgeted_scan, "change_log": change_log, "repair_plan": repair_plan, "profile_recompute": profile_recompute, "provider_evidence": provider_evidence, "identity_audit": identity_audit}
ORACLES = {
    "budgeted_scan": _SCAN,
    "change_log": _CHANGES,
    "repair_plan": _REPAIR,
    "profile_recompute": _PROFILE,
    "provider_evidence": f"WITH {_FILMS} SELECT k AS p_partkey, title, upload_date, duration_seconds, webpage_video_id, missing, faults FROM g",
    "identity_audit": _AUDIT,
}
