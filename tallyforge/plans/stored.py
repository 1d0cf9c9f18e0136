"""Queries over stored records: swaps, what may be rendered, bindings swept anew, merges, names and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import nested, text as tx
from tallyforge.operators import contracts as ct, evidence as ev, identity as idn, profile as pf
from tallyforge.plans import records as rc
from tallyforge.sources import files, scratch, sinks
from tallyforge.sources.tables import table


def detection_swaps(spark, sf):
    """Detections of parts as JSON whose evidence and dimensions changed places, in whole, in part or not at all."""
    k = F.col("p_partkey")
    listed = F.format_string("[%d,%d]", k % 16, F.when(k % 5 == 0, k % 16).otherwise((k + 3) % 14 + 1))
    said = F.when(k % 7 == 0, '"  "').when(k % 11 == 0, "3").otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    body = F.when(k % 2 == 0, F.concat(F.lit('{"evidence":'), listed, F.lit(',"dimensions":'), said, F.lit("}"))).otherwise(F.concat(F.lit('{"evidence":'), said, F.lit(',"dimensions":'), listed, F.lit("}")))
    found = table(spark, sf, "part").select(k, ct.variant_swap(F.try_parse_json(body)).alias("repair"))
    return found.select("p_partkey", "repair.evidence", F.array_join(F.transform("repair.dimensions", lambda d: d.cast("string")), ",").alias("dimensions"))


_SWAPS = """WITH p AS (SELECT p_partkey, p_name, p_partkey % 16 AS a, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 16 ELSE (p_partkey + 3) % 14 + 1 END AS b FROM part),
s AS (SELECT *, p_partkey % 2 = 0 AND a BETWEEN 1 AND 14 AND b BETWEEN 1 AND 14 AND a <> b AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS ok FROM p)
SELECT p_partkey, CASE WHEN ok THEN p_name END AS evidence, CASE WHEN ok THEN a || ',' || b END AS dimensions FROM s"""


def usable_talks(spark, sf):
    """Parts whose stored detections pass their audit, with those that have none."""
    p = table(spark, sf, "part")
    kinds = p.select(F.split("p_type", " ")[0].alias("entry")).distinct().select("entry", F.lit("pattern").alias("polarity"), F.array(F.lit(1)).alias("dimensions"))
    found = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("entity"), F.split("p_type", " ")[0].alias("entry"), F.when(F.col("p_size") % 9 == 0, "antipattern").otherwise("pattern").alias("polarity"), F.when(F.col("p_size") < 40, "weak").alias("confidence"), F.array(F.lit(1)).alias("dimensions"))
    audits = ev.detection_audit(found, kinds).withColumnRenamed("entity", "p_partkey")
    return ct.usable(p.select("p_partkey", "p_name"), audits, "p_partkey")


def binding_sweep(spark, sf):
    """Stored bindings of decks to talks against a new assessment: some name the talk of another nation, some none."""
    talks, decks = rc._talks(spark, sf), rc._decks(spark, sf)
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"), (F.col("n_nationkey") % 3 + 2020).cast("string").alias("y"), (F.col("n_nationkey") % 10).alias("d"))
    other = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).otherwise((F.col("s_nationkey") + 1) % 25)).join(n, "s_nationkey")
    name = F.concat("y", F.lit("-05-1"), "d", F.lit("-"), "slug", F.lit("-river-stone.md"))
    stored = other.where("s_suppkey % 9 <> 4").select(F.col("s_suppkey").alias("k"), name.alias("talk")).join(decks.select("k", "deck"), "k").select("deck", "talk")
    return rc._numbered(idn.sweep(stored, decks.drop("k"), talks))


_SWEEP = f"""WITH a AS (SELECT * FROM ({rc._IDENTITIES})), o AS (SELECT s_suppkey AS k, (n_nationkey % 3 + 2020) || '-05-1' || n_nationkey % 10 || '-' || lower(replace(n_name, ' ', '-')) || '-river-stone.md' AS stored
 FROM supplier JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE (s_nationkey + 1) % 25 END WHERE s_suppkey % 9 <> 4),
b AS (SELECT a.deck, o.stored, CASE WHEN verdict = 'review_required' THEN 'review' ELSE verdict END AS v, verdict, talk FROM a LEFT JOIN o ON a.deck LIKE '%/deck-' || o.k || '.pptx' OR a.deck LIKE '%/deck-' || o.k || '-river-stone.pptx')
SELECT deck, stored, verdict, talk, CASE WHEN stored IS NULL THEN 'unbound' WHEN v = 'matched' AND talk = stored THEN 'confirmed' WHEN v = 'matched' THEN 'contradicted' WHEN v = 'review' THEN 'review' ELSE 'unproven' END AS disposition FROM b"""


def absence_provability(spark, sf):
    p = table(spark, sf, "part")
    catalog = p.select((F.col("p_size") % 3 != 0).alias("observable"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("absence_gate"))
    return pf.provability(catalog)


_MODELS = {"ECONOMY": ("small ring", "eco"), "STANDARD": ("red widget",), "PROMO": ()}


def model_names(spark, sf):
    """Registered names of parts' types and names, in any case and with spaces around them."""
    p = table(spark, sf, "part")
    given = F.when(F.col("p_partkey") % 3 == 0, F.initcap("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).otherwise(F.concat("p_brand", F.lit(" ")))
    return p.select("p_partkey", tx.resolved_name(given, _MODELS).alias("name"))


_NAMES = """WITH g AS (SELECT p_partkey, trim(CASE p_partkey % 3 WHEN 0 THEN upper(p_type[1]) || lower(p_type[2:]) WHEN 1 THEN upper(p_name) ELSE p_brand END) AS g, lower(p_type) AS t, p_name, p_partkey % 3 AS m FROM part)
SELECT p_partkey, CASE lower(g) WHEN 'economy' THEN 'ECONOMY' WHEN 'small ring' THEN 'ECONOMY' WHEN 'eco' THEN 'ECONOMY' WHEN 'standard' THEN 'STANDARD' WHEN 'red widget' THEN 'STANDARD' WHEN 'promo' THEN 'PROMO' ELSE g END AS name FROM g"""


def deep_merges(spark, sf):
    """Customers' stored objects and new ones put together at two depths: what is empty never wins."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    old = F.concat(F.lit('{"name":"'), "c_name", F.lit('","seat":{"nation":'), "c_nationkey", F.lit(',"segment":"'), "c_mktsegment", F.lit('"},"tags":["x"]}'))
    new = F.concat(F.lit('{"name":'), F.when(k % 2 == 0, '""').otherwise('"new"'), F.lit(',"seat":{"nation":'), F.when(k % 3 == 0, "null").otherwise("0"), F.lit(',"desk":'), F.when(k % 5 == 0, "{}").otherwise("false"), F.lit('},"tags":[]}'))
    return c.select(k, nested.deep_merge(old, new).alias("merged"), nested.deep_merge(F.lit(None).cast("string"), new).alias("alone"))


_MERGES = """SELECT c_custkey, '{"name":"' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'new' END || '","seat":{' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"desk":false,' END || '"nation":' || CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 0 END || ',"segment":"' || c_mktsegment || '"},"tags":["x"]}' AS merged,
'{' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '"name":"new",' END || '"seat":{"desk":' || CASE WHEN c_custkey % 5 = 0 THEN '{}' ELSE 'false' END || ',"nation":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '0' END || '}}' AS alone FROM customer"""


def collapsed_texts(spark, sf):
    """Whole texts with their white space collapsed, as digests."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("digest"), F.length(tx.collapse(F.col("text"))).alias("n"))


def discovered_files(spark, sf):
    """Customers as files in a folder for each segment, found through the root and through two of the folders."""
    root = scratch.folder(spark, "discovered")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    table(spark, sf, "customer").select(line.alias("value"), F.col("c_mktsegment").alias("segment")).repartition("segment").write.partitionBy("segment").text(root)
    found = files.discover(spark, [root, f"{root}/segment=BUILDING", f"{root}/segment=MACHINERY"], "*.txt")
    return found.select(F.regexp_extract("path", "segment=([A-Z]+)/", 1).alias("segment"), F.size("arguments").alias("arguments"))


def exclusive_tables(spark, sf):
    """Orders written to a table that must not exist: the second writer is refused and what the first wrote stays."""
    path, orders = scratch.folder(spark, "exclusive"), table(spark, sf, "orders")
    sinks.initialise(orders.select("o_orderkey", "o_orderstatus"), path)
    try:
        sinks.initialise(orders.select("o_orderkey", F.lit("X").alias("o_orderstatus")), path)
        refused = False
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        refused = True
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("refused", F.lit(refused))


QUERIES = {
    "detection_swaps": detection_swaps, "usable_talks": usable_talks, "binding_sweep": binding_sweep, "absence_provability": absence_provability, "model_names": model_names, "deep_merges": deep_merges,
    "collapsed_texts": collapsed_texts, "discovered_files": discovered_files, "exclusive_tables": exclusive_tables,
}
ORACLES = {
    "detection_swaps": _SWAPS,
    "usable_talks": "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 OR (p_size % 9 <> 0 AND p_size < 40)",
    "binding_sweep": _SWEEP,
    "absence_provability": "SELECT count(*) FILTER (p_partkey % 4 <> 0) AS provable, count(*) FILTER (p_partkey % 4 = 0) AS unknowable, count(*) AS observable FROM part WHERE p_size % 3 <> 0",
    "model_names": _NAMES,
    "deep_merges": _MERGES,
    "collapsed_texts": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))) AS n FROM documents",
    "discovered_files": "SELECT c_mktsegment AS segment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 1 END AS arguments FROM customer GROUP BY 1",
    "exclusive_tables": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS refused FROM orders GROUP BY 1",
}
