"""Queries over returns as JSON bodies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import returns as rt
from tallyforge.sources.tables import table


def _bodies(spark, sf):
    """A return for each order: its lines are detections, and some orders have another shape, score or manifest."""
    lines = table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey"))
    one = F.struct("l_linenumber", "l_partkey", F.struct(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("pattern_id"), F.when(F.col("l_returnflag") == "A", "strong").when(F.col("l_returnflag") == "N", "weak").otherwise("sure").alias("confidence"), F.when(F.col("l_quantity") > 25, "transcript").otherwise("static_slides").alias("evidence_source")).alias("d"))
    by = lines.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["d"]).alias("ds"))  # an order's lines
    k, n = F.col("k"), F.size("ds")
    detected = F.when(k % 11 == 0, F.lit("{}")).otherwise(F.to_json("ds"))
    count = F.when(k % 11 == 0, 0).otherwise(n)
    score = F.when(k % 13 == 0, "true").when(k % 3 == 0, (count + (k % 7 == 0).cast("int")).cast("string")).when(k % 3 == 1, F.format_string('{"patterns_used":%d,"antipatterns_detected":0,"score":%d}', count, count + (k % 7 == 0).cast("int"))).otherwise(F.lit('"high"'))
    frames = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string('{"page_number":%d,"frame_index":%d,"timestamp_seconds":%d.5}', i, F.when((k % 5 == 0) & (i == 2), 0).otherwise(i - 1), i)), ","), F.lit("]"))
    video = F.format_string('{"schema_version":%d,"pipeline_version":"v1","source_video_id":"o%d","source_video_path":"/x/o%d.mp4","total_frames_extracted":9,"unique_frame_count":%d,"authored_slide_count":null,"fps_used":0.5,"retained_frames":%s}', F.when(k % 6 == 0, 3).otherwise(4), k, k, n, frames)
    ask = F.when(k % 2 == 0, F.concat(F.lit('"slide_source":"video_extracted","video_extraction":'), video, F.lit(","))).otherwise("")
    seen = F.when(k % 9 == 0, "[]").otherwise('[{"source":"transcript","line_ranges":[[1,2]]}]')
    body = F.concat(F.lit('{"evidence_sources":["transcript"],"antipatterns_detected":[],"applicability_assessments":[],"patterns_detected":'), detected, F.lit(","), ask, F.lit('"source_inspection":'), seen, F.lit(',"pattern_score":'), score, F.lit("}"))
    return by.select("k", F.when(k % 97 == 0, "{").otherwise(body).alias("body"))


def return_layers(spark, sf):
    ids = spark.range(0, 40, 1, 1).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 10 == 3, "antipattern").otherwise("pattern").alias("entry_type"), (F.col("id") % 10 != 4).alias("observable"))
    return rt.return_findings(_bodies(spark, sf), "k", "body", ids.where("id <> 'p5'"))


_LAYERS = """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 1 END, l_quantity > 25) - 1 AS i, l_partkey % 40 AS p, l_returnflag AS flag, l_quantity AS q FROM lineitem),
o AS (SELECT k, count(*) AS n FROM l GROUP BY 1), c AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0 ELSE n END AS m FROM o WHERE k % 97 <> 0), d AS (SELECT * FROM l WHERE k % 97 <> 0 AND k % 11 <> 0)
SELECT k, '$' AS path, 'not_json' AS code FROM o WHERE k % 97 = 0
UNION ALL SELECT k, 'patterns_detected', 'not_array' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'patterns_detected[' || i || '].pattern_id', 'duplicate_id' FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.k = d.k AND e.i < d.i AND e.p = d.p)
UNION ALL SELECT k, 'patterns_detected[' || i || '].confidence', 'confidence' FROM d WHERE flag NOT IN ('A', 'N')
UNION ALL SELECT k, 'patterns_detected[' || i || '].evidence_source', 'source_not_available' FROM d WHERE q <= 25
UNION ALL SELECT k, 'patterns_detected[' || i || '].pattern_id', CASE WHEN p = 5 THEN 'unknown_id' WHEN p % 10 = 3 THEN 'wrong_type' ELSE 'not_observable' END FROM d WHERE p = 5 OR p % 10 IN (3, 4)
UNION ALL SELECT k, 'source_inspection', 'empty' FROM c WHERE k % 9 = 0
UNION ALL SELECT k, 'pattern_score', CASE WHEN k % 13 = 0 THEN 'boolean' WHEN k % 3 = 0 THEN 'differs' ELSE 'kind' END FROM c WHERE k % 13 = 0 OR k % 3 = 2 OR k % 3 = 0 AND k % 7 = 0
UNION ALL SELECT k, 'pattern_score.score', 'differs' FROM c WHERE k % 13 <> 0 AND k % 3 = 1 AND k % 7 = 0
UNION ALL SELECT k, 'video_extraction.schema_version', 'version' FROM c WHERE k % 6 = 0
UNION ALL SELECT k, 'video_extraction.unique_frame_count', 'beyond_total' FROM c WHERE k % 2 = 0 AND n > 9
UNION ALL SELECT k, 'video_extraction.retained_frames[1].frame_index', 'frame' FROM c WHERE k % 10 = 0 AND n >= 2
UNION ALL SELECT k, 'video_extraction.retained_frames[' || i || '].frame_index', 'frame' FROM c JOIN l USING (k) WHERE k % 2 = 0 AND i >= 9"""

QUERIES = {"return_layers": return_layers}
ORACLES = {"return_layers": _LAYERS}
