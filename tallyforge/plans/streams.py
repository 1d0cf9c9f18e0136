"""Queries run as streams, the same over finished tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.sources import scratch
from tallyforge.sources.tables import table
from tallyforge.streaming import leases, requeue


def lease_stream(spark, sf):
    """Leases of the events table run as a stream to a table; one more with every restart is not written."""
    folder = scratch.folder(spark, "leases")
    leases.run_to_table(leases.leases(leases.read_events(spark, f"{sf}/events.parquet")), f"{folder}/out", f"{folder}/state")
    return _seconds(spark.read.schema("user_id long, claimed_at timestamp, state string, at timestamp").parquet(f"{folder}/out"))


def _seconds(rows):
    return rows.selectExpr("user_id", "unix_seconds(claimed_at) AS claimed_at", "state", "unix_seconds(at) AS at")


def lease_history(spark, sf):
    return _seconds(leases.leases_batch(table(spark, sf, "events")))


def event_windows(spark, sf):
    """Events by type and hour through the stream's plan, run over a finished table."""
    folder = scratch.folder(spark, "windows")
    counts = leases.windowed_counts(leases.read_events(spark, f"{sf}/events.parquet"), "1 hour", "365 days").selectExpr("window.start AS start", "event_type", "n")
    out = f"{folder}/out"
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).selectExpr("unix_seconds(start) AS start", "event_type", "n")


_HISTORY = """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase')),
k AS (SELECT user_id, i, t, event_type, CASE WHEN event_type = 'signup' THEN t END AS held, NULL::BIGINT AS c1, NULL::BIGINT AS a1, NULL::BIGINT AS c2, NULL::BIGINT AS a2 FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.t, e.event_type,
 CASE WHEN k.held IS NOT NULL AND e.t - k.held < 3600 THEN CASE WHEN e.event_type = 'purchase' THEN NULL ELSE k.held END WHEN e.event_type = 'signup' THEN e.t END,
 CASE WHEN k.held IS NOT NULL AND e.t - k.held >= 3600 THEN k.held END, CASE WHEN k.held IS NOT NULL AND e.t - k.held >= 3600 THEN k.held + 3600 END,
 CASE WHEN k.held IS NOT NULL AND e.t - k.held < 3600 AND e.event_type = 'purchase' THEN k.held END, CASE WHEN k.held IS NOT NULL AND e.t - k.held < 3600 AND e.event_type = 'purchase' THEN e.t END
 FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)"""


_LEASES = _HISTORY + """, z AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id, c1 AS claimed_at, 'expired' AS state, a1 AS at FROM k WHERE c1 IS NOT NULL UNION ALL SELECT user_id, c2, 'completed', a2 FROM k WHERE c2 IS NOT NULL
UNION ALL SELECT user_id, held, 'expired', held + 3600 FROM k, z WHERE held IS NOT NULL AND (held + 3600) * 1000 < mark AND i = (SELECT max(i) FROM e WHERE e.user_id = k.user_id)"""

def _kinds(events):
    """Sign-ups claim, purchases finish, errors are evidence that comes late."""
    kind = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "purchase", "finish").when(F.col("event_type") == "error", "evidence")
    return events.select("user_id", "event_id", "ts", kind.alias("kind")).where("kind is not null")


def requeue_stream(spark, sf):
    """The queue of the events table, run as a stream to a table."""
    folder = scratch.folder(spark, "queue")
    leases.run_to_table(requeue.queue(_kinds(leases.read_events(spark, f"{sf}/events.parquet"))), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(requeue.SCHEMA).parquet(f"{folder}/out").selectExpr("user_id", "generation", "state", "claims", "unix_seconds(at) AS at")


def requeue_history(spark, sf):
    return requeue.queue_batch(_kinds(table(spark, sf, "events"))).selectExpr("user_id", "generation", "state", "claims", "unix_seconds(at) AS at")


_REQUEUE = """WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, CASE event_type WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'f' ELSE 'e' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS t, 0 AS gen, NULL::BIGINT AS held, false AS done, 0 AS ended, NULL::BIGINT AS late, NULL::VARCHAR AS said FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, t, gen + (kind = 'e' AND done)::INT, CASE WHEN kind = 'c' AND open IS NULL AND NOT done THEN t WHEN kind = 'f' THEN NULL ELSE open END, CASE WHEN kind = 'f' AND open IS NOT NULL THEN true WHEN kind = 'e' THEN false ELSE done END,
 n + (kind = 'f' AND open IS NOT NULL)::INT, late, CASE WHEN kind = 'f' AND open IS NOT NULL THEN 'completed' WHEN kind = 'e' AND done THEN 'requeued' END
 FROM (SELECT e.user_id, e.i, e.t, e.kind, s.gen, s.done, CASE WHEN e.t - s.held < 3600 THEN s.held END AS open, CASE WHEN e.t - s.held >= 3600 THEN s.held END AS late, s.ended + coalesce(e.t - s.held >= 3600, false)::INT AS n FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)),
z AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events WHERE event_type IN ('signup', 'purchase', 'error')), m AS (SELECT user_id, max(i) AS i FROM s GROUP BY 1)
SELECT user_id, gen - (said = 'requeued' AND said IS NOT NULL)::INT AS generation, 'expired' AS state, ended - (said = 'completed' AND said IS NOT NULL)::INT AS claims, late + 3600 AS at FROM s WHERE late IS NOT NULL
UNION ALL SELECT user_id, gen, said, ended, t FROM s WHERE said IS NOT NULL
UNION ALL SELECT user_id, gen, 'expired', ended + 1, held + 3600 FROM s JOIN m USING (user_id, i), z WHERE held IS NOT NULL AND (held + 3600) * 1000 <= mark"""

QUERIES = {"requeue_stream": requeue_stream, "requeue_history": requeue_history, "lease_stream": lease_stream, "lease_history": lease_history, "event_windows": event_windows}
ORACLES = {
    "requeue_stream": _REQUEUE,
    "requeue_history": _REQUEUE,
    "lease_stream": _LEASES,
    "lease_history": _LEASES,
    "event_windows": "SELECT floor(epoch(time_bucket(INTERVAL 1 hour, ts)))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
