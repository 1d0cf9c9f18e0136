"""Leases as a stream: a claim opens one, a completion closes it, and the watermark expires it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table, a folder or one file, as a stream of files."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # the source takes a single file only through a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def leases(events: DataFrame, stale_after: int = 3600, late: str = "10 minutes", opens: str = "signup", closes: str = "purchase") -> DataFrame:
    """(user_id, claimed_at, state, at): completed when a closing event comes in time, else expired.

    State is one number a key, in event time; events of a batch are ordered before they are applied.
    """
    schema = "user_id long, claimed_at timestamp, state string, at timestamp"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, claimed = [], state.get[0] if state.exists else None

        def end(kind: str, at: int):
            out.append((key[0], pd.Timestamp(claimed, unit="s"), kind, pd.Timestamp(at, unit="s")))

        if state.hasTimedOut:
            end("expired", claimed + stale_after)
            state.remove()
            claimed = None
        else:
            events = [e for f in frames for e in zip(f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), f["event_id"].tolist(), f["event_type"].tolist())]
            for us, _, kind in sorted(events, key=lambda e: e[:2]):
                ts = us // 1_000_000
                if claimed is not None and ts - claimed >= stale_after:
                    end("expired", claimed + stale_after)
                    claimed = None
                if kind == opens and claimed is None:
                    claimed = ts
                elif kind == closes and claimed is not None:
                    end("completed", ts)
                    claimed = None
            if claimed is None:
                if state.exists:
                    state.remove()
            else:
                state.update((claimed,))
                state.setTimeoutTimestamp(max((claimed + stale_after) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "claimed_at", "state", "at"])

    kept = events.where(F.col("event_type").isin(opens, closes)).withWatermark("ts", late)
    return kept.groupBy("user_id").applyInPandasWithState(step, schema, "claimed long", "append", GroupStateTimeout.EventTimeTimeout)


def leases_batch(events: DataFrame, stale_after: int = 3600, opens: str = "signup", closes: str = "purchase", late: int = 600) -> DataFrame:
    """The same leases of a finished table, as one pass over its events sorted by key and time.

    A lease that is open at the end has expired if it ran out before the last event less `late` seconds, where the
    stream's watermark ends; else it is left out.
    """
    kept = events.where(F.col("event_type").isin(opens, closes)).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "event_type")
    last = kept.agg(F.max("ms")).first()[0]
    mark = None if last is None else last - 1000 * late

    def fold(batches):
        """One pass over rows sorted by user and time; what is carried is the user and the start of an open lease."""
        user, claimed = object(), None

        def ended(out):
            if claimed is not None and (claimed + stale_after) * 1000 < mark:
                out.append((user, claimed, "expired", claimed + stale_after))

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (kind, pa.int64(), pa.string(), pa.int64()))], names=["user_id", "claimed", "state", "at"])

        kind = pa.int64()
        for batch in batches:
            out, kind = [], batch.schema.field("user_id").type
            for who, ms, what in zip(*(batch.column(c).to_pylist() for c in ("user_id", "ms", "event_type"))):
                t = ms // 1000
                if who != user:
                    ended(out)
                    user, claimed = who, None
                if claimed is not None and t - claimed >= stale_after:
                    out.append((user, claimed, "expired", claimed + stale_after))
                    claimed = None
                if what == opens and claimed is None:
                    claimed = t
                elif what == closes and claimed is not None:
                    out.append((user, claimed, "completed", t))
                    claimed = None
            yield batch_of(out)
        out = []
        ended(out)
        yield batch_of(out)

    rows = kept.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id")
    found = rows.mapInArrow(fold, f"user_id {kept.schema['user_id'].dataType.simpleString()}, claimed long, state string, at long")
    return found.select("user_id", F.timestamp_seconds("claimed").alias("claimed_at"), "state", F.timestamp_seconds("at").alias("at"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs over all that is there and stops; the result is appended once even after a restart."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
