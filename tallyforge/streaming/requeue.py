"""A work queue as a stream: claims with timers, a history of claims as list state, and late evidence that requeues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SCHEMA = "user_id long, generation int, state string, claims int, at timestamp"
#: The store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(frames: Iterator[pd.DataFrame], kind: str) -> list[tuple[str, int]]:
    """(kind, second) of a key's events by time and id; keys are many and have few events each, so no frame is made of them."""
    events = [e for f in frames for e in zip(f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), f["event_id"].tolist(), f[kind].tolist())]
    return [(k, t // 1_000_000) for t, _, k in sorted(events, key=lambda e: e[:2])]


def advanced(state: tuple, kind: str, t: int, stale: int) -> tuple[tuple, list[tuple]]:
    """The state (generation, claimed at, done, ended claims) after an event at second t, and what it says.

    claim opens a claim of what is neither claimed nor done; finish completes it; evidence on what is done sends it back
    to the queue as a new generation. A claim that has run for `stale` seconds expires before an event is applied.
    """
    (generation, claimed, done, ended), said = state, []
    if claimed is not None and t - claimed >= stale:
        ended += 1
        said.append((generation, "expired", ended, claimed + stale))
        claimed = None
    if kind == "claim" and claimed is None and not done:
        claimed = t
    elif kind == "finish" and claimed is not None:
        claimed, done, ended = None, True, ended + 1
        said.append((generation, "completed", ended, t))
    elif kind == "evidence" and done:
        generation, done = generation + 1, False
        said.append((generation, "requeued", ended, t))
    return (generation, claimed, done, ended), said


class Queue(StatefulProcessor):
    """One key's queue: its state as a value, its ended claims as a list, and a timer for an open claim."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "generation int, claimed long, done boolean, ended int")
        self.claims = handle.getListState("claims", "generation int, state string, at long")

    def _held(self) -> tuple:
        return self.now.get() or (0, None, False, 0)

    def _say(self, key, said: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], g, what, n, pd.Timestamp(t, unit="s")) for g, what, n, t in said], columns=["user_id", "generation", "state", "claims", "at"])

    def _keep(self, held: tuple, state: tuple, said: list[tuple]) -> None:
        """Writes what changed: each call to a store or a timer goes to the JVM and back."""
        if state != held:
            self.now.update(state)
        if ended := [(g, what, t) for g, what, _, t in said if what != "requeued"]:
            self.claims.appendList(ended)
        if state[1] != held[1]:
            if held[1] is not None:
                self.handle.deleteTimer((held[1] + self.stale) * 1000)
            if state[1] is not None:
                self.handle.registerTimer((state[1] + self.stale) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = state = tuple(self._held())
        out = []
        for kind, t in in_order(rows, "kind"):
            state, said = advanced(state, kind, t, self.stale)
            out += said
        self._keep(held, state, out)
        if out:
            yield self._say(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = g, claimed, done, ended = tuple(self._held())
        if claimed is not None:
            said = [(g, "expired", ended + 1, claimed + self.stale)]
            self._keep(held, (g, None, done, ended + 1), said)
            yield self._say(key, said)

    def close(self) -> None:
        pass


def queue(events: DataFrame, stale: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(user_id, generation, state, claims, at): completed, expired and requeued, as events (user_id, event_id, ts, kind)
    come. Events of a batch are applied in order of time; an open claim expires when the watermark passes its end."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(statefulProcessor=Queue(stale), outputStructType=StructType.fromDDL(SCHEMA), outputMode="Append", timeMode="eventtime")


def queue_batch(events: DataFrame, stale: int = 3600, late: int = 600) -> DataFrame:
    """The same of a finished table, as one pass over its events sorted by key and time; an open claim at the end has
    expired if it ran out by the last event less `late` seconds, where the stream's watermark ends."""
    kept = events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "kind")
    last = kept.agg(F.max("ms")).first()[0]
    mark = None if last is None else last - 1000 * late

    def fold(batches):
        user, state = object(), (0, None, False, 0)

        def ended(out):
            g, claimed, _, n = state
            if claimed is not None and (claimed + stale) * 1000 <= mark:
                out.append((user, g, "expired", n + 1, claimed + stale))

        def batch_of(out):
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["user_id", "generation", "state", "claims", "at"])

        for batch in batches:
            out = []
            for who, ms, kind in zip(*(batch.column(c).to_pylist() for c in ("user_id", "ms", "kind"))):
                if who != user:
                    ended(out)
                    user, state = who, (0, None, False, 0)
                state, said = advanced(state, kind, ms // 1000, stale)
                out += [(who, *x) for x in said]
            yield batch_of(out)
        out = []
        ended(out)
        yield batch_of(out)

    rows = kept.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id")
    found = rows.mapInArrow(fold, "user_id long, generation int, state string, claims int, at long")
    return found.withColumn("at", F.timestamp_seconds("at"))
