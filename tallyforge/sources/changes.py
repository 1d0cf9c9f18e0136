"""Batches that are persisted once: receipts, merges in one version, and a log of what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .sinks import VersionedTable, canonical_json


def receipt(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON; null fields are left out, so null and missing are the same."""
    return F.sha2(canonical_json(*columns), 256)


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, old, new): insert, update or delete of each key, with the receipts of both sides; equal rows are left
    out. Keys are distinct on each side and not null."""
    side = lambda t, name: t.select(key, receipt(t.columns).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.withColumn("change", change).where("change is not null").select(key, "change", "old", "new")


def batch_errors(batch: DataFrame, key: str) -> DataFrame:
    """(key, code): no_key, and conflict where a batch has two different returns for a key; equal repeats are no error."""
    said = batch.select(key, receipt(batch.columns).alias("r")).groupBy(key).agg(F.min("r").alias("a"), F.max("r").alias("b"))
    code = F.when(F.col(key).isNull(), "no_key").when(F.col("a") != F.col("b"), "conflict")
    return said.select(key, code.alias("code")).where("code is not null")


def persist(table: VersionedTable, batch: DataFrame, key: str, rules: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Validates a whole batch, merges it and writes one version: rows, receipts, and the changes it made. Its number.

    Returns whose receipt the table has are replays: they change nothing, also where a later return replaced the row.
    A batch of replays alone writes nothing. Any error, of batch_errors or of rules(batch), leaves the table as it is. A
    version has the tables rows, receipts (receipt, version) and changes (key, change, old, new) of this version.
    """
    at = table.version()
    fresh = batch.withColumn("_receipt", receipt(batch.columns)).dropDuplicates([key, "_receipt"])
    if at:
        fresh = fresh.join(table.read(at, "receipts"), F.col("_receipt") == F.col("receipt"), "left_anti")
    fresh = written(fresh, "fresh")
    errors = batch_errors(batch, key)
    errors = errors if rules is None else errors.unionByName(rules(batch).select(key, "code"))
    if found := errors.orderBy("code", key).limit(1).collect():
        raise ValueError(f"not committed: {found[0].asDict()}")
    if at and not fresh.limit(1).count():
        return at
    rows = fresh.drop("_receipt")
    said = fresh.select(F.col("_receipt").alias("receipt"), F.lit(at + 1).alias("version"))
    if not at:
        changes = rows.select(key, F.lit("insert").alias("change"), F.lit(None).cast("string").alias("old"), receipt(rows.columns).alias("new"))
        return table.commit(0, {"rows": rows, "receipts": said, "changes": changes})
    held = table.read(at, "rows")
    touched = held.join(rows.select(key), key, "left_semi")
    merged = held.join(rows.select(key), key, "left_anti").unionByName(rows)
    return table.commit(at, {"rows": merged, "receipts": table.read(at, "receipts").unionByName(said), "changes": changed(touched, rows, key)})


def change_log(table: VersionedTable) -> DataFrame:
    """(version, key, change, old, new) of all versions, as written with each."""
    logs = [table.read(v, "changes").withColumn("version", F.lit(v)) for v in range(1, table.version() + 1)]
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out
