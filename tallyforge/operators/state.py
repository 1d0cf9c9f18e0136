"""Leases, upserts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States from which a row may be claimed.
CLAIMABLE = ("pending", "needs-reprocessing", "skipped_download_failed")


def claim(queue: DataFrame, key: str, run: str, batch: str, now: Column, limit: int = 5) -> DataFrame:
    """The queue after a batch is claimed. queue: key, status, claimable, run_id, batch_id, claimed_at, claim_state.

    A batch that was claimed before comes back as it was. Otherwise the first `limit` claimable keys in order are taken.
    """
    mine = (F.col("run_id") == run) & (F.col("batch_id") == batch) & F.col("claim_state").isin("claimed", "completed")
    if queue.where(mine).limit(1).count():
        return queue.withColumn("taken", mine)
    free = F.col("status").isin(*CLAIMABLE) & F.col("claimable") & (F.coalesce(F.col("claim_state"), F.lit("")) != "claimed")
    first = queue.where(free).select(key).orderBy(key).limit(limit).withColumn("_new", F.lit(True))
    both = queue.join(F.broadcast(first), key, "left")  # limit rows
    new = F.coalesce("_new", F.lit(False))
    put = lambda c, v: F.when(new, v).otherwise(F.col(c))
    return both.withColumns({"run_id": put("run_id", F.lit(run)), "batch_id": put("batch_id", F.lit(batch)), "claimed_at": put("claimed_at", now), "claim_state": put("claim_state", F.lit("claimed")), "status": put("status", F.lit("in-progress")), "taken": new}).drop("_new")


def recover(queue: DataFrame, now: Column, stale_after: int) -> DataFrame:
    """Adds `recovery`: none, drifted (status moved on), expired (age from stale_after seconds on), live or clock_error."""
    age = F.unix_seconds(now) - F.unix_seconds("claimed_at")
    what = F.when(F.coalesce(F.col("claim_state"), F.lit("")) != "claimed", "none").when(F.col("status") != "in-progress", "drifted").when(age < 0, "clock_error").when(age >= stale_after, "expired")
    return queue.withColumns({"age": age, "recovery": what.otherwise("live")})


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with source's rows put in: a non-null value of source wins, keys that target lacks are added."""
    fields = [c for c in target.columns if c != key]
    s = source.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in fields if c in source.columns))
    both = target.join(s, target[key] == F.col("_k"), "full_outer")
    action = F.when(F.col("_k").isNull(), "kept").when(target[key].isNull(), "added").otherwise("updated")
    return both.select(F.coalesce(target[key], F.col("_k")).alias(key), *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in source.columns else F.col(c) for c in fields), action.alias("action"))


def patch(target: DataFrame, patches: DataFrame, key: str, field: str) -> DataFrame:
    """Compare and set: patches (key, expect, set) apply where the field still equals expect, null included.

    Adds applied: true, false (expectation failed) or null (no patch for the row).
    """
    p = patches.select(F.col(key).alias("_k"), F.col("expect").alias("_expect"), F.col("set").alias("_set"))
    both = target.join(p, target[key] == F.col("_k"), "left")
    ok = F.col(field).eqNullSafe(F.col("_expect"))
    return both.withColumns({"applied": F.when(F.col("_k").isNotNull(), ok)}).withColumn(field, F.when(F.col("applied"), F.col("_set")).otherwise(F.col(field))).drop("_k", "_expect", "_set")


def is_empty(x: Column) -> Column:
    """Null and the empty text are empty; 0 and false are values."""
    return x.isNull() | (x.cast("string") == "")


def merge_maps(old: Column, new: Column) -> Column:
    """Maps of texts put together: a value of new that is not empty wins, what new lacks stays."""
    return F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")), lambda _, a, b: F.when(is_empty(b), a).otherwise(b))


def reconstruct_run(queue: DataFrame, key: str, run: str) -> DataFrame:
    """(batch_id, key, keys): a row for each key of a run's batches, with how many the batch has; no batch is gathered."""
    own = queue.where(F.col("run_id") == run).select("batch_id", key)
    return own.join(own.groupBy("batch_id").agg(F.count(F.lit(1)).alias("keys")), "batch_id")


def latest(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """The row of the highest generation of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("r")).select(key, "r.*")


def merge_by_policy(existing: DataFrame, incoming: DataFrame, key: str, replace: list[str], additive: list[str]) -> DataFrame:
    """existing with the fields of incoming: replaced ones as given, where the record gives them at all; additive maps key by key.

    A null field was not given and stays; an empty array is given and replaces. Of additive maps empty values never win.
    """
    new = incoming.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in (*replace, *additive)))
    both = existing.join(new, existing[key] == F.col("_k"), "full_outer").withColumn(key, F.coalesce(key, "_k"))
    both = both.withColumns({c: F.coalesce(f"_{c}", c) for c in replace})
    both = both.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"_{c}")).otherwise(merge_maps(F.col(c), F.col(f"_{c}"))) for c in additive})
    return both.select(*existing.columns)
