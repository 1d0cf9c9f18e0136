"""Repairs of many records that are made together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources import scratch


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many tasks as shuffles have: the few tasks that small partitions are merged to would grow with the rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def findings(rows: DataFrame, key: str, preconditions: DataFrame, sets: DataFrame, fields: list[str]) -> DataFrame:
    """(key, field, code): everything that speaks against a plan.

    preconditions and sets: key, field, value (as text, null counts as a value). Codes: unknown_key, unknown_field,
    precondition_failed, conflicting_sets (two values for a field) and unguarded_set (a set without a precondition of the
    same key and field). A key that is there twice is duplicate_key. Null is never the key of a row, nor a field that another guards.

    Rows and what is asked of them are dealt out and sorted once, by key and field; windows and groups follow that order.
    """
    now = [f"_now{i}" for i in range(len(fields))]
    there = rows.where(F.col(key).isNotNull()).select(key, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("row").alias("_kind"), *(F.col(f).cast("string").alias(n) for f, n in zip(fields, now, strict=True)))
    asked = preconditions.select(key, "field", "value", F.lit("guard").alias("_kind")).union(sets.select(key, "field", "value", F.lit("set").alias("_kind")))
    every = there.unionByName(asked, allowMissingColumns=True)
    of_key = Window.partitionBy(key).orderBy("field").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.array(*(F.struct(F.lit(f).alias("field"), F.min(n).over(of_key).alias("least"), F.max(n).over(of_key).alias("most"), F.count(n).over(of_key).alias("given")) for f, n in zip(fields, now, strict=True)))
    met = _dealt(every, key).select(key, "field", "value", "_kind", F.count_if(F.col("_kind") == "row").over(of_key).alias("_rows"), F.min("field").over(of_key).alias("_first"), held.alias("_held")).where("_kind <> 'row'")
    value, x = F.col("value"), F.get(F.filter("_held", lambda h: h["field"] == F.col("field")), F.lit(0))
    holds = F.when(value.isNull(), x["given"] == 0).otherwise((x["given"] == F.col("_rows")) & (x["least"] == value) & (x["most"] == value))
    fails = (F.col("_kind") == "guard") & (F.col("_rows") > 0) & F.col("field").isin(*fields) & ~holds
    met = met.select(key, "field", "_rows", "_first", (F.col("_kind") == "set").alias("_set"), F.when(F.col("_kind") == "set", value).alias("_to"), fails.alias("_fails"))
    asks = met.groupBy(key, "field").agg(
        F.max("_rows").alias("_rows"), F.min("_first").alias("_first"), F.max("_fails").alias("_fails"), F.count_if("_set").alias("_sets"), F.count_if(~F.col("_set")).alias("_guards"),
        F.min("_to").alias("_least"), F.max("_to").alias("_most"), F.count("_to").alias("_given"),
    )
    guarded = (F.col("_guards") > 0) & F.col(key).isNotNull() & F.col("field").isNotNull()
    codes = {
        "unknown_field": ~F.col("field").isin(*fields), "unknown_key": F.col("_rows") == 0, "precondition_failed": F.col("_fails"), "unguarded_set": (F.col("_sets") > 0) & ~guarded,
        "conflicting_sets": (F.col("_least") < F.col("_most")) | F.col("_given").between(1, F.col("_sets") - 1),
    }
    found = [F.when(when, F.struct("field", F.lit(code).alias("code"))) for code, when in codes.items()]
    twice = F.when((F.col("_rows") > 1) & F.col("field").eqNullSafe(F.col("_first")), F.struct(F.lit(None).cast("string").alias("field"), F.lit("duplicate_key").alias("code")))  # once a key
    return asks.select(key, F.inline(F.array_compact(F.array(*found, twice))))


def settled(rows: DataFrame, key: str, preconditions: DataFrame, sets: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after a plan with their changes, findings); `_changes`: array of (field, before, after), in the order of fields.

    One finding anywhere leaves every row as it is, without changes; the verdict is reached before any row is changed.
    Sets to the value that is there are no changes. Fields are text or cast to their type again.
    """
    against = scratch.written(findings(rows, key, preconditions, sets, fields), "findings")
    if against.limit(1).count():
        return rows.withColumn("_changes", F.array().cast("array<struct<field:string,before:string,after:string>>")), against
    said = [F.col("field") == f for f in fields]  # one value for a key and field, or there were findings
    chosen = _dealt(sets, key).groupBy(key).agg(*(F.max(F.when(s, F.col("value"))).alias(f"_to{i}") for i, s in enumerate(said)), *(F.coalesce(F.bool_or(s), F.lit(False)).alias(f"_said{i}") for i, s in enumerate(said)))
    both = _dealt(rows, key).join(chosen, key, "left")
    new = {f: F.when(F.col(f"_said{i}"), F.col(f"_to{i}").cast(rows.schema[f].dataType)).otherwise(F.col(f)) for i, f in enumerate(fields)}
    moved = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), new[f].cast("string").alias("after")) for f in fields))
    changes = F.filter(moved, lambda m: ~m["before"].eqNullSafe(m["after"]))
    return both.select(*(new[c].alias(c) if c in new else c for c in rows.columns), changes.alias("_changes")), against


def repair(rows: DataFrame, key: str, preconditions: DataFrame, sets: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate, findings, log): rows after a plan, what speaks against it, and what it changed, a row for each key and field."""
    after, against = settled(rows, key, preconditions, sets, fields)
    return after.drop("_changes"), against, after.select(key, F.inline("_changes"))
