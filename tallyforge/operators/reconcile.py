"""Stored rows against proposals: differences, ledgers, mutation plans, repairs and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_differences(stored: DataFrame, fetched: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, stored, fetched) of every field that differs, null included, of keys in both tables."""
    long = lambda t, name: t.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))))
    both = long(stored, "stored").join(long(fetched, "fetched"), [key, "field"])
    return both.where(~F.col("stored").eqNullSafe(F.col("fetched")))


def proposals(stored: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What a proposal does to each field: add (nothing stored), unchanged, or review (another value); keys: new or existing."""
    s = stored.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = proposed.join(s, proposed[key] == F.col("_k"), "left")
    what = lambda f: F.when(F.col(f).isNull(), "absent").when(F.col(f"_{f}").isNull(), "add").when(F.col(f) == F.col(f"_{f}"), "unchanged").otherwise("review")
    return both.select(key, F.when(F.col("_k").isNull(), "new").otherwise("existing").alias("entry"), *(what(f).alias(f) for f in fields))


def rejected_again(rows: DataFrame, ledger: DataFrame, key: str, value: Column, ledger_value: Column) -> DataFrame:
    """Rows whose value a ledger of rejections (key, place, reason) names; the first place wins."""
    said = ledger.select(F.col(key).alias("_k"), ledger_value.alias("_v"), F.struct("place", "reason").alias("_r")).groupBy("_k", "_v").agg(F.min("_r").alias("_r"))
    both = rows.withColumn("_value", value).join(said, (F.col(key) == F.col("_k")) & (F.col("_value") == F.col("_v")))
    return both.withColumn("reason", F.col("_r.reason")).drop("_k", "_v", "_r", "_value")


def relation_findings(rows: DataFrame, key: str, target: str, identity: str) -> DataFrame:
    """Relations to another row: self, unknown target, or a target of another identity."""
    t = rows.select(F.col(key).alias("_t"), F.col(identity).alias("_i"))
    both = rows.where(F.col(target).isNotNull()).join(t, F.col(target) == F.col("_t"), "left")
    code = F.when(F.col(target) == F.col(key), "self").when(F.col("_t").isNull(), "unknown_target").when(~F.col(identity).eqNullSafe(F.col("_i")), "other_identity")
    return both.select(key, target, code.alias("code")).where("code is not null")


def overlapping(spans: DataFrame, asked: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Spans (key, start, end) that overlap each asked range (key, id, low, high).

    Both are cut into cells of `width`, joined by key and cell, and tested; a pair is kept in its first common cell, so
    the join is an equality join however many spans a key has.
    """
    cells = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    s = spans.withColumn("_cell", F.explode(cells(F.col("start"), F.col("end"))))
    q = asked.withColumn("_cell", F.explode(cells(F.col("low"), F.col("high"))))
    both = s.join(q, [key, "_cell"]).where((F.col("end") > F.col("low")) & (F.col("start") < F.col("high")))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("low") / width))
    return both.where(F.col("_cell") == first).drop("_cell")


def mutation_plan(target: DataFrame, plan: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(candidate, errors) of an ordered plan (key, step, expect, set): all steps apply, or the errors tell which don't.

    The steps of a row are folded in order, so a later step sees what an earlier one set. A step whose expectation
    fails, null being a value, or whose key is unknown, is an error; a set that changes nothing is none.
    """
    steps = plan.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("step", "expect", "set"))).alias("_steps"))
    both = target.join(steps, target[key] == F.col("_k"), "full_outer")

    def apply(s, x):
        ok = s["value"].eqNullSafe(x["expect"])
        return F.struct(F.when(ok, x["set"]).otherwise(s["value"]).alias("value"), F.when(ok, s["bad"]).otherwise(F.array_append(s["bad"], x["step"])).alias("bad"))

    step_type = plan.schema["step"].dataType.simpleString()
    start = F.struct(F.col(field).alias("value"), F.array().cast(f"array<{step_type}>").alias("bad"))
    both = both.withColumn("_done", F.aggregate(F.coalesce("_steps", F.array().cast(both.schema["_steps"].dataType)), start, apply))
    errors = both.select(F.coalesce(target[key], F.col("_k")).alias(key), F.when(target[key].isNull(), F.transform("_steps", lambda x: x["step"])).otherwise(F.col("_done.bad")).alias("steps"))
    candidate = both.where(target[key].isNotNull()).withColumn(field, F.col("_done.value")).select(*target.columns)
    return candidate, errors.where(F.size("steps") > 0)


def legacy_statuses(rows: DataFrame, known: dict[str, str]) -> DataFrame:
    """Statuses of older generations by their present names; others stay."""
    mapped = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return rows.withColumn("status", F.coalesce(F.try_element_at(mapped, F.col("status")), F.col("status")))


def requeue(rows: DataFrame, current: DataFrame, key: str, done: tuple[str, ...] = ("processed",)) -> DataFrame:
    """Finished rows outside the current cohort go back to the queue, with the reason and a generation more."""
    c = current.select(F.col(key).alias("_k")).distinct()
    both = rows.join(c, rows[key] == F.col("_k"), "left")
    again = F.col("status").isin(*done) & F.col("_k").isNull()
    return both.withColumns({"generation": F.col("generation") + again.cast("int"), "reason": F.when(again, "stale_generation").otherwise(F.col("reason")), "status": F.when(again, "needs-reprocessing").otherwise(F.col("status"))}).drop("_k")


def close_claims(queue: DataFrame, returned: DataFrame, key: str, run: str) -> DataFrame:
    """Claims of a run whose return has come are completed; other rows stay."""
    r = returned.select(F.col(key).alias("_k")).distinct()
    both = queue.join(r, queue[key] == F.col("_k"), "left")
    mine = F.col("_k").isNotNull() & (F.col("run_id") == run) & (F.col("claim_state") == "claimed")
    return both.withColumn("claim_state", F.when(mine, "completed").otherwise(F.col("claim_state"))).drop("_k")


def claim_consistency(claims: DataFrame) -> DataFrame:
    """Batches (run_id, batch_id) of claims (key, claimed_at, exclusions) that lack one time and one sorted exclusion list of their members."""
    agg = claims.groupBy("run_id", "batch_id").agg(F.countDistinct("claimed_at").alias("times"), F.sort_array(F.collect_set("key")).alias("members"), F.collect_set("exclusions").alias("lists"))
    code = F.array_compact(F.array(F.when(F.col("times") != 1, "several_times"), F.when(F.size("lists") != 1, "several_snapshots"), F.when((F.size("lists") == 1) & ~F.get("lists", F.lit(0)).eqNullSafe(F.col("members")), "exclusions_differ")))
    return agg.select("run_id", "batch_id", code.alias("codes")).where(F.size("codes") > 0)


def migrate(rows: DataFrame, defaults: dict[str, Column], version: int) -> DataFrame:
    """Rows of an older generation with the fields that the present one adds; rows of a later one are refused."""
    if rows.where(F.col("schema_version") > version).limit(1).count():
        raise ValueError(f"rows of a generation after {version}")
    added = {c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()}
    return rows.withColumns(added | {"schema_version": F.lit(version)})
