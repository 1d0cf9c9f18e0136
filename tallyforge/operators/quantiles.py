"""Exact quantiles of groups of any size, and aggregates of the rows on one side of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallyforge.sources import scratch


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[k]) for k in keys))


def _scale(x: Column, logs: bool) -> Column:
    """A measure that doesn't fall as x rises: x, halved against overflow, or by orders of magnitude."""
    if not logs:
        return x / 2
    size = F.ln(F.abs(x)) + 800  # over 0 for every double
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0.0)


def quantiles(rows: DataFrame, keys: list[str], value: str, p: float, buckets: int = 1024, enough: int = 4096) -> DataFrame:
    """(keys, n, quantile): the p-quantile of each group's values, between two of them in proportion, as doubles.

    No group is sorted or collected. For the two ranks that count, a group's range is parted into `buckets`; their counts
    say in which one a rank lies, and that bucket's own smallest and largest value are the next range. Once no range
    holds more than `enough` rows, or sooner by ties, the ranks are read off. A round is one aggregate of at most
    `buckets` rows for a group and rank; there are two or three for most data. Every other round parts by orders of
    magnitude, so values that differ in them by far take few more.

    Null keys are a group. Null, NaN and infinite values are not counted, and a group without others has no row.
    """
    columns = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    ks = [f"_{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    values = rows.select(*columns, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    facts = values.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = (F.col("n") - 1) * F.lit(float(p))
    first = F.floor(at).cast("long")
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), first.alias("r")), F.struct(F.lit(1).alias("which"), F.least(first + 1, F.col("n") - 1).alias("r"))))
    state = facts.select(*ks, "n", "lo", "hi", ranks.alias("x"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = scratch.written(state.select(*ks, "n", "x.which", "x.r", "lo", "hi", "below", "inside"), "quantiles")
    turn = 0
    while True:
        open_ = state.where("lo < hi")
        most = open_.agg(F.max("inside")).first()[0]
        if most is None:
            break
        both = values.join(open_, _same(values, open_, ks)).select(*(open_[k] for k in ks), "n", "which", "r", "lo", "hi", "below", "v").where("v between lo and hi")
        x, lo, hi = (_scale(F.col(c), turn % 2 == 1) for c in ("v", "lo", "hi"))
        share = F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
        turn += 1
        part = F.when(F.col("v") == F.col("hi"), buckets - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.floor(share * buckets)).cast("double")
        part = F.col("v") if most <= enough else F.least(part, F.lit(float(buckets - 1)))
        by = [*ks, "n", "which", "r", "below"]
        parted = both.groupBy(*by, part.alias("part")).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(W.partitionBy(*ks, "which").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = parted.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("inside")))
        state = scratch.written(state.where("lo = hi").unionByName(found.select(*state.columns)), "quantiles")
    one = lambda w: F.max(F.when(F.col("which") == w, F.col("lo")))
    out = state.groupBy(*ks).agg(F.max("n").alias("n"), one(0).alias("a"), one(1).alias("b"))
    between = F.col("a") + (F.col("b") - F.col("a")) * (at - F.floor(at))
    return out.select(*(F.col(k).alias(name) for k, name in zip(ks, keys)), "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("quantile"))


def beside(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """rows with the quantile of their group as `cut`; those of groups without one are left out."""
    cuts = quantiles(rows, keys, value, p).select(*keys, F.col("quantile").alias("cut"))
    return rows.join(cuts, _same(rows, cuts, keys)).select(*(rows[c] for c in rows.columns), "cut")


def means_below(rows: DataFrame, keys: list[str], value: str, p: float, columns: list[str]) -> DataFrame:
    """(keys, cut, n, means of columns) over the rows of each group whose value is at most its p-quantile, ties included."""
    low = beside(rows, keys, value, p).where(F.col(value) <= F.col("cut"))
    return low.groupBy(*keys).agg(F.max("cut").alias("cut"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns))
