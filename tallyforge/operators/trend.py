"""Trends over the last rows of each key, movements of intervals, and pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .opportunity import DETECTED, NOT_APPLICABLE, NOT_EVALUABLE, UNDETECTED


def last_halves(rows: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The last n rows of each key by `order`, with half prior or recent; keys with fewer rows are left out."""
    last = W.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    found = rows.withColumns({"rn": F.row_number().over(last), "of": F.count(F.lit(1)).over(W.partitionBy(key))})
    return found.where((F.col("rn") <= n) & (F.col("of") >= n)).withColumn("half", F.when(F.col("rn") <= n // 2, "recent").otherwise("prior")).drop("of")


def score_trend(halves: DataFrame, key: str, value: str, threshold: float = 0.5, n: int = 10) -> DataFrame:
    """Mean of the recent half less that of the prior one: improving or declining from the threshold on, itself included."""
    half = lambda h: F.sum(F.when(F.col("half") == h, F.col(value)).cast("decimal(28,4)"))
    sums = halves.groupBy(key).agg(half("prior").alias("prior_sum"), half("recent").alias("recent_sum"))
    delta, limit = F.col("recent_sum") - F.col("prior_sum"), F.lit(threshold * n / 2).cast("decimal(28,4)")
    return sums.withColumn("status", F.when(delta >= limit, "improving").when(delta <= -limit, "declining").otherwise("stable"))


def movement(prior_lower: Column, prior_upper: Column, recent_lower: Column, recent_upper: Column, complete: Column, threshold: str = "0.2") -> Column:
    """Verdict on two intervals of shares, as exact decimals; null bounds or incomplete halves are unavailable."""
    d = lambda c: c.cast("decimal(18,6)")
    low, high, t = d(recent_lower) - d(prior_upper), d(recent_upper) - d(prior_lower), F.lit(threshold).cast("decimal(18,6)")
    verdict = F.when(low >= t, "increasing").when(high <= -t, "decreasing").when((high < t) & (low > -t), "stable").otherwise("indeterminate")
    return F.when(complete & low.isNotNull() & high.isNotNull(), verdict).otherwise("unavailable")


def movements(outcomes: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Movement of each detector between the halves. outcomes: key, half, detector, outcome of n rows a key."""
    is_ = lambda h, *s: F.count_if((F.col("half") == h) & F.col("outcome").isin(*s))
    counts = outcomes.groupBy(key, "detector").agg(
        *(is_(h, *s).alias(f"{h}_{c}") for h in ("prior", "recent") for c, s in (("d", (DETECTED,)), ("e", (DETECTED, UNDETECTED)), ("u", (NOT_EVALUABLE,)), ("na", (NOT_APPLICABLE,))))
    )
    a = {h: F.col(f"{h}_e") + F.col(f"{h}_u") for h in ("prior", "recent")}
    share = lambda x, h: F.when(a[h] > 0, x.cast("decimal(18,6)") / a[h])
    lower = {h: share(F.col(f"{h}_d"), h) for h in a}
    upper = {h: share(F.col(f"{h}_d") + F.col(f"{h}_u"), h) for h in a}
    complete = (a["prior"] == n // 2) & (a["recent"] == n // 2)
    return counts.withColumn("movement", movement(lower["prior"], upper["prior"], lower["recent"], upper["recent"], complete))


def trend_availability(identities: DataFrame, key: str) -> DataFrame:
    """Whether the rows of a trend compare: identities (key, identity, any_evaluable) of its rows."""
    agg = identities.groupBy(key).agg(F.count_if(F.col("identity").isNull()).alias("missing"), F.countDistinct("identity").alias("kinds"), F.bool_or("any_evaluable").alias("some"))
    status = F.when(F.col("missing") > 0, "opportunity_identity_unavailable").when(F.col("kinds") > 1, "incomparable_opportunity_identities").when(~F.col("some"), "no_evaluable_outcomes").otherwise("available")
    return agg.select(key, status.alias("availability"))


def pacing(rows: DataFrame, key: str, order: list[str], ratio: str) -> DataFrame:
    """Over-budget count and rate of each key, and the trend of the ratio between its halves (four rows at least).

    The first half has n // 2 rows; a mean that moves by over a tenth either way worsens or improves.
    """
    w = W.partitionBy(key)
    placed = rows.withColumns({"i": F.row_number().over(w.orderBy(*order)), "n": F.count(F.lit(1)).over(w)})
    first = F.col("i") <= F.floor(F.col("n") / 2)
    exact = F.col(ratio).cast("decimal(18,6)")
    agg = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ratio) > 1).alias("over"), F.avg(F.when(first, exact)).alias("a"), F.avg(F.when(~first, exact)).alias("b"))
    trend = F.when(F.col("n") < 4, "insufficient").when(F.col("b") - F.col("a") > 0.1, "worsening").when(F.col("a") - F.col("b") > 0.1, "improving").otherwise("stable")
    return agg.select(key, "n", "over", (F.col("over").cast("double") / F.col("n")).alias("over_rate"), trend.alias("trend"))
