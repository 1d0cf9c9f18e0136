"""Prefix sums over an order, and admission of rows until a budget is spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallyforge.sources import scratch


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """rows with, under each name of sums, the sum over all rows up to this one in order; `order` must name no row twice.

    Rows are dealt to ranges of the order and written; the driver gets one total for each range, and a window runs within
    a range alone, so no task sees more than one range. Null values count as zero.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    put = {f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    dealt = scratch.written(rows.withColumns(put).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(k) for k in sums)).orderBy("_range").collect()  # `ranges` rows
    before, so_far = [], {k: 0 for k in sums}
    for r in totals:
        before.append((r["_range"], *so_far.values()))
        so_far = {k: so_far[k] + r[k] for k in sums}
    types = {f.name: f.dataType.simpleString() for f in dealt.groupBy("_range").agg(*(F.sum(f"_v_{k}").alias(k) for k in sums)).schema}
    starts = spark.createDataFrame(before, ", ".join(["_range int", *(f"_b_{k} {types[k]}" for k in sums)]))
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.select(*rows.columns, *((F.sum(f"_v_{k}").over(within) + F.col(f"_b_{k}")).alias(k) for k in sums))


def admitted(rows: DataFrame, order: list[str], budgets: dict[str, tuple[Column, int]], reason: str = "reason") -> DataFrame:
    """rows with `reason`: null while every budget holds, from the first row that breaks one on the name of that budget.

    budgets: name to (cost of a row, limit), the first named wins where a row breaks several. Rows that already have a
    reason cost nothing and keep it. The cut is at a place of the order, so it does not depend on how rows are dealt.
    """
    rows = rows if reason in rows.columns else rows.withColumn(reason, F.lit(None).cast("string"))
    costs = {f"_s_{k}": F.when(F.col(reason).isNull(), cost) for k, (cost, _) in budgets.items()}
    summed = scratch.written(running_sums(rows, order, costs), "summed")
    broken = F.coalesce(*(F.when(F.col(f"_s_{k}") > limit, k) for k, (_, limit) in budgets.items()))
    place = F.struct(*order)
    first = summed.where(F.col(reason).isNull() & broken.isNotNull()).agg(F.min(F.struct(place.alias("place"), broken.alias("why"))).alias("f")).first()["f"]
    if first is None:
        return summed.select(*rows.columns)
    edge = F.struct(*(F.lit(first["place"][c]).alias(c) for c in order))
    return summed.withColumn(reason, F.when(F.col(reason).isNull() & (place >= edge), F.lit(first["why"])).otherwise(F.col(reason))).select(*rows.columns)
