"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Weights of the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, total_share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words of each source: (source, source_size, target double).

    sizes: (source, source_size), one row for each source. Sources in order of code point, null last, take the
    weights in turn; they share total_share of all words by weight, stop at max_epochs times their size, and the
    excess goes to the others by weight until none is above. That water level has a closed form: in order of cap
    over weight, the first source whose cap is not reached fixes it. Ties of that ratio do not change the level.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = level.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = (F.lit(total_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = sizes.withColumns({"weight": weight, "cap": F.col("source_size") * float(max_epochs)}).withColumn("at", at)
    # the level is that of the first source that stays below its cap; with none below, all are at their caps
    first = F.min(F.when(F.col("at") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("at"))))
    return levels.withColumn("level", first.over(every)["at"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, rows_per_bucket: int = 4_000, total_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source, source_size, target, taken; one row for each row of docs. A document's key is a
    seeded hash of its id, source and text, so rows without an id are spread too. The keys are cut into equal ranges, so that a range of a source
    is a few thousand rows whatever the source's share; the words of each range are summed, the sums are summed up
    along the ranges of a source, and only within a range are rows sorted. A source takes whole epochs while its budget
    lasts, and of the last one the words up to exactly floor(target): the document at the cut is taken in part.

    Null text: size 0, taken 0. A null source is a source of its own, the last. Null and repeated ids and repeated rows
    each count as rows. An empty table gives an empty result. Other columns of docs are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), id_col, F.col(source_col).cast("string"), text_col).alias("key")), "mix-sizes")
    n = rows.count()
    bits = max(0, min(40, (n // rows_per_bucket).bit_length()))
    rows = rows.withColumn("range", F.shiftright(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long"))
    sums = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), total_share, max_epochs)
    along = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(along), F.lit(0)))
    # <=> keeps the null source together
    starts, per_source = starts.withColumnRenamed("source", "s").withColumnRenamed("range", "r"), per_source.withColumnRenamed("source", "p")
    starts = starts.join(per_source, F.col("s").eqNullSafe(F.col("p"))).drop("p", "words")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    taken = F.least(F.col("epochs") * F.col("size") + part, F.lit(max_epochs) * F.col("size"))
    return placed.withColumn("epochs", epochs).select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
