"""Ordered rows: folds against the last kept one, running offsets, intervals and their unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def keep_apart(rows: DataFrame, key: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """Rows of each key that differ by over threshold from the last row kept; the first is kept.

    No lag can carry the last kept value. Each partition is sorted by key and order, with spilling, and one pass over it
    carries the value along, so memory does not grow with the rows of a key. Rows with a null value are left out.
    """
    import pyarrow as pa

    def fold(batches):
        now, held = object(), None
        for batch in batches:
            keep = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
                if k != now or abs(v - held) > threshold:
                    now, held = k, v
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.where(F.col(value).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, rows.schema)


def changed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before in their key."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def offsets(rows: DataFrame, key: str, order: str, length: Column, gap: int = 1, name: str = "offset") -> DataFrame:
    """Adds where each part begins when a key's parts are joined with `gap` characters between."""
    before = F.sum(length + gap).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(before, F.lit(0)))


def islands(ranges: DataFrame, key: str, start: str, end: str, touch: float = 1) -> DataFrame:
    """Unions of a key's ranges; ranges at most `touch` apart are one. Ranges with one start count as the longest of them."""
    ranges = ranges.groupBy(key, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("_n"))  # no ties in the order
    w = W.partitionBy(key).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", (reach.isNull() | (F.col(start) > reach + touch)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("ranges")).drop("_island")


def complete(ranges: DataFrame, key: str, start: str, end: str, lowest: Column, highest: Column, touch: float = 1) -> DataFrame:
    """Whether the union of a key's ranges is one range from lowest to highest."""
    found = islands(ranges, key, start, end, touch).groupBy(key).agg(F.count(F.lit(1)).alias("islands"), F.min(start).alias("first"), F.max(end).alias("last"))
    return found.withColumn("complete", (F.col("islands") == 1) & (F.col("first") <= lowest) & (F.col("last") >= highest))


def contained(points: DataFrame, ranges: DataFrame, key: str, start: str, end: str, touch: float = 1) -> DataFrame:
    """Adds `inside` to points (key, start, end): within one island of the key's ranges."""
    found = islands(ranges, key, start, end, touch).select(F.col(key).alias("_k"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("r"))
    found = found.groupBy("_k").agg(F.collect_list("r").alias("_islands"))
    both = points.join(found, points[key] == F.col("_k"), "left")
    inside = F.coalesce(F.exists("_islands", lambda r: (r["s"] <= F.col(start)) & (r["e"] >= F.col(end))), F.lit(False))
    return both.withColumn("inside", inside).drop("_k", "_islands")


def contiguity(rows: DataFrame, key: str, number: str, first: int = 1) -> DataFrame:
    """Whether a key's numbers are first, first + 1, ... without a gap or a repeat."""
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("kinds"), F.min(number).alias("low"), F.max(number).alias("high"))
    return agg.select(key, "n", ((F.col("n") == F.col("kinds")) & (F.col("low") == first) & (F.col("high") == F.col("n") + first - 1)).alias("contiguous"))


def segments(rows: DataFrame) -> DataFrame:
    """Timed text (text, start, end, duration) made regular: end from duration, three places, in order, none empty."""
    end = F.coalesce(F.col("end"), F.col("start") + F.col("duration"))
    good = F.col("start").isNotNull() & end.isNotNull() & ~F.isnan("start") & ~F.isnan(end) & (F.col("start") >= 0) & (end > F.col("start")) & (F.abs(end) != float("inf"))
    made = rows.where(good).withColumns({"start": F.bround("start", 3), "end": F.bround(end, 3)}).drop("duration")
    return made.where("end > start")


def retained_frames(frames: DataFrame, key: str, index: str, fps: float) -> DataFrame:
    """(key, page_number, frame_index, timestamp_seconds): kept frames as pages, with the time of each to three places."""
    if fps <= 0:
        raise ValueError("fps must be over zero")
    page = F.row_number().over(W.partitionBy(key).orderBy(index))
    return frames.select(key, page.alias("page_number"), F.col(index).alias("frame_index"), F.bround(F.col(index) / F.lit(fps), 3).alias("timestamp_seconds"))


def timing_summary(slides: DataFrame, by: list[str], counts: list[str], flags: list[str]) -> DataFrame:
    """For each deck: slides on which a count is over zero or a flag is set, and the sums of the counts."""
    some = [F.count_if(F.col(c) > 0).alias(f"slides_with_{c}") for c in counts] + [F.count_if(F.col(f)).alias(f"slides_with_{f}") for f in flags]
    return slides.groupBy(*by).agg(*some, *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts))
