"""Joins with small band tables: the band at or below a value, or the nearest one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many bands are kept as a literal array; more are searched in batches.
MOST_BANDS = 1000


def _searched(value: Column, bands: list[tuple], near: bool) -> Column:
    """The band of each value by binary search over the sorted bands, for lists too long for a literal."""
    kind = {bool: "boolean", int: "int", float: "double"}.get(type(bands[0][1]), "string")
    keys = np.array([float(k) for k, _ in bands])
    order = np.lexsort((np.arange(len(keys)), keys))
    ranked = keys[order]
    first = np.searchsorted(ranked, ranked, side="left")  # of equal bands the first given

    @F.pandas_udf(f"struct<band:double,value:{kind},place:int>")
    def find(x: pd.Series) -> pd.DataFrame:
        v = x.to_numpy(dtype=float)
        below = np.maximum(np.searchsorted(ranked, v, side="right") - 1, 0)
        at = first[below]
        if near:
            after = np.minimum(below + 1, len(ranked) - 1)
            gap, other = np.abs(ranked[at] - v), np.abs(ranked[after] - v)
            take = (other < gap) | ((other == gap) & (order[after] < order[at]))
            at = np.where(take, first[after], at)
        place = order[at]
        return pd.DataFrame({"band": keys[place], "value": [bands[i][1] for i in place], "place": place.astype("int32")})

    return F.when(value.isNotNull(), find(F.coalesce(value.cast("double"), F.lit(0.0))))


def _bands(bands: list[tuple]) -> Column:
    return F.array(*(F.struct(F.lit(float(k)).alias("band"), F.lit(v).alias("value"), F.lit(i).alias("place")) for i, (k, v) in enumerate(bands)))


def as_of(rows: DataFrame, value: Column, bands: list[tuple], name: str = "band") -> DataFrame:
    """Adds struct `name` (band, value, place): the largest band at or below value, the smallest where there is none."""
    if not bands:
        raise ValueError("no bands")
    if len(bands) > MOST_BANDS:
        return rows.withColumn(name, _searched(value, bands, near=False))
    found = F.array_sort(F.filter(_bands(bands), lambda b: b["band"] <= value), lambda a, b: F.when(a["band"] > b["band"], -1).when(a["band"] < b["band"], 1).otherwise(a["place"] - b["place"]))
    smallest = F.array_min(_bands(bands))
    return rows.withColumn(name, F.when(value.isNotNull(), F.coalesce(F.get(found, F.lit(0)), smallest)))


def nearest(rows: DataFrame, value: Column, bands: list[tuple], name: str = "band") -> DataFrame:
    """Adds struct `name`: the band with the smallest difference, the first of equals."""
    if not bands:
        raise ValueError("no bands")
    if len(bands) > MOST_BANDS:
        return rows.withColumn(name, _searched(value, bands, near=True))
    by = F.transform(_bands(bands), lambda b: F.struct(F.abs(b["band"] - value).alias("gap"), b["place"].alias("place"), b["band"].alias("band"), b["value"].alias("value")))
    best = F.array_min(by)
    return rows.withColumn(name, F.when(value.isNotNull(), F.struct(best["band"].alias("band"), best["value"].alias("value"), best["place"].alias("place"))))


def budget_verdict(count: Column, budget: Column, slack: float = 0.05) -> Column:
    """FAIL over the budget, WARN within the last part of it, else PASS."""
    return F.when(count > budget, "FAIL").when(count >= budget * (1 - slack), "WARN").otherwise("PASS")
