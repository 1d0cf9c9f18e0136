"""Vectors of whole numbers: what clustering and the nearest-neighbour joins share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def dense(column: pa.Array) -> np.ndarray:
    """Rows of float64 from a column of packed vectors; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = [np.frombuffer(x, dtype="<f8") for x in (b if b is not None else b"" for b in column.to_pylist())]
    width = max(map(len, raw), default=0)
    out = np.zeros((len(raw), width))
    for row, r in zip(out, raw):
        row[: len(r)] = r
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) if x.shape[1] < w else x for x in (a, b))


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float, width: int | None = None, label=None) -> DataFrame:
    """(id, label, v binary): the vectors floor(scale * x) as packed doubles, which hold whole numbers of any size exactly.

    Null vectors, those with null or non-finite components, and those of another length than `width` are left out; so are
    components whose product is beyond the range of a double. `label` is a column, or None for a label of zero.
    """

    def each(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten()
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * np.asarray(values.fill_null(np.nan), dtype=np.float64))
            good = np.asarray(lists.is_valid()).copy()
            bad = np.flatnonzero(~np.isfinite(x))
            good[np.searchsorted(ends, bad, side="right")] = False
            starts = ends - np.diff(ends, prepend=0)
            if width is not None:
                good &= ends - starts == width
            x = (x + 0.0).astype("<f8")  # no negative zeros
            packed = [x[a:b].tobytes() for a, b in zip(starts[good].tolist(), ends[good].tolist())]
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(packed, pa.binary())], names=["id", "label", "v"])

    small_batches(rows.sparkSession)
    label = F.lit(0) if label is None else label
    rows = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(each, f"id {kinds['id']}, label {kinds['label']}, v binary")
