"""Regions of grids: what changes between frames, connected cells, the best rectangle among them, and its crop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources import scratch

from .graph import connected
from .quantiles import beside


def changes(pixels: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """(key, row, col, change): mean absolute difference of each cell over evenly spaced pairs of frames.

    pixels: key, frame (0, 1, ... of each key), row, col, luma. Of n frames every (n // sample)-th is paired with the one
    as many frames later. A pixel goes to the two pairs it can be in with opposite signs, so one aggregate gives the
    differences; a cell that lacks a frame counts as 0 in it. Keys with fewer than 2 * sample frames are left out.
    """
    sizes = pixels.groupBy(key).agg((F.max("frame") + 1).alias("frames")).where(F.col("frames") >= 2 * sample)
    sizes = sizes.select(F.col(key).alias("_key"), "frames", F.greatest(F.lit(1), F.floor(F.col("frames") / sample)).alias("step"))
    both = pixels.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    signed = F.inline(F.array(F.struct(F.col("frame").cast("long").alias("at"), F.col("luma").cast("double").alias("l")), F.struct((F.col("frame") - F.col("step")).cast("long").alias("at"), (-F.col("luma").cast("double")).alias("l"))))
    each = both.select(key, "row", "col", "frames", "step", signed).where("at >= 0 and at % step = 0 and at < frames - step")
    gaps = each.groupBy(key, "row", "col", "frames", "step", "at").agg(F.abs(F.sum("l")).alias("gap"))
    pairs = F.ceil((F.col("frames") - F.col("step")) / F.col("step"))
    return gaps.groupBy(key, "row", "col", "frames", "step").agg(F.sum("gap").alias("gap")).select(key, "row", "col", (F.col("gap") / pairs).alias("change"))


#: Rows and columns of a tile of a grid: what a task labels at once.
TILE = (128, 1024)


def _labelled(tile: tuple[int, int]):
    """Labels tiles that come as sorted cells (_key, _tr, _tc, row, col), all tiles of a batch at once; what is carried is the last tile."""
    height, width = tile

    def label(table: pa.Table) -> list[pa.RecordBatch]:
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for name in ("_key", "_tr", "_tc"):
            c = table.column(name).combine_chunks()
            differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            gone = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differ | (gone[1:] != gone[:-1])
        row, col, tr, tc = (table.column(x).to_numpy() for x in ("row", "col", "_tr", "_tc"))
        group = np.cumsum(new) - 1
        code = (group * (height + 1) + (row - tr * height)) * (width + 1) + (col - tc * width)  # a free row and column part tiles and rows
        keep = np.ones(n, bool)
        keep[1:] = code[1:] != code[:-1]
        at, code = np.flatnonzero(keep), code[keep]
        starts = np.ones(len(code), bool)
        starts[1:] = code[1:] != code[:-1] + 1
        run = np.cumsum(starts) - 1
        below = np.minimum(np.searchsorted(code, code + width + 1), len(code) - 1)
        tied = code[below] == code + width + 1
        a, b = run[tied], run[below[tied]]
        name = np.arange(int(starts.sum()))
        while (name[a] != name[b]).any():  # the smaller of two names goes to both and to what they are named after
            low = np.minimum(name[a], name[b])
            for ends in (name[a], name[b], a, b):
                np.minimum.at(name, ends, low)
            while (name[name] != name).any():
                name = name[name]
        ends = np.ones(len(code), bool)
        ends[:-1] = starts[1:]
        first, last = at[starts], at[ends]
        head = table.take(pa.array(first))
        columns = {"c0": col[first], "c1": col[last], "frow": row[first][name], "fcol": col[first][name]}
        out = pa.table([*(head.column(x) for x in ("_key", "_tr", "_tc", "row")), *map(pa.array, columns.values())], names=["_key", "_tr", "_tc", "row", *columns])
        return out.combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            same = np.ones(table.num_rows, bool)
            for name in ("_key", "_tr", "_tc"):
                c = table.column(name).combine_chunks()
                last = c[-1]
                same &= c.is_null().to_numpy(zero_copy_only=False) if not last.is_valid else pc.fill_null(pc.equal(c, last), False).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from label(table.slice(0, cut))
            held = table.slice(cut)
            if held.num_rows > 2 * height * width:  # repeated cells
                held = held.group_by(["_key", "_tr", "_tc", "row", "col"], use_threads=False).aggregate([]).select(table.column_names)
        if held is not None:
            yield from label(held)

    return run


def components(cells: DataFrame, key: str, tile: tuple[int, int] = TILE) -> DataFrame:
    """(key, row, c0, c1, first): runs of cells of a row, each with the first cell of its component by row and column.

    Cells (key, row, col) touch at their sides. Grids are cut into tiles; a task labels the runs of its tiles one after
    another, and only components that reach over an edge between tiles are tied by rounds over all of them. A run ends at
    its tile's edge. Repeated cells count once; cells with a null row or column are left out; null keys are a grid. Keys
    are of an atomic type.
    """
    height, width = tile
    kind = cells.select(key).schema[0].dataType.simpleString()
    cells = cells.select(F.col(key).alias("_key"), F.floor(F.col("row") / height).cast("long").alias("_tr"), F.floor(F.col("col") / width).cast("long").alias("_tc"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).where("row is not null and col is not null").distinct()
    sorted_ = cells.repartition("_key", "_tr", "_tc").sortWithinPartitions("_key", "_tr", "_tc", "row", "col")
    runs = scratch.written(sorted_.mapInArrow(_labelled(tile), f"_key {kind}, _tr long, _tc long, row long, c0 long, c1 long, frow long, fcol long"), "runs")
    name = F.struct(F.col("_key").isNotNull().alias("some"), F.col("_key").alias("key"), F.col("frow").alias("row"), F.col("fcol").alias("col"), "_tr", "_tc")
    runs = runs.withColumn("name", name)
    # runs at a tile's lower or right edge against those that begin the next one
    down, up = runs.where(F.col("row") == (F.col("_tr") + 1) * height - 1), runs.where(F.col("row") == F.col("_tr") * height)
    u, v = down.alias("u"), up.alias("l")
    touch = u.join(v, F.col("u._key").eqNullSafe(F.col("l._key")) & (F.col("u.row") + 1 == F.col("l.row")) & (F.col("u._tc") == F.col("l._tc")) & (F.col("u.c0") <= F.col("l.c1")) & (F.col("l.c0") <= F.col("u.c1")))
    u, v = runs.where(F.col("c1") == (F.col("_tc") + 1) * width - 1).alias("u"), runs.where(F.col("c0") == F.col("_tc") * width).alias("l")
    beside_ = u.join(v, F.col("u._key").eqNullSafe(F.col("l._key")) & (F.col("u.row") == F.col("l.row")) & (F.col("u.c1") + 1 == F.col("l.c0")))
    edges = scratch.written(touch.select(F.col("u.name").alias("a"), F.col("l.name").alias("b")).union(beside_.select("u.name", "l.name")).distinct(), "ties")
    own = runs.withColumn("_first", F.struct(F.col("frow").alias("row"), F.col("fcol").alias("col")))
    if edges.limit(1).count():
        tied = connected(edges)
        whole = tied.select("node", F.struct("component.row", "component.col").alias("_whole"))
        own = own.join(whole, own["name"] == whole["node"], "left").withColumn("_first", F.coalesce("_whole", "_first"))
    return own.select(F.col("_key").alias(key), "row", "c0", "c1", F.col("_first").alias("first"))


def boxes(runs: DataFrame, key: str) -> DataFrame:
    """(key, first, cells, rmin, rmax, cmin, cmax) of each component."""
    return runs.groupBy(key, "first").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"), F.min("row").alias("rmin"), F.max("row").alias("rmax"), F.min("c0").alias("cmin"), F.max("c1").alias("cmax"))


def best_rectangle(found: DataFrame, key: str, height: int, width: int, min_fill: float = 0.5, min_area: float = 0.15, min_aspect: float = 1.0, max_aspect: float = 2.4) -> DataFrame:
    """(key, rmin, rmax, cmin, cmax, fill): of the boxes that pass the gates the one of largest area, then the first found.

    A box must take min_area of the grid, its component min_fill of the box, and its width over its height must lie
    within the aspects. Keys without such a box have no row.
    """
    h, w = F.col("rmax") - F.col("rmin") + 1, F.col("cmax") - F.col("cmin") + 1
    fill = F.col("cells") / (h * w)
    good = found.where((h * w / F.lit(height * width) >= min_area) & (fill >= min_fill) & (w / h).between(min_aspect, max_aspect))
    best = good.groupBy(key).agg(F.min(F.struct((-h * w).alias("less"), "first", "rmin", "rmax", "cmin", "cmax", fill.alias("fill"))).alias("b"))
    return best.select(key, "b.rmin", "b.rmax", "b.cmin", "b.cmax", "b.fill")


def region(best: DataFrame, height: int, width: int, margin: float = 0.02) -> DataFrame:
    """best with left, upper, right, lower as shares of the grid, with a margin; boxes of over 0.9 of it are left out."""
    edge = lambda c, n, m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / F.lit(float(n)) + m))
    out = best.withColumns({"left": edge(F.col("cmin"), width, -margin), "upper": edge(F.col("rmin"), height, -margin), "right": edge(F.col("cmax") + 1, width, margin), "lower": edge(F.col("rmax") + 1, height, margin)})
    return out.where((F.col("right") - F.col("left")) * (F.col("lower") - F.col("upper")) <= 0.9)


def crop_box(width: Column, height: Column) -> Column:
    """Whole pixels of a region in a picture of a size: each edge cut down to a whole number."""
    return F.struct(*((F.col(c) * (width if c in ("left", "right") else height)).cast("int").alias(c) for c in ("left", "upper", "right", "lower")))


def moving_regions(pixels: DataFrame, key: str, height: int, width: int, sample: int = 10, share: float = 0.6, **gates: float) -> DataFrame:
    """The best rectangle, with its region, of the cells of each key that change more than its `share`-quantile."""
    moving = beside(changes(pixels, key, sample), [key], "change", share).where("change > cut")
    return region(best_rectangle(boxes(components(moving, key), key), key, height, width, **gates), height, width)
