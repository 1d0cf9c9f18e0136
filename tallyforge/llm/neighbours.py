"""Voronoi joins for the highest inner products: exact top-k search, and hard negatives within a band of scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .clustering import upper
from .common import materialize, small_batches
from .whole import dense, same_width, whole_vectors

#: Vectors in a block, about, and blocks that one task joins with one group of queries.
UNIT, SHARE = 8192, 16
#: Squared lengths below this make products that doubles hold exactly, with room for a place in a block.
NARROW = 2.0**46


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond the range of a long they stop at its ends."""
    a, b = same_width(a, b)
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(c) for c in r] for r in a], dtype=object).dot(np.array([[int(c) for c in r] for r in b], dtype=object).T)
    return np.vectorize(lambda s: max(-(1 << 63), min((1 << 63) - 1, s)), otypes=[np.int64])(whole)


class Scores:
    """Scores of a block of queries with a block of rows, as keys that sort by score and then by smaller id, null last."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, null: np.ndarray):
        score = products(queries, rows)
        self.at = np.lexsort((ids, null))  # the row of each place
        self.place = np.empty(len(ids), np.int64)
        self.place[self.at] = np.arange(len(ids))
        self.bits, self.values = max(1, len(ids).bit_length()), None
        if np.abs(score.astype(np.float64)).max(initial=0.0) * 2.0**self.bits >= 2.0**62:
            self.values, score = np.unique(score, return_inverse=True)  # ranks stand for scores
            score = score.reshape(len(queries), len(rows))
        self.key = (score << self.bits) + (len(ids) - 1 - self.place)[None, :]
        self.n = len(ids)

    def edges(self, low: int, high: int) -> tuple[int, int]:
        """Keys of the lowest and the highest place of scores from low to high."""
        if self.values is not None:
            low, high = int(np.searchsorted(self.values, low)), int(np.searchsorted(self.values, high, side="right")) - 1
        return low << self.bits, (high << self.bits) + (1 << self.bits) - 1

    def opened(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of keys."""
        score = key >> self.bits
        row = self.at[np.clip(self.n - 1 - (key & ((1 << self.bits) - 1)), 0, self.n - 1)]
        return row, score if self.values is None else self.values[np.clip(score, 0, len(self.values) - 1)]


class Best:
    """The best `k` rows of each of several lists, over any number of blocks."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((lists, 0), np.int64), np.zeros((lists, 0), np.int64)
        self.null, self.same, self.none = (np.zeros((lists, 0), dtype=bool) for _ in range(3))

    def add(self, score, ids, null, same, none) -> None:
        new = [np.concatenate(p, axis=1) for p in ((self.score, score), (self.id, ids), (self.null, null), (self.same, same), (self.none, none))]
        order = np.lexsort((new[1], new[2], ~new[0], new[4]), axis=-1)[:, : self.k]  # ~x falls as x grows, and can't overflow
        self.score, self.id, self.null, self.same, self.none = (np.take_along_axis(p, order, axis=1) for p in new)

    def columns(self):
        """(list, id, null, score, same) of all that was found, flat."""
        row, col = np.nonzero(~self.none)
        return row, self.id[row, col], self.null[row, col], self.score[row, col], self.same[row, col]


class Cells:
    """Pivots, and each vector x with its cell: the nearest pivot in the space that has sqrt(M - |x|^2) as one more axis.

    There a query, with zero on that axis, is the nearer to x the higher their product: |q|^2 + M - 2 q.x, where M is
    the largest squared length. Pivots are picked far apart among at most `fit` vectors (the smallest hashes) and stand in
    the order of a walk to the nearest one left, so cells with near numbers are near.
    """

    def __init__(self, base: DataFrame, pivots: int | None, fit: int):
        def lengths(batches):
            for batch in batches:
                v = dense(batch.column(0))
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array([float((v * v).sum(axis=1).max(initial=0.0))]), pa.array([batch.num_rows])], names=["most", "n"])

        found = base.select("v").mapInArrow(lengths, "most double, n long").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
        self.most, self.total = found["most"] or 0.0, found["n"] or 0
        self.narrow = self.most < NARROW
        some = base.orderBy(F.xxhash64("v"), F.xxhash64("id")).select("v").limit(fit).collect()  # fit rows
        x = dense(pa.array([r["v"] for r in some], pa.binary())) if some else np.zeros((1, 1))
        p = upper(self.raised(x), pivots or max(16, min(2048, self.total // 1024))) if self.narrow else np.zeros((1, 2))
        left, walk = set(range(1, len(p))), [0]
        while left:
            walk.append(min(left, key=lambda c: float(((p[c] - p[walk[-1]]) ** 2).sum())))
            left.remove(walk[-1])
        self.p = p[walk]

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))[:, None], x), axis=1)

    def gaps(self, raised: np.ndarray) -> np.ndarray:
        """Distances to the pivots."""
        v, p = same_width(raised, self.p)
        return np.sqrt(np.maximum(0.0, (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * v @ p.T))

    def deal(self, rows: DataFrame, queries: bool = False) -> DataFrame:
        """rows, with columns v, and for each its cell and its distance `far` from the pivot."""

        def each(batches):
            for batch in batches:
                v = dense(batch.column(batch.schema.get_field_index("v")))
                cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
                if len(v) and self.narrow:
                    gaps = self.gaps(np.pad(v, ((0, 0), (1, 0))) if queries else self.raised(v))
                    cell = gaps.argmin(axis=1).astype(np.int32)
                    far = gaps[np.arange(len(v)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(each, f"{kinds}, cell int, far double")


def blocked(rows: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """(part, cell, unit) and arrays of the other columns, v as one run of doubles: blocks of about `size` rows of a cell."""
    counts = rows.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("units"))
    dealt = rows.join(counts, ["part", "cell"]).withColumn("unit", F.pmod(F.xxhash64("id", "v"), F.col("units")).cast("int"))
    return packed_rows(dealt, ["part", "cell", "unit"], extra)


def packed_rows(rows: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    def pack(table):
        x = dense(table.column("v"))
        columns = [table.column(k)[:1].combine_chunks() for k in keys]
        columns += [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in extra]
        return pa.table([*columns, pa.array([x.astype("<f8").tobytes()], pa.binary())], names=[*keys, *extra, "v"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} array<{kinds[c]}>" for c in extra] + ["v binary"])
    return rows.select(*keys, *extra, "v").groupBy(*keys).applyInArrow(pack, schema)


def summaries(rows: DataFrame, k: int) -> DataFrame:
    """(part, cells): for each cell its radius and its k + 1 members nearest to the pivot, with their labels."""
    sliced = rows.select("part", "cell", "far", "label", F.pmod(F.xxhash64("v", "id"), F.lit(64)).alias("slice"))
    best = sliced.withColumn("r", F.row_number().over(W.partitionBy("part", "cell", "slice").orderBy("far"))).where(F.col("r") <= k + 1)
    best = best.withColumn("r", F.row_number().over(W.partitionBy("part", "cell").orderBy("far"))).where(F.col("r") <= k + 1)
    best = best.groupBy("part", "cell").agg(F.collect_list(F.struct("far", "label")).alias("near"))  # k + 1 entries
    radius = rows.groupBy("part", "cell").agg(F.max("far").alias("radius"))
    return radius.join(best, ["part", "cell"]).groupBy("part").agg(F.collect_list(F.struct("cell", "radius", "near")).alias("cells"))  # pivots entries


class Pruner:
    """Which cells a group of queries needs, from summaries alone."""

    def __init__(self, cells: Cells, k: int):
        self.cells, self.k = cells, k

    def needs(self, q: np.ndarray, labels: list, wants: list | None, summary: list[dict]) -> list[int]:
        where = np.array([s["cell"] for s in summary])
        if not self.cells.narrow:
            return where.tolist()
        radius = np.array([s["radius"] for s in summary])
        entries = [(c, e["far"], e["label"]) for c, s in enumerate(summary) for e in s["near"]]
        cell, far = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
        size = (q * q).sum(axis=1)
        slack = 1e-6 * (1 + float(np.sqrt(size.max(initial=0.0) + self.cells.most)))
        needed = np.zeros(len(where), dtype=bool)
        named = np.array([e[2] for e in entries])
        for at in range(0, len(q), 128):
            gaps = self.cells.gaps(np.pad(q[at : at + 128], ((0, 0), (1, 0))))[:, where]
            if wants is None:
                reach = np.full((len(gaps), 1), np.inf)
                if len(far) > self.k:  # the (k + 1)-th: one may be the query's own row
                    reach = np.partition(gaps[:, cell] + far[None, :], self.k, axis=1)[:, self.k : self.k + 1]
                needed |= (gaps - radius[None, :] <= reach + slack).any(axis=0)
                continue
            for i, gap in enumerate(gaps):
                other = named != labels[at + i]
                for low, high in wants[at + i]:
                    if low > high:
                        continue
                    near, edge = (float(np.sqrt(max(0.0, size[at + i] + self.cells.most - 2.0 * s))) for s in (high, low))
                    sure = other & (gap[cell] - far >= near + slack) & (gap[cell] + far <= edge - slack)
                    if sure.sum() >= self.k:
                        edge = min(edge, float(np.partition((gap[cell] + far)[sure], self.k - 1)[self.k - 1]))
                    needed |= (gap - radius <= edge + slack) & (gap + radius >= near - slack)
        return where[needed].tolist()


def band(score: int) -> tuple[int, int]:
    """The lowest and the highest whole score s with 30 * score <= 100 * s <= 90 * score."""
    return -(-30 * score // 100), 90 * score // 100


def served(rows: DataFrame, queries: DataFrame, cells: Cells, k: int, group: int, name: str, bands: bool = False) -> DataFrame:
    """(q, at, id, score, same): for each query, and each of its `wants` by number, the best rows that its group is served.

    rows: id, label, v, cell, far and part; queries: q (a number of its own), id, label, v, cell, part and wants, scores.
    A query meets the rows of its part. Blocks of rows go to those groups of queries alone whose bounds their cells can
    reach, and a task joins one group with at most about SHARE blocks, one at a time. Without bands the best k + 1 come
    back, as one may be the query's own row; with bands, for each score wanted, the best k of other labels in its band.
    """
    extra = ["id", "label"]
    data = materialize(blocked(rows, UNIT, extra), f"{name}-blocks", "zstd")
    # groups: queries of neighbouring cells up to `group`, those of a larger cell by hash
    counts = queries.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("part").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))  # pivots rows a part
    counts = counts.select("part", "cell", F.floor(F.coalesce(before, F.lit(0)) / group).alias("g"), F.ceil(F.col("n") / group).alias("several"))
    grouped = queries.join(counts, ["part", "cell"]).withColumn("g", F.col("g") + F.pmod(F.xxhash64("q"), F.col("several")))
    groups = materialize(packed_rows(grouped, ["part", "g"], [*extra, "q", "wants"]), f"{name}-groups", "zstd")
    pruner = Pruner(cells, k)

    def needs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("part", "g", "label", "wants", "cells")}
                q = np.frombuffer(batch.column("v")[i].as_buffer(), "<f8").reshape(len(r["label"]), -1)
                found = pruner.needs(q, r["label"], [[band(s) for s in w or ()] for w in r["wants"]] if bands else None, r["cells"])
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(found), batch.schema.field("part").type), pa.array([r["g"]] * len(found), pa.int64()), pa.array(found, pa.int32())], names=["part", "g", "cell"])

    part_type = groups.schema["part"].dataType.simpleString()
    small_batches(rows.sparkSession)
    pairs = groups.join(summaries(rows, k), "part").mapInArrow(needs, f"part {part_type}, g long, cell int")
    units = data.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("units"))
    pairs = materialize(pairs.join(units, ["part", "cell"]), f"{name}-pairs")
    shares = pairs.groupBy("part", "g").agg(F.ceil(F.sum("units") / SHARE).cast("int").alias("shares"))
    there = data.join(pairs.drop("units").join(shares, ["part", "g"]), ["part", "cell"])
    there = there.select("part", "g", F.pmod(F.xxhash64("cell", "unit"), F.col("shares")).cast("int").alias("share"), F.lit(True).alias("data"), *extra, "v", F.lit(None).cast(groups.schema["q"].dataType).alias("q"), F.lit(None).cast(groups.schema["wants"].dataType).alias("wants"))
    asking = groups.join(shares, ["part", "g"]).select("part", "g", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("data"), *extra, "v", "q", "wants")
    met = there.unionByName(asking).repartition("part", "g", "share").sortWithinPartitions("part", "g", "share", "data")

    def columns_of(batch, i):
        ids = batch.column("id")[i].values
        null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        return ids, null, np.asarray(batch.column("label")[i].values), np.frombuffer(batch.column("v")[i].as_buffer(), "<f8").reshape(len(ids), -1)

    def solve(batches):
        schema = pa.schema([("q", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("same", pa.bool_())])
        asked = None

        def told():
            row, ids, null, score, same = asked["best"].columns()
            q, at = np.array(asked["who"], np.int64)[row], np.array(asked["at"], np.int32)[row]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(at, pa.int32()), pa.array(ids, mask=null), pa.array(score), pa.array(same)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                ids, null, labels, v = columns_of(batch, i)
                if not batch.column("data")[i].as_py():
                    if asked:
                        yield told()
                    q = batch.column("q")[i].as_py()
                    wants = batch.column("wants")[i].as_py()
                    lists = [(r, n, band(s)) for r, w in enumerate(wants) for n, s in enumerate(w or ())] if bands else [(r, 0, None) for r in range(len(q))]
                    asked = {"ids": ids, "null": null, "labels": labels, "v": v, "lists": lists, "who": [q[r] for r, _, _ in lists], "at": [n for _, n, _ in lists], "best": Best(len(lists), k if bands else k + 1)}
                else:
                    (banded if bands else nearest)(asked, ids, null, labels, v, k)
        if asked:
            yield told()

    return met.mapInArrow(solve, "q long, at int, id long, score long, same boolean")


def nearest(asked: dict, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int) -> None:
    """Adds a block's best k + 1 rows of each query."""
    most, found = min(k + 1, len(ids)), []
    for at in range(0, len(asked["v"]), 128):
        scores = Scores(asked["v"][at : at + 128], v, ids, null)
        row, score = scores.opened(np.partition(scores.key, len(ids) - most, axis=1)[:, len(ids) - most :])
        found.append((row, score))
    row, score = (np.concatenate(p) for p in zip(*found))
    own = slice(None), None
    same = ~asked["null"][own] & ~null[row] & (asked["ids"][own] == ids[row])
    for r, c in zip(*np.nonzero(same)):
        a, b = same_width(asked["v"][r : r + 1], v[row[r, c]][None, :])
        same[r, c] = bool((a == b).all()) and asked["labels"][r] == labels[row[r, c]]
    asked["best"].add(score, ids[row], null[row], same, np.zeros_like(same))


def banded(asked: dict, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int) -> None:
    """Adds a block's best k rows of other labels in the band of each score wanted."""
    lists, n = asked["lists"], len(ids)
    picked, scored, none = np.zeros((len(lists), k), np.int64), np.zeros((len(lists), k), np.int64), np.ones((len(lists), k), dtype=bool)
    at = 0
    for first in range(0, len(asked["v"]), 128):
        scores = Scores(asked["v"][first : first + 128], v, ids, null)
        least = np.iinfo(np.int64).min
        scores.key[asked["labels"][first : first + 128][:, None] == labels[None, :]] = least
        scores.key.sort(axis=1)
        while at < len(lists) and lists[at][0] < first + 128:
            r, _, (low, high) = lists[at]
            if low <= high:
                line, (bottom, top) = scores.key[r - first], scores.edges(low, high)
                end = int(np.searchsorted(line, top, side="right"))
                keys = line[max(0, end - k) : end]
                keys = keys[(keys >= bottom) & (keys != least)]
                if len(keys):
                    picked[at, : len(keys)], scored[at, : len(keys)] = scores.opened(keys)
                    none[at, : len(keys)] = False
            at += 1
    asked["best"].add(scored, ids[picked] if n else picked, null[picked] if n else none, np.zeros_like(none), none)


def numbered(rows: DataFrame, every: int, cells: Cells, name: str) -> DataFrame:
    """The distinct queries of rows, each with a number q, its cell as a query and how many times it is there."""
    found = rows.where(F.col("id") % every == 0).groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("times"))
    return materialize(cells.deal(found, queries=True).drop("far").withColumn("q", F.monotonically_increasing_id()), name, "zstd")


def without_own(found: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, score): the best k of each query once one row that is its own is left out."""
    own = F.row_number().over(W.partitionBy("q", "same").orderBy("id"))
    found = found.withColumn("own", own).where(~F.col("same") | (F.col("own") > 1))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id", "score")


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, every: int = 50, pivots: int | None = None, fit: int = 4096, group: int = 1024) -> DataFrame:
    """The k rows with the highest inner product for each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`; candidates are all rows
    but the query's own. Pivots, by default one for each 1,024 rows, 16 at least and 2,048 at most, part the rows into
    cells (see Cells), and the queries into groups of about `group` of neighbouring cells. Each cell's summary has its
    radius and its k + 1 members nearest to the pivot: they bound the distance of each query's k-th best row, and only
    the cells that come nearer than that for some query of a group are replicated to it, in blocks of about UNIT rows.
    A task joins a group with a fixed number of blocks, one at a time; the best of several tasks are merged.

    Ids are whole numbers. Vectors that are null or have null or non-finite components take no part; empty ones count as
    zeros, and shorter ones as filled up with zeros. Ties go to the smaller id, null last. Repeated rows are rows: of rows
    equal to the query only one is its own; a query that is there twice is answered twice. Where products are too large
    for doubles nothing is pruned and Python's whole numbers are taken; beyond a long they stop at its end. An empty
    table gives an empty result. Other columns are not read.
    """
    base = materialize(whole_vectors(rows.withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col, scale), "knn-vectors", "zstd")
    cells = Cells(base, pivots, fit)
    dealt = materialize(cells.deal(base), "knn-cells", "zstd").withColumn("part", F.lit(0))
    queries = numbered(dealt, every, cells, "knn-queries").withColumn("part", F.lit(0)).withColumn("wants", F.lit(None).cast("array<long>"))
    best = without_own(served(dealt, queries, cells, k, group, "knn"), k)
    best = best.join(queries.select("q", F.col("id").alias("query_id"), "times"), "q").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label=None, positives: int = 5, negatives: int = 10, scale: float = 256.0, every: int = 100, pivots: int | None = None, fit: int = 4096, group: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows that are hard to tell apart.

    Components become floor(scale * x), a score is an inner product. Anchors are the rows whose id is divisible by
    `every`. An anchor's positives are its `positives` best other rows of the same label; for each of them the result has
    the `negatives` best rows of other labels whose score lies from 30 to 90 per cent of the positive's. Both are Voronoi
    joins (see top_k): for positives the cells are those of each label; for negatives a cell can serve an anchor if its
    shell of distances meets the band, as far as the k-th of the rows that must lie in the band. Hot cells and hot labels
    are cut into blocks, and a task holds one group of anchors and one block.

    `label` is a column of whole numbers, by default the one of that name. Rows with a null label, a null vector, or a null or
    non-finite component take no part. Ids are whole numbers, null ids are no anchors and come last in ties. Repeated
    rows are rows: equal positives each get their negatives, and an anchor that is there twice is answered twice. Scores
    of zero or less: a band of a score of zero holds zero alone, that of a negative one nothing. Empty and shorter
    vectors count as filled up with zeros. Very large components and empty tables are as in top_k; other columns are not
    read.
    """
    label = (F.col("label") if label is None else label).cast("long")
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("v")).where("label is not null")
    base = materialize(whole_vectors(kept, "id", "v", scale, label=F.col("label")), "hard-vectors", "zstd")
    cells = Cells(base, pivots, fit)
    dealt = materialize(cells.deal(base), "hard-cells", "zstd")
    anchors = numbered(dealt, every, cells, "hard-anchors")
    none = F.lit(None).cast("array<long>")
    found = served(dealt.withColumn("part", F.col("label")), anchors.withColumn("part", F.col("label")).withColumn("wants", none), cells, positives, group, "positives")
    near = materialize(without_own(found, positives), "positives")
    listed = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("list"))  # `positives` entries
    asking = anchors.join(listed.select("q", F.col("list.score").alias("wants")), "q").withColumn("part", F.lit(0))
    hard = served(dealt.withColumn("part", F.lit(0)), asking, cells, negatives, group, "negatives", bands=True)
    rank = F.row_number().over(W.partitionBy("q", "at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("q", (F.col("at") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near.select("q", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["q", "place"])
    out = out.join(anchors.select("q", F.col("id").alias("anchor_id"), "times"), "q").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)
