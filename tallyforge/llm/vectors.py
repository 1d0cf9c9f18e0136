"""Exact pairs of near-equal vectors by cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small_batches
from .simhash import forest

#: Vectors in one unit of work.
UNIT = 8192


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of float64 from a column of packed vectors; shorter ones are filled up with zeros."""
    raw = [np.frombuffer(x.as_buffer(), dtype="<f8") if isinstance(x, pa.Scalar) else np.frombuffer(x, dtype="<f8") for x in column]
    width = max(map(len, raw), default=0)
    if all(len(r) == width for r in raw):
        return np.array(raw, dtype=np.float64).reshape(len(raw), width)
    return np.array([np.concatenate((r, np.zeros(width - len(r)))) for r in raw])


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) if x.shape[1] < w else x for x in (a, b))


def packed(rows: DataFrame, id_col: str, vector_col: str, how) -> DataFrame:
    """(id, v binary): vectors of doubles without null or non-finite components, changed by `how` (null: left out)."""

    def each(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = None if x is None or any(c is None for c in x) else np.array(x, dtype=np.float64)
                v = how(v) if v is not None and np.isfinite(v).all() else None
                out.append(None if v is None else v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, v binary")


def unit_length(v: np.ndarray) -> np.ndarray | None:
    most = np.abs(v).max(initial=0.0)
    if not most:
        return None
    v = v / most  # no overflow in the squares
    return v / np.sqrt((v * v).sum())


class CoverTree:
    """Nested levels over rows of x: each node covers a run of `order`, and a child's cover is half its parent's radius.

    The rows have length 1. A node's centre is one of its rows, and its radius the largest distance from there to any of
    its rows, so bounds are tight. Levels go on until a node has one row or a radius under `floor`; on scattered rows they
    are few and wide, as most nodes of a level have one row. The arrays are all there is of the tree, so it can travel.
    """

    FIELDS = (("order", "<i4"), ("center", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("kid", "<i4"), ("kids", "<i4"), ("radius", "<f8"))

    def __init__(self, x: np.ndarray, floor: float = 0.08):
        self.x, n = x, len(x)
        self.order = np.arange(n)
        center, begin, end, kid, kids, radius = [0], [0], [n], [0], [0], [self._far(self.order, 0) if n else 0.0]
        todo = [(0, 2.0)]
        while todo:
            node, cover = todo.pop()
            first, last = begin[node], end[node]
            if last - first < 2 or radius[node] <= floor:
                continue
            half = min(cover, radius[node]) / 2
            rows = self.order[first:last]
            where = self._net(rows, center[node], half)
            by = np.argsort(where, kind="stable")
            self.order[first:last] = rows = rows[by]
            cuts = np.flatnonzero(np.diff(where[by])) + 1
            starts, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(rows)]
            kid[node], kids[node] = len(center), len(starts)
            for a, b in zip(starts, stops):
                c = int(self.centers[where[by[a]]])
                if b - a > 1:
                    todo.append((len(center), half))
                center.append(c)
                begin.append(first + a)
                end.append(first + b)
                kid.append(0)
                kids.append(0)
                radius.append(self._far(rows[a:b], c) if b - a > 1 else 0.0)
        self.center, self.begin, self.end, self.kid, self.kids = (np.array(v, dtype=np.int64) for v in (center, begin, end, kid, kids))
        self.radius = np.array(radius)

    def _far(self, rows: np.ndarray, center: int) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * float((self.x[rows] @ self.x[center]).min())))) + 1e-7

    def _net(self, rows: np.ndarray, first: int, half: float, block: int = 256) -> np.ndarray:
        """A net of centres over half apart, the parent's own among them, and for each row the number of its nearest one.

        Rows are taken as they stand, a block at a time: those of a block that are apart become centres, and all rows
        within half of these are covered.
        """
        least = 1 - half * half / 2
        where, best = np.full(len(rows), -1), np.full(len(rows), -np.inf)
        self.centers = np.empty(0, np.int64)
        left = np.argsort(rows != first, kind="stable")
        while len(left):
            own = self.x[rows[left[:block]]]
            close, picked, held = own @ own.T >= least, [], np.zeros(len(own), dtype=bool)
            for i in range(len(own)):
                if not held[i]:
                    picked.append(i)
                    held |= close[i]
            new = rows[left[picked]]
            dots = self.x[rows[left]] @ self.x[new].T
            near = dots.argmax(axis=1)
            near[picked] = np.arange(len(picked))  # a row that equals an earlier centre is covered, no centre
            dots = dots[np.arange(len(left)), near]
            dots[picked] = 2.0
            better = (dots >= least) & (dots > best[left])
            where[left[better]], best[left[better]] = near[better] + len(self.centers), dots[better]
            self.centers = np.concatenate((self.centers, new))
            left = left[where[left] < 0]
        return where

    def depth(self) -> int:
        level = np.zeros(len(self.center), dtype=np.int64)
        for node in np.flatnonzero(self.kids):  # parents stand before their children
            level[self.kid[node] : self.kid[node] + self.kids[node]] = level[node] + 1
        return int(level.max(initial=0))

    def packed(self) -> bytes:
        return b"".join(np.int64(len(v)).tobytes() + v.tobytes() for v in (np.ascontiguousarray(getattr(self, k).astype(t)) for k, t in self.FIELDS))

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> CoverTree:
        self, at = cls.__new__(cls), 0
        self.x = x
        for k, t in cls.FIELDS:
            n, size = int(np.frombuffer(data, np.int64, 1, at)[0]), np.dtype(t).itemsize
            setattr(self, k, np.frombuffer(data, t, n, at + 8).astype(np.float64 if t == "<f8" else np.int64))
            at += 8 + n * size
        return self


class DualWalk:
    """Walks two trees (or one with itself) together and finds all rows with inner product at least `least`.

    A pair of nodes is dropped when the distance of its centres, less both radii, is over the distance that belongs to the
    threshold; it is taken whole, as a block of links, when that distance with both radii is under it; else the children
    are paired. Many small pairs are worked on side by side, large ones by products of their children's centres. `whole`
    counts pairs of rows that were taken as blocks, `compared` those whose product was formed, be it as two nodes of one
    row each or as rows of two leaves; all others of `total` were dropped by a bound on larger nodes.
    """

    def __init__(self, a: CoverTree, b: CoverTree | None, least: float):
        self.a, self.own, self.least = a, b is None, least
        self.b = a if b is None else b
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
        self.whole = self.compared = 0
        self.total = len(a.x) * (len(a.x) - 1) // 2 if self.own else len(a.x) * len(self.b.x)

    def __iter__(self):
        """Yields ("rows", p, q), arrays of linked rows (of one tree: p < q), and ("block", i, j), nodes linked throughout."""
        a, b = self.a, self.b
        if not len(a.x) or not len(b.x):
            return
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
        while stack:
            i, j, counted = stack.pop()
            if len(i) > 1 << 16:
                half = len(i) // 2
                stack += [(i[:half], j[:half], counted), (i[half:], j[half:], counted)]
                continue
            dots = np.einsum("ij,ij->i", a.x[a.center[i]], b.x[b.center[j]])
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            same = (i == j) if self.own else np.zeros(len(i), dtype=bool)
            gap[same] = 0.0
            radii = a.radius[i] + b.radius[j]
            size_a, size_b = a.end[i] - a.begin[i], b.end[j] - b.begin[j]
            if not counted:
                self.compared += int(((size_a == 1) & (size_b == 1) & ~same).sum())
            pairs = np.where(same, size_a * (size_a - 1) // 2, size_a * size_b)
            far = ~same & (gap - radii > self.reach + 1e-7)
            whole = ~far & (gap + radii < self.reach - 1e-7) & (pairs > 1)
            self.whole += int(pairs[whole].sum())
            for p, q in zip(i[whole].tolist(), j[whole].tolist()):
                yield "block", p, q
            rest = ~far & ~whole & (pairs > 0)
            i, j, same = i[rest], j[rest], same[rest]
            leaf = (a.kids[i] == 0) & (b.kids[j] == 0)
            if leaf.any():
                yield from self._rows(i[leaf], j[leaf])
            i, j, same = i[~leaf], j[~leaf], same[~leaf]
            wide = np.maximum(a.kids[i], 1) * np.maximum(b.kids[j], 1) > 2048
            for p, q in zip(i[wide].tolist(), j[wide].tolist()):
                stack += self._kids(p, q)
            if not wide.all():
                stack.append((*self._spread(i[~wide], j[~wide], same[~wide]), False))

    def _spread(self, i: np.ndarray, j: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of pairs of nodes; a leaf stands for its children, and of a node with itself each pair once."""
        a, b = self.a, self.b
        na, nb = np.maximum(a.kids[i], 1), np.maximum(b.kids[j], 1)
        first_a, first_b = np.where(a.kids[i] > 0, a.kid[i], i), np.where(b.kids[j] > 0, b.kid[j], j)
        n = na * nb
        at = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        p, q = first_a[at] + k // nb[at], first_b[at] + k % nb[at]
        once = ~same[at] | (p <= q)
        return p[once], q[once]

    def _kids(self, i: int, j: int, block: int = 512) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Pairs of children of two wide nodes that the bound keeps, by blocks of products; those of two rows are counted."""
        a, b = self.a, self.b
        mine = np.arange(a.kid[i], a.kid[i] + a.kids[i]) if a.kids[i] else np.array([i])
        other = np.arange(b.kid[j], b.kid[j] + b.kids[j]) if b.kids[j] else np.array([j])
        own = self.own and i == j
        out = []
        parts, others = ((x[t.radius[x] == 0], x[t.radius[x] > 0]) for x, t in ((mine, a), (other, b)))  # single rows have one bound
        for k, x in enumerate(parts):
            for m, y in enumerate(others):
                if own and k > m or not len(x) or not len(y):
                    continue
                for at in range(0, len(x), block):
                    p, q = x[at : at + block], y[at:] if own and k == m else y
                    edge = self.reach + 1e-7
                    if k or m:
                        edge = np.minimum(2.0, edge + a.radius[p][:, None] + b.radius[q][None, :])
                    near = a.x[a.center[p]] @ b.x[b.center[q]].T >= 1 - edge * edge / 2 - 1e-12
                    if own and k == m:
                        near[:, : len(p)] = np.triu(near[:, : len(p)])
                    ones = k == 0 and m == 0
                    if ones:
                        n = (a.end[p] - a.begin[p] == 1).sum() * (b.end[q] - b.begin[q] == 1).sum()
                        self.compared += int(n - len(p) * (len(p) + 1) // 2) if own else int(n)
                    r, c = np.nonzero(near)
                    if len(r):
                        out.append((p[r], q[c], ones))
        return out

    def _rows(self, i: np.ndarray, j: np.ndarray, most: int = 1 << 18):
        """Rows of pairs of leaves, compared in double precision."""
        a, b = self.a, self.b
        n = (a.end[i] - a.begin[i]) * (b.end[j] - b.begin[j])
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1).tolist(), len(n)]
        for x, y in zip(cut, cut[1:]):
            if x == y:
                continue
            at = np.repeat(np.arange(x, y), n[x:y])
            k = np.arange(len(at)) - np.repeat(np.cumsum(n[x:y]) - n[x:y], n[x:y])
            wide = (b.end[j] - b.begin[j])[at]
            for z in range(0, len(at), most):  # two leaves of many rows
                t = slice(z, z + most)
                p, q = a.order[a.begin[i[at[t]]] + k[t] // wide[t]], b.order[b.begin[j[at[t]]] + k[t] % wide[t]]
                if self.own:
                    keep = (i[at[t]] != j[at[t]]) | (p < q)
                    p, q = np.minimum(p, q)[keep], np.maximum(p, q)[keep]
                self.compared += int((n[at[t]] > 1).sum())
                good = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= self.least
                if good.any():
                    yield "rows", p[good], q[good]


def linked(walk: DualWalk, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, low) of the rows of a walk, those of a second tree after those of the first.

    links: summed weights n of the rows that each row links to; low: the smallest row reachable. Blocks of links cost as
    much as they have rows, not pairs.
    """
    a, b = walk.a, walk.b
    shift = 0 if walk.own else len(a.x)
    links, edges_a, edges_b, tied = np.zeros(len(n), dtype=np.int64), [], [], set()

    def tie(tree, node, shift):
        rows = tree.order[tree.begin[node] : tree.end[node]] + shift
        if (shift, node) not in tied:
            tied.add((shift, node))
            edges_a.append(rows[1:])
            edges_b.append(np.full(len(rows) - 1, rows[0]))
        return rows

    for kind, i, j in walk:
        if kind == "rows":
            q = j + shift
            np.add.at(links, i, n[q])
            np.add.at(links, q, n[i])
            edges_a.append(i)
            edges_b.append(q)
        elif walk.own and i == j:
            rows = tie(a, i, 0)
            links[rows] += n[rows].sum() - n[rows]
        else:
            mine, other = tie(a, i, 0), tie(b, j, shift)
            links[mine] += n[other].sum()
            links[other] += n[mine].sum()
            edges_a.append(mine[:1])
            edges_b.append(other[:1])
    found = [(np.concatenate(edges_a), np.concatenate(edges_b))] if edges_a else []
    return links, forest(len(n), found)


def near_pairs(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, cells: int | None = None, fit: int = 4096, unit: int = 2 * UNIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs of rows with cosine >= least.

    Equal directions are one vertex with a weight. The upper levels come from a cover tree over at most `fit` vectors
    (those with the smallest hashes): `cells` of its nodes, by default one for each two units and 1,024 at most. Every
    vector goes to the nearest, which makes the covering radii, taken over all vectors. A cell is cut into units of about
    `unit` vectors, each with a cover tree of its own, built once. Pairs of cells that the radii don't part meet, unit by
    unit, in tasks that walk the two trees together. A task returns sums of links and a spanning forest, not the pairs.

    Null, zero, empty and non-finite vectors link with nothing; they are components of their own. Vectors of different
    length compare as if filled up with zeros. Null ids take part; repeated rows link with each other. component_id is
    the smallest id that is not null of a component. An empty table gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    every = materialize(packed(rows, id_col, vector_col, unit_length).withColumn("c", F.md5("v")), "vectors")
    known = every.where("v is not null").groupBy("c").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    # a vertex's name begins with its smallest id, so the smallest name of a component has that of the component
    known = materialize(known.select(F.struct(F.col("low").isNull().alias("none"), "low", "c").alias("name"), "n", "v"), "vectors-distinct")
    name_type, count = known.schema["name"].dataType.simpleString(), known.count()
    some = known.orderBy("name.c").select("v").limit(fit).collect()  # fit rows
    centers = upper_nodes(matrix([r["v"] for r in some]), cells or max(1, min(1024, count // (2 * unit)))) if some else np.zeros((1, 1))

    def assign(batches):
        for batch in batches:
            v, c = _same_width(matrix(batch.column(2)), centers)
            out, far = np.zeros(len(v), dtype=np.int32), np.zeros(len(v))
            if len(v):
                d = np.maximum(0.0, (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * v @ c.T)
                out = d.argmin(axis=1).astype(np.int32)
                far = np.sqrt(((v - c[out]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(far)], names=["name", "n", "v", "cell", "far"])

    dealt = materialize(known.mapInArrow(assign, f"name {name_type}, n long, v binary, cell int, far double"), "vectors-cells")
    stats = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("units"), F.max("far").alias("far"))  # cells rows
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-7
    index = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, at array<double>")
    there = stats.join(F.broadcast(index), "cell")
    left, right = there.select(*(F.col(c).alias(f"{c}_l") for c in there.columns)), there.select(*(F.col(c).alias(f"{c}_r") for c in there.columns))
    gap = F.sqrt(F.aggregate(F.zip_with("at_l", "at_r", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = left.join(F.broadcast(right), (F.col("cell_l") <= F.col("cell_r")) & ((F.col("cell_l") == F.col("cell_r")) | (gap <= F.col("far_l") + F.col("far_r") + reach)))  # summaries of cells
    met = met.select("cell_l", "cell_r", F.explode(F.sequence(F.lit(0), F.col("units_l") - 1)).alias("unit_l"), "units_r").select("cell_l", "unit_l", "cell_r", F.explode(F.sequence(F.lit(0), F.col("units_r") - 1)).alias("unit_r"))
    met = met.where("cell_l <> cell_r or unit_l <= unit_r")
    same = (F.col("cell_l") == F.col("cell_r")) & (F.col("unit_l") == F.col("unit_r"))
    pair = F.struct("cell_l", "unit_l", "cell_r", "unit_r")
    first = F.struct(F.col("cell_l").alias("cell"), F.col("unit_l").alias("unit"), F.lit(False).alias("right"))
    second = F.struct(F.col("cell_r").alias("cell"), F.col("unit_r").alias("unit"), F.lit(True).alias("right"))
    sides = met.select(pair.alias("pair"), F.inline(F.when(same, F.array(first)).otherwise(F.array(first, second))))
    numbered = dealt.join(F.broadcast(stats.select("cell", "units")), "cell").withColumn("unit", F.pmod(F.xxhash64("name.c"), F.col("units")).cast("int"))

    def grow(table):
        x = matrix(table.column("v").combine_chunks())
        return pa.table({"cell": table.column("cell")[:1], "unit": table.column("unit")[:1], "names": pa.array([table.column("name").to_pylist()], pa.list_(table.schema.field("name").type)), "n": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), "v": pa.array([x.astype("<f8").tobytes()]), "tree": pa.array([CoverTree(x).packed()])})

    units = materialize(numbered.groupBy("cell", "unit").applyInArrow(grow, f"cell int, unit int, names array<{name_type}>, n array<long>, v binary, tree binary"), "vector-units")
    dealt_out = units.join(F.broadcast(sides) if count <= 256 * unit else sides, ["cell", "unit"]).select("pair", "right", "names", "n", "v", "tree")

    def solve(table):
        def ready(part):
            row = part.slice(0, 1).to_pylist()[0]
            x = np.frombuffer(row["v"], "<f8").reshape(len(row["n"]), -1)
            return row["names"], x, np.array(row["n"], dtype=np.int64), row["tree"]

        right = table.column("right").to_numpy()
        c, x, n, tree = ready(table.filter(pa.array(~right)))
        if right.any():
            c2, y, n2, tree2 = ready(table.filter(pa.array(right)))
            x, y = _same_width(x, y)
            c, n = c + c2, np.concatenate((n, n2))
            walk = DualWalk(CoverTree.unpacked(x, tree), CoverTree.unpacked(y, tree2), least)
        else:
            walk = DualWalk(CoverTree.unpacked(x, tree), None, least)
        links, low = linked(walk, n)
        some, ties = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(low)))
        kind = table.schema.field("names").type.value_type
        columns = [[c[i] for i in some] + [c[i] for i in ties], [None] * len(some) + [c[i] for i in low[ties]], [*links[some].tolist(), *[0] * len(ties)]]
        return pa.table([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=["a", "b", "n"])

    found = materialize(dealt_out.groupBy("pair").applyInArrow(solve, f"a {name_type}, b {name_type}, n long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a.c").alias("c")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).select(F.col("node.c").alias("c"), F.col("component.low").alias("component_id"))
    groups = known.select("name.c", "name.low", "n").join(links, "c", "left").join(joined, "c", "left")
    groups = groups.select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    out = every.select("id", "c").join(groups, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def upper_nodes(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most `cells` nodes of a cover tree: the largest node that can be opened gives way to its children."""
    tree = CoverTree(x)
    picked = [0]
    while True:
        open_ = [k for k in picked if tree.kids[k] and len(picked) - 1 + tree.kids[k] <= cells]
        if not open_:
            break
        k = max(open_, key=lambda k: tree.end[k] - tree.begin[k])
        picked.remove(k)
        picked += range(tree.kid[k], tree.kid[k] + tree.kids[k])
    if len(picked) == 1 and tree.kids[0]:  # a scattered level is wider than that: its largest nodes
        kids = np.arange(tree.kid[0], tree.kid[0] + tree.kids[0])
        picked = kids[np.argsort(tree.begin[kids] - tree.end[kids], kind="stable")][:cells].tolist()
    return x[tree.center[picked]]


def op1(spark, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
