"""Lloyd's rounds by two trees: a cover tree over each block of vectors, and one over the centroids of the round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .whole import dense, whole_vectors

#: Components below this make squared distances and sums that doubles hold exactly.
NARROW = 2.0**22
LIMB = 10**9


class Cover:
    """A cover tree: each node covers a run of `order` around a row of its own, and its children's radii are at most half its.

    A node of more than `leaf` rows is opened when a net of half its radius has far fewer centres than the node has rows.
    Otherwise its rows are scattered, halving would only give single rows, and it stays a leaf.
    """

    FIELDS = ("order", "center", "begin", "end", "kid", "kids")

    def __init__(self, x: np.ndarray, leaf: int = 16):
        self.x, self.sq, n = x, (x * x).sum(axis=1), len(x)
        self.order = np.arange(n)
        nodes = [[0, 0, n, 0, 0, self._far(self.order, 0) if n else 0.0]]  # center, begin, end, kid, kids, radius
        todo = [0]
        while todo:
            node = nodes[todo.pop()]
            first, last = node[1:3]
            if last - first <= leaf or not node[5]:
                continue
            rows = self.order[first:last]
            net = self._net(rows, node[0], node[5] / 2, 1 if leaf == 1 else 4)
            if net is None:
                continue
            where, centers = net
            by = np.argsort(where, kind="stable")
            self.order[first:last] = rows = rows[by]
            cuts = [0, *(np.flatnonzero(np.diff(where[by])) + 1).tolist(), len(rows)]
            node[3:5] = len(nodes), len(cuts) - 1
            for a, b in zip(cuts, cuts[1:]):
                todo.append(len(nodes))
                c = int(centers[where[by[a]]])
                nodes.append([c, first + a, first + b, 0, 0, self._far(rows[a:b], c)])
        self.center, self.begin, self.end, self.kid, self.kids = (np.array(v, dtype=np.int64) for v in list(zip(*nodes))[:5])
        self.radius = np.array([v[5] for v in nodes])

    def _far(self, rows: np.ndarray, center: int) -> float:
        gap = self.x[rows] - self.x[center]
        return float(np.sqrt((gap * gap).sum(axis=1).max()))

    def _net(self, rows: np.ndarray, first: int, half: float, share: int, block: int = 256):
        """For each row the number of the nearest centre of a net over `half` apart, and the centres; None if it is too wide."""
        where, best, centers = np.full(len(rows), -1), np.full(len(rows), np.inf), np.empty(0, np.int64)
        left = np.argsort(rows != first, kind="stable")
        while len(left):
            own = rows[left[:block]]
            close = self.sq[own][:, None] + self.sq[own][None, :] - 2 * self.x[own] @ self.x[own].T <= half * half
            picked, held = [], np.zeros(len(own), dtype=bool)
            for i in range(len(own)):
                if not held[i]:
                    picked.append(i)
                    held |= close[i]
            new = own[picked]
            if len(centers) + len(new) > max(2, len(rows) // share):
                return None
            gaps = self.sq[rows][:, None] + self.sq[new][None, :] - 2 * self.x[rows] @ self.x[new].T
            near = gaps.argmin(axis=1)
            gaps = gaps[np.arange(len(rows)), near]
            better = (gaps <= half * half) & (gaps < best)
            where[better], best[better] = near[better] + len(centers), gaps[better]
            centers = np.concatenate((centers, new))
            left = left[where[left] < 0]
        return where, centers

    def packed(self) -> bytes:
        parts = [getattr(self, k).astype("<i4") for k in self.FIELDS] + [self.radius.astype("<f8")]
        return b"".join(np.int64(len(v)).tobytes() + v.tobytes() for v in parts)

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> Cover:
        self, at = cls.__new__(cls), 0
        self.x, self.sq = x, (x * x).sum(axis=1)
        for k in (*cls.FIELDS, "radius"):
            n, kind = int(np.frombuffer(data, np.int64, 1, at)[0]), np.dtype("<f8" if k == "radius" else "<i4")
            setattr(self, k, np.frombuffer(data, kind, n, at + 8).astype(np.float64 if k == "radius" else np.int64))
            at += 8 + n * kind.itemsize
        return self


class DualWalk:
    """The nearest centroid of each row (ties: the smaller number), by a walk over pairs of nodes of two cover trees.

    Of a node of vectors some centroid lies within the distance of the two centres and the node's radius, for the nearest
    node of centroids; a node of centroids that is farther by both radii can serve none of its rows and is pruned with
    all below it. A node of vectors that keeps one centroid goes to it as a whole, rows of leaves are compared exactly
    with those that are kept, other nodes are opened with what they keep. `products` counts inner products that were
    formed, of centres and of rows; a plain round forms rows x centroids.
    """

    def __init__(self, tree: Cover, centroids: Cover):
        self.tree, self.centroids = tree, centroids
        self.products = 0
        self.slack = 1e-6 * (1 + np.sqrt(max(tree.sq.max(initial=0.0), centroids.sq.max(initial=0.0))))

    def _gaps(self, rows: np.ndarray, cents: np.ndarray) -> np.ndarray:
        t, c = self.tree, self.centroids
        self.products += len(rows) * len(cents)
        return np.sqrt(np.maximum(0.0, t.sq[rows][:, None] + c.sq[cents][None, :] - 2 * t.x[rows] @ c.x[cents].T))

    def _prune(self, nodes: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """What each node of vectors keeps of its centroids `alive`, by levels of the tree over the centroids."""
        t, c = self.tree, self.centroids
        radius = t.radius[nodes][:, None]
        level, kept, reach = np.zeros(1, np.int64), np.ones((len(nodes), 1), dtype=bool), np.full((len(nodes), 1), np.inf)
        ends, gaps_of = np.zeros_like(alive), np.full(alive.shape, np.inf)
        while len(level):
            gaps = self._gaps(t.center[nodes], c.center[level])
            reach = np.minimum(reach, gaps.min(axis=1, keepdims=True) + radius)
            kept &= gaps - radius - c.radius[level][None, :] <= reach + self.slack
            for at, node in enumerate(level.tolist()):
                if not c.kids[node]:
                    own = c.order[c.begin[node] : c.end[node]]
                    ends[:, own], gaps_of[:, own] = kept[:, at : at + 1], (gaps[:, at] - c.radius[node])[:, None]
            again = [(at, kid) for at, node in enumerate(level.tolist()) for kid in range(c.kid[node], c.kid[node] + c.kids[node]) if kept[:, at].any()]
            level, kept = np.array([k for _, k in again], dtype=np.int64), kept[:, [a for a, _ in again]]
        return alive & ends & (gaps_of - radius <= reach + self.slack)

    def assign(self) -> np.ndarray:
        t, c = self.tree, self.centroids
        out = np.zeros(len(t.x), dtype=np.int32)
        nodes, alive = np.zeros(min(1, len(t.x)), np.int64), np.ones((min(1, len(t.x)), len(c.x)), dtype=bool)
        while len(nodes):
            alive = self._prune(nodes, alive)
            sure = alive.sum(axis=1) == 1
            for node, one in zip(nodes[sure].tolist(), alive[sure].argmax(axis=1).tolist()):
                out[t.order[t.begin[node] : t.end[node]]] = one
            leaf = ~sure & (t.kids[nodes] == 0)
            self._rows(nodes[leaf], alive[leaf], out)
            nodes, alive = nodes[~sure & ~leaf], alive[~sure & ~leaf]
            n = t.kids[nodes]
            first = np.cumsum(n) - n
            nodes, alive = np.repeat(t.kid[nodes] - first, n) + np.arange(n.sum()), np.repeat(alive, n, axis=0)
        return out

    def _rows(self, nodes: np.ndarray, alive: np.ndarray, out: np.ndarray, most: int = 4096) -> None:
        """Rows of leaves, each against the centroids its leaf keeps: whole numbers, so ties are exact."""
        t, c = self.tree, self.centroids
        n = t.end[nodes] - t.begin[nodes]
        rows = t.order[np.repeat(t.begin[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        alive = np.repeat(alive, n, axis=0)
        for at in range(0, len(rows), most):
            own, keep = rows[at : at + most], alive[at : at + most]
            some = np.flatnonzero(keep.any(axis=0))
            self.products += len(own) * len(some)
            d = np.where(keep[:, some], c.sq[some][None, :] - 2 * t.x[own] @ c.x[some].T, np.inf)
            out[own] = some[d.argmin(axis=1)]


def plain_assign(x: np.ndarray, cents: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Nearest centroids and squared distances in Python's whole numbers, for components too large for doubles."""
    own = np.array([[int(c) for c in r] for r in x], dtype=object).reshape(len(x), -1)
    gaps = np.array([((own - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in cents], dtype=object).reshape(len(cents), -1)
    where = np.array([min(range(len(cents)), key=lambda j, i=i: (gaps[j, i], j)) for i in range(len(x))], dtype=np.int32)
    return where, [gaps[j, i] for i, j in enumerate(where)]


def limbs(value: int, parts: int) -> list[int]:
    """A whole number as `parts` digits of base LIMB with its sign, or as it is for one part."""
    if parts == 1:
        return [value]
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    for _ in range(parts):
        value, digit = divmod(value, LIMB)
        out.append(sign * digit)
    return out


def centroid_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, seed: str = "2:", cells: int | None = None, fit: int = 4096, unit: int = 4096) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of `width` finite components.

    Components become floor(scale * x). Centroids start as the k vectors with the smallest sha256 of seed and id, null ids
    last, equal hashes by components. Vectors are dealt once to cells of near ones (pivots from at most `fit` vectors, the
    smallest hashes; every vector is assigned) and to units of about `unit` vectors, a large cell to several by hash; each
    unit has a cover tree that serves all rounds. A round reads the units, walks each tree with that of the centroids and
    returns one sum for each centroid and component from every task; the driver gets k x width sums.

    Other vectors are left out. Repeated rows are rows; if two of them are among the first k, the second stays empty.
    With fewer than k vectors there are as many centroids as vectors. An empty table gives an empty result, and columns
    of other names are not read. Components of 2^22 and more take Python's whole numbers instead of the trees, and
    distances and sums beyond the range of a long are reported as its end.
    """
    spark = rows.sparkSession
    kept = whole_vectors(rows, id_col, vector_col, scale, width).select("id", "v")
    base = materialize(kept, "cluster-vectors", "zstd")
    id_type, end = base.schema["id"].dataType.simpleString(), (1 << 63) - 1
    named = base.withColumn("name", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256))
    first = [r["v"] for r in named.orderBy(F.col("name").asc_nulls_last(), "v").select("v").limit(k).collect()]  # k rows
    some = dense(pa.array([r["v"] for r in base.orderBy(F.xxhash64("v"), F.xxhash64("id")).select("v").limit(fit).collect()], pa.binary()))  # fit rows
    cents = [[int(c) for c in np.frombuffer(v, "<f8")] for v in first]

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(dense(batch.column(0))).max(initial=0.0))]), pa.array([batch.num_rows])], names=["most", "n"])

    found = base.select("v").mapInArrow(largest, "most double, n long").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
    most, count = found["most"] or 0.0, found["n"] or 0
    narrow = most < NARROW
    parts = 1 if narrow else len(str(int(most))) // 9 + 3  # room for sums of 10^18 rows
    pivots = some[:1] if len(some) else np.zeros((1, width))
    if narrow and count > unit:
        pivots = upper(some, cells or max(1, min(1024, count // (2 * unit))))

    def near(batches):
        for batch in batches:
            v = dense(batch.column(1))
            cell = ((pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T).argmin(axis=1) if len(v) and narrow else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    def grow(table):
        x = dense(table.column("v"))
        tree = Cover(x).packed() if narrow else b""
        return pa.table({"ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)), "v": pa.array([x.astype("<f8").tobytes()], pa.binary()), "tree": pa.array([tree], pa.binary())})

    dealt = materialize(base.mapInArrow(near, f"id {id_type}, v binary, cell int"), "cluster-cells", "zstd")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("units"))  # at most 1,024 rows
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("unit", F.pmod(F.xxhash64("id", "v"), F.col("units")).cast("int"))
    units = materialize(dealt.groupBy("cell", "unit").applyInArrow(grow, f"ids array<{id_type}>, v binary, tree binary"), "cluster-units", "zstd")
    small_batches(spark)

    def solved(batches, cents):
        """(ids, vectors, clusters, distances) of each unit; distances come as a function, as rounds need none."""
        own = np.array(cents, dtype=np.float64 if narrow else object).reshape(len(cents), width)
        over = Cover(own, leaf=1) if narrow else None
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), "<f8").reshape(-1, width)
                if narrow:
                    where = DualWalk(Cover.unpacked(x, batch.column(2)[i].as_py()), over).assign()
                    yield batch.column(0)[i], x, where, lambda x=x, where=where: ((x - own[where]) ** 2).sum(axis=1).astype(np.int64).tolist()
                else:
                    where, gaps = plain_assign(x, cents)
                    yield batch.column(0)[i], x, where, lambda gaps=gaps: [min(end, g) for g in gaps]

    for _ in range(rounds if cents else 0):

        def sums(batches, cents=cents):
            total = np.zeros((len(cents), width + 1), dtype=np.float64 if narrow else object)
            for _, x, where, _ in solved(batches, cents):
                by = np.argsort(where, kind="stable")
                there, starts = np.unique(where[by], return_index=True)
                total[there, 1:] += np.add.reduceat(x[by], starts, axis=0) if narrow else np.array([[sum(int(c) for c in col) for col in x[where == c].T] for c in there], dtype=object)
                total[there, 0] += np.diff([*starts.tolist(), len(by)])
            there = [c for c in range(len(cents)) if total[c, 0]]
            data = [[d for value in total[c].tolist() for d in limbs(int(value), parts)] for c in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(data, pa.list_(pa.int64()))], names=["cluster", "s"])

        each = units.mapInArrow(sums, "cluster int, s array<long>").select("cluster", F.posexplode("s").alias("at", "s"))
        got: dict[int, dict[int, int]] = {}
        for r in each.groupBy("cluster", "at").agg(F.sum("s").alias("s")).collect():  # k x (width + 1) rows
            got.setdefault(r["cluster"], {})[r["at"]] = r["s"]
        for c, found in got.items():
            whole = [sum(found[at * parts + i] * LIMB**i for i in range(parts)) for at in range(width + 1)]
            cents[c] = [s // whole[0] for s in whole[1:]]

    def last(batches):
        for ids, _, where, gaps in solved(batches, cents):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(where, pa.int32()), pa.array(gaps(), pa.int64())], names=["vec_id", "cluster", "distance"])

    out = materialize(units.mapInArrow(last, f"vec_id {id_type}, cluster int, distance long"), "clusters")
    total = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    inertia, names = sum(int(r["d"]) for r in total), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    facts = spark.createDataFrame([(r["cluster"], min(end, int(r["d"])), min(end, inertia), names[r["cluster"]]) for r in total], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def upper(x: np.ndarray, cells: int) -> np.ndarray:
    """Rows of x far apart, `cells` at most: each next one is the farthest from those before."""
    picked, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < cells and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def op11(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
