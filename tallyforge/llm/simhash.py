"""SimHash near-dedup: fingerprints of word shingles, and a self-join of their binary trie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, frugal, materialize, small_batches

MAX_BITS = 3
#: Depth of the trie's upper part, whose nodes are counted; at most 2 ** TOP counts are gathered.
TOP = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text; zero where it holds no word."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros((8, 256), dtype=np.int64)
    for i in range(0, len(hashes), 1 << 20):
        part = hashes[i : i + (1 << 20)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((part + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    over = (counts @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row; the text goes no further than the task that reads it."""

    def each(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(frugal(each), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def leaves(counts: dict[int, int], cap: int) -> list[tuple[int, int, int]]:
    """The upper trie cut where a node has at most cap fingerprints, or at TOP: (prefix, depth, count)."""
    out, keys = [], np.array(sorted(counts), dtype=np.int64)
    sums = np.concatenate(([0], np.cumsum([counts[int(k)] for k in keys])))
    stack = [(0, 0)]
    while stack:
        prefix, depth = stack.pop()
        a, b = np.searchsorted(keys, [prefix << (TOP - depth), (prefix + 1) << (TOP - depth)])
        n = int(sums[b] - sums[a])
        if n and (n <= cap or depth == TOP):
            out.append((prefix, depth, n))
        elif n:
            stack += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
    return sorted(out, key=lambda x: x[0] << (TOP - x[1]))


def leaf_pairs(nodes: list[tuple[int, int, int]], max_bits: int) -> list[tuple[int, int]]:
    """Pairs of leaves (i <= j) that the traversal from the root does not prune."""
    inner = {(0, 0)} | {(p >> k, d - k) for p, d, _ in nodes for k in range(1, d + 1)}
    leaf = {(p, d): i for i, (p, d, _) in enumerate(nodes)}
    kids = {x: [c for c in ((2 * x[0], x[1] + 1), (2 * x[0] + 1, x[1] + 1)) if c in leaf or c in inner] for x in inner if x not in leaf}
    out, stack = [], [((0, 0), (0, 0), 0)]
    while stack:
        a, b, wrong = stack.pop()
        if a in leaf and b in leaf:
            out.append((min(leaf[a], leaf[b]), max(leaf[a], leaf[b])))
        elif a == b:
            c = kids[a]
            stack += [(x, x, wrong) for x in c]
            if len(c) == 2 and wrong < max_bits:
                stack.append((c[0], c[1], wrong + 1))
        elif a in leaf or b in leaf:  # the leaf's lower bits are open: no bit is compared
            stack += [(a, x, wrong) for x in kids[b]] if a in leaf else [(x, b, wrong) for x in kids[a]]
        else:
            for x in kids[a]:
                for y in kids[b]:
                    if (w := wrong + ((x[0] ^ y[0]) & 1)) <= max_bits:
                        stack.append((x, y, w))
    return out


def links(a: np.ndarray, b: np.ndarray | None, max_bits: int, block: int = 1 << 17, stop: int = 0, settled: tuple[np.ndarray, np.ndarray] | None = None):
    """Yields arrays (i, j): positions in the sorted arrays a and b (None: a itself, i < j) at most max_bits apart.

    stop: the lowest bit that counts; those below are alike. settled, of one array alone: the group of each position, and
    where the run of equal groups from there ends; two nodes that lie in one group are not joined.

    Both tries are walked together, from the top bit down. A pair of nodes is a pair of ranges with the number of bits in
    which they differ so far; a pair beyond the budget is dropped, one of few values is compared at once. The frontier is
    cut into blocks that are finished one by one, so memory does not grow with the number of node pairs.
    """
    own = b is None
    b = a if own else b
    zeros = {}

    def split(side: int, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, bit) not in zeros:
            zeros[side, bit] = np.concatenate(([0], np.cumsum(((b if side else a) >> np.uint64(bit)) & np.uint64(1) == 0)))
        return lo + zeros[side, bit][hi] - zeros[side, bit][lo]

    stack = [(63, np.array([[0], [len(a)], [0], [len(b)], [0]], dtype=np.int64))]
    while stack:
        bit, now = stack.pop()
        if now.shape[1] > block:
            half = now.shape[1] // 2
            stack += [(bit, now[:, :half]), (bit, now[:, half:])]
            continue
        if settled is not None:
            name, run_end = settled
            now = now[:, (name[now[0]] != name[now[2]]) | (run_end[now[0]] < now[1]) | (run_end[now[2]] < now[3])]
        sizes = (now[1] - now[0]) * (now[3] - now[2])
        small = (sizes <= 64) | (bit < stop)
        if small.any():
            for part in _blocks(now[:, small], sizes[small], 1 << 22):
                yield from _compare(a, b, part, own, max_bits)
        now = now[:, ~small]
        if not now.shape[1]:
            continue
        am, bm = split(0, bit, now[0], now[1]), split(1, bit, now[2], now[3])
        a0, a1, b0, b1, wrong = now
        kids = [(a0, am, b0, bm, wrong), (am, a1, bm, b1, wrong), (a0, am, bm, b1, wrong + 1), (am, a1, b0, bm, wrong + 1)]
        if own:
            kids[3] = tuple(x[a0 != b0] for x in kids[3])  # a node with itself: its two halves meet once
        kids = np.concatenate([np.stack(k) for k in kids], axis=1)
        kids = kids[:, (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= max_bits)]
        if kids.shape[1]:
            stack.append((bit - 1, kids))


def _blocks(now: np.ndarray, sizes: np.ndarray, most: int):
    """Cuts node pairs into runs of about `most` comparisons."""
    at = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), now.shape[1]]
    for x, y in zip(edges, edges[1:]):
        if x < y:
            yield now[:, x:y]


def _compare(a, b, now, own, max_bits):
    na, nb = now[1] - now[0], now[3] - now[2]
    n = na * nb
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    i, j = now[0][pair] + k // nb[pair], now[2][pair] + k % nb[pair]
    near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
    if own:
        near &= i < j
    if near.any():
        yield i[near], j[near]


def forest(n: int, found) -> np.ndarray:
    """The smallest position reachable from each of n positions through the links."""
    low = np.arange(n)

    def settle(i, j):
        nonlocal low
        while True:
            li, lj = low[i], low[j]
            apart = li != lj
            if not apart.any():
                return
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            np.minimum.at(low, np.maximum(li, lj), np.minimum(li, lj))
            while (down := low[low] != low).any():
                low = low[low]
            del down

    for i, j in found:
        settle(i, j)
    return low


def trie_join(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = 16_384) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of fps (column fp) within max_bits, without every link.

    The bits are put in an order of balance first, which no distance depends on. Counts of the upper TOP bits (at most
    2 ** 16) give the upper trie; its leaves hold `leaf` fingerprints, or one in 2,048 of all where that is more, and a
    leaf at the lowest depth that is larger is cut into chunks that all meet. Leaves travel packed, one row each; the
    pairs that the traversal keeps are solved in a task each, which goes on down the two tries. A task returns a spanning forest: at most one edge for
    each fingerprint it got, however many links there are in a group of copies.
    """
    spark = fps.sparkSession
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
    sums = fps.agg(F.count(F.lit(1)).alias("n"), *(F.sum(bit(i)).alias(str(i)) for i in range(64))).first()
    n = sums["n"]
    order = sorted(range(64), key=lambda i: (abs(2 * (sums[str(i)] or 0) - n), i))
    top = sum((F.shiftleft(bit(order[k]), TOP - 1 - k) for k in range(1, TOP)), F.shiftleft(bit(order[0]), TOP - 1))
    keyed = fps.withColumn("top", top.cast("int"))
    counts = {r["top"]: r["count"] for r in keyed.groupBy("top").count().collect()}
    cap = max(leaf, n // 2048)
    nodes = leaves(counts, cap)
    chunks = [-(-c // (4 * cap)) for *_, c in nodes]  # units of a leaf
    first = np.concatenate(([0], np.cumsum(chunks))).tolist()
    pairs = []
    for i, j in leaf_pairs(nodes, max_bits):
        pairs += [(x, y) for x in range(first[i], first[i + 1]) for y in range(first[j], first[j + 1]) if i != j or x <= y]
    meets: dict[int, list[tuple[int, bool]]] = {}
    for k, (x, y) in enumerate(pairs):
        meets.setdefault(x, []).append((k, False))
        if x != y:
            meets.setdefault(y, []).append((k, True))
    of = [(t, first[i], chunks[i]) for i, (p, d, _) in enumerate(nodes) for t in range(p << (TOP - d), (p + 1) << (TOP - d)) if t in counts]
    of = spark.createDataFrame(of, "top int, first int, chunks int")
    sides = spark.createDataFrame(sorted(meets.items()), "unit int, sides array<struct<pair:int,right:boolean>>")
    units = keyed.join(F.broadcast(of), "top").withColumn("unit", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("chunks"))).cast("int"))
    packed = units.groupBy("unit").agg(F.collect_list("fp").alias("fps"))  # a unit is bounded by the cap
    dealt = packed.join(F.broadcast(sides), "unit").select("fps", F.inline("sides"))

    def solve(pdf):
        import pandas as pd

        def ready(part):
            fp = np.concatenate([np.asarray(x, dtype=np.int64) for x in part]).view(np.uint64)
            bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            put = np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="big")).view(">u8").ravel().astype(np.uint64)
            at = np.argsort(put, kind="stable")
            return put[at], fp[at]

        right = pdf["right"].to_numpy(dtype=bool)
        a, fa = ready(pdf["fps"][~right])
        if right.any():
            b, fb = ready(pdf["fps"][right])
            found = ((i, j + len(a)) for i, j in links(a, b, max_bits))
            fa = np.concatenate((fa, fb))
        else:
            found = links(a, None, max_bits)
        low = forest(len(fa), found)
        at = np.flatnonzero(low != np.arange(len(low)))
        return pd.DataFrame({"a": fa[at].view(np.int64), "b": fa[low[at]].view(np.int64)})

    return dealt.groupBy("pair").applyInPandas(solve, "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the group of each row, named by the smallest id that links lead to.

    Texts are lower-cased in A-Z, words are runs other than space and tab to carriage return, and a fingerprint is set
    where over half the shingles' XXH64 are. A text without words, null ones included, has fingerprint zero and links
    like any other. Rows of equal fingerprints are one vertex, so thousands of copies cost one comparison. Null ids take
    part and get the smallest id that is not null of their group, null where there is none. Repeated rows stay. An empty
    table gives an empty result. Other columns of docs are not read.

    With `similarity` the budget is wide enough for texts of that Jaccard similarity of their shingles, and each link is
    checked exactly: shingle_groups.group() says how; the result is (doc_id, component_id).
    """
    if similarity is not None:
        from .shingle_groups import group

        return group(docs, id_col, text_col, words, similarity)
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    # a vertex's name begins with its smallest id, so the smallest name of a component has that of the component
    name = distinct.select("fp", F.struct(F.col("low").isNull().alias("none"), "low", "fp").alias("name"))
    edges = trie_join(distinct.select("fp"), max_bits).join(name.toDF("a", "name_a"), "a").join(name.toDF("b", "name_b"), "b")
    joined = components(edges.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))).select(F.col("node.fp").alias("fp"), F.col("component.low").alias("least"))
    ids = distinct.join(joined, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
