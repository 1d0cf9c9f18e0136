"""SimHash near-dedup at a wide budget: groups of texts whose word shingles are alike, found by many small tries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, frugal, materialize, small_batches
from .simhash import _BITS, forest, links

#: Words of 64 bits in a fingerprint, and tries over 32 of its bits each.
WIDTH, TRIES = 8, 10
#: Differing bits of a trie's 32 at most, and of the whole fingerprint's 512: texts of similarity 0.8 differ in 78, give or take 8.
NEAR, LIMIT = 3, 93
_STEPS = (np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = (np.arange(8 * WIDTH, dtype=np.int64) * 256)[None, :]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, in lower case; of the whole text where it has fewer words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> bytes:
    """512 bits: each is set where over half of the shingles have it set."""
    counts = np.zeros(8 * WIDTH * 256, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        h = hashes[i : i + (1 << 15), None] + _STEPS
        h = (h ^ (h >> np.uint64(31))) * _M1
        h = (h ^ (h >> np.uint64(29))) * _M2
        h ^= h >> np.uint64(32)
        counts += np.bincount((h.astype("<u8").view(np.uint8) + _PLACE).ravel(), minlength=len(counts))
    return np.packbits((counts.reshape(-1, 256) @ _BITS).ravel() * 2 > len(hashes), bitorder="little").tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class Forest:
    """Edges that connect what all pairs given to it connect, the nearest first."""

    def __init__(self, n: int, most: int = 1 << 21):
        self.n, self.most, self.held, self.edges = n, most, 0, [np.empty((3, 0), np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        self.edges.append(np.stack((i, j, d)))
        self.held += len(i)
        if self.held > self.most:
            self.edges = [self.thinned()]
            self.held = 0

    def thinned(self) -> np.ndarray:
        all_, low, kept = np.concatenate(self.edges, axis=1), np.arange(self.n), []
        for d in np.unique(all_[2]):
            i, j, _ = now = all_[:, all_[2] == d]
            name = np.minimum(low[i], low[j]) * self.n + np.maximum(low[i], low[j])
            first = np.unique(name, return_index=True)[1]
            first = first[low[i[first]] != low[j[first]]]
            if len(first):
                kept.append(now[:, first])
                low = forest(self.n, [(i[first], j[first])] + [(np.arange(self.n), low)])
        return np.concatenate([np.empty((3, 0), np.int64), *kept], axis=1)


def near_groups(wide: np.ndarray, trie: int) -> np.ndarray:
    """Edges (i, j, differing bits) between fingerprints (rows of 64-bit words) that are near in one trie and on the whole.

    Neighbours in the order of the trie's bits are tied first; the self-join of the trie then skips pairs of nodes that
    these ties put into one group, so a large group of near copies does not cost all its pairs.
    """
    word = wide[:, trie // 2] >> np.uint64(32 * (trie % 2)) & np.uint64(0xFFFFFFFF)
    order = np.argsort(word, kind="stable")
    key, rows = word[order] << np.uint64(32), wide[order]
    out = Forest(len(wide))

    def near(i, j):
        d = np.bitwise_count(rows[i] ^ rows[j]).sum(axis=1, dtype=np.int64)
        ok = d <= LIMIT
        return i[ok], j[ok], d[ok]

    tied = near(np.arange(len(rows) - 1), np.arange(1, len(rows)))
    out.add(*tied)
    low = forest(len(rows), [tied[:2]])
    change = np.flatnonzero(np.diff(low)) + 1
    run_end = np.concatenate((change, [len(low)]))[np.searchsorted(change, np.arange(len(low)), side="right")]
    for i, j in links(key, None, NEAR, stop=32, settled=(low, run_end)):
        for k in range(0, len(i), 1 << 18):
            out.add(*near(i[k : k + (1 << 18)], j[k : k + (1 << 18)]))
    i, j, d = out.thinned()
    return np.stack((order[i], order[j], d))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, unit: int = 1 << 16) -> DataFrame:
    """(doc_id, component_id) of each row: groups of texts linked by a Jaccard similarity of `least` or more of their shingles.

    Texts that are equal in lower case, but for white space, are one vertex. Each gets 512 bits by SimHash over its
    distinct shingles; two texts of similarity 0.8 are within 3 bits of 32 in one of ten tries with a probability of 0.95,
    more alike ones with a higher one. Such two share one of the 32 bits' four bytes, so texts meet by place and value of
    each of 40 bytes, in groups that the trie's self-join works on; a group of more than `unit` texts is cut into units
    that meet two by two. What is near in the trie and on the whole fingerprint gives a spanning forest with the nearest
    edges, and each edge is checked exactly by the shingles of the two texts. So no group holds a link that is not true;
    but a true link can be lost where it lies behind an edge of the forest that the check refuses and no other of the ten
    tries or of a text's bytes leads to it: 33 of 17,628 pairs at the threshold, in families made of such pairs.

    Texts without a word, null ones included, are one group. Null ids take part and get the smallest id that is not null
    of their group, null where there is none. Repeated rows stay. An empty table gives an empty result. Long texts count
    whole. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, words) for t in texts]
            wide = b"".join(map(fingerprint, sets))
            at = np.frombuffer(wide, np.uint8).reshape(len(texts), 8 * WIDTH)[:, : 4 * TRIES].astype(np.int16)
            columns = [
                pa.array([xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts], pa.binary()),
                pa.array([wide[i : i + 8 * WIDTH] for i in range(0, len(wide), 8 * WIDTH)], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, at.size + 1, 4 * TRIES, dtype=np.int32), at.ravel()),
                pa.array([np.unique(h >> np.uint64(32)).astype("<u4").tobytes() for h in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "v", "wide", "bytes", "said"])

    every = materialize(rows.mapInArrow(frugal(prints), f"doc_id {id_type}, v binary, wide binary, bytes array<short>, said binary"), "prints", compression="zstd")
    known = materialize(every.groupBy("v").agg(F.min("doc_id").alias("low"), F.first(F.struct("wide", "bytes")).alias("print")).select("v", "low", "print.*"), "prints-distinct")
    met = known.select("v", "wide", F.posexplode("bytes").alias("place", "value")).select("v", "wide", (F.col("place") * 256 + F.col("value")).alias("at"))
    sizes = known.select(F.posexplode("bytes").alias("place", "value")).groupBy((F.col("place") * 256 + F.col("value")).alias("at")).agg(F.ceil(F.count(F.lit(1)) / unit).cast("long").alias("units"))  # 40 x 256 rows
    met = met.join(F.broadcast(sizes), "at").withColumn("mine", F.pmod(F.xxhash64("v"), F.col("units")))
    number = lambda x, y: (F.col("at") * F.col("units") + x) * F.col("units") + y
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("units") - 1), lambda u: u != F.col("mine"))
    meets = F.when(F.col("units") == 1, F.array(F.col("at").cast("long"))).otherwise(F.transform(others, lambda u: number(F.least(u, "mine"), F.greatest(u, "mine"))))
    met = met.select("at", "v", "wide", F.explode(meets).alias("meet"))

    def solve(table):
        v = table.column("v").to_pylist()
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), dtype="<u8").reshape(len(v), WIDTH)
        i, j, _ = near_groups(wide, table.column("at")[0].as_py() // 1024) if len(v) > 1 else np.empty((3, 0), np.int64)
        names = [(min(v[x], v[y]), max(v[x], v[y])) for x, y in zip(i.tolist(), j.tolist())]
        return pa.table({"a": pa.array([x for x, _ in names], pa.binary()), "b": pa.array([y for _, y in names], pa.binary())})

    found = materialize(met.groupBy("at", "meet").applyInArrow(solve, "a binary, b binary").distinct(), "candidates")
    ends = found.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    said = materialize(every.select("v", "said").join(ends, "v", "left_semi").groupBy("v").agg(F.first("said").alias("said")), "shingles")

    def check(batches):
        for batch in batches:
            ok = [similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    both = found.join(said.toDF("a", "said_a"), "a").join(said.toDF("b", "said_b"), "b").select("a", "b", "said_a", "said_b")
    true = both.mapInArrow(frugal(check), "a binary, b binary")
    # a vertex's name begins with its smallest id, so the smallest name of a component has that of the component
    name = known.select("v", F.struct(F.col("low").isNull().alias("none"), "low", "v").alias("name"))
    edges = true.join(name.toDF("a", "name_a"), "a").join(name.toDF("b", "name_b"), "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    joined = components(edges).select(F.col("node.v").alias("v"), F.col("component.low").alias("least"))
    ids = known.select("v", "low").join(joined, "v", "left").select("v", F.coalesce("least", "low").alias("component_id"))
    return every.select("doc_id", "v").join(ids, "v").select("doc_id", "component_id")
