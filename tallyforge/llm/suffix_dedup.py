"""Repeated byte strings by prefix-free parsing: phrases, their dictionary, and the order of its suffixes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, shared_path, small_batches

#: Bytes of the string that triggers a phrase.
TRIGGER = 16
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 24) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the `width` bytes from each place on, joined from hashes of powers of two."""
    power, n, out, size = x, 1, None, 0
    while width:
        if width & 1:
            if out is None:
                out, size = power, n
            else:
                m = len(x) - size - n + 1
                out = out[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + power[size : size + m]
                size += n
        width >>= 1
        if width:
            m = len(x) - 2 * n + 1
            power, n = power[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + power[n : n + m], 2 * n
    return out


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[: len(v) - width + n], v[width - n :]) if width > n else v


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Phrases of the texts data[start:end]: (text, first window, last window, trigger hash, phrase hash).

    A window's trigger is the TRIGGER bytes in it with the smallest hash, the leftmost of equals, so it depends on the
    window alone. Neighbouring windows with the same trigger make a phrase: every window is in exactly one, and no
    phrase goes on into the next one's windows. The phrase hash is that of its first and last window, which cover it.
    """
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    x = _BYTES[data]
    trigger, whole = mixed(rolling(x, TRIGGER)), mixed(rolling(x, width))
    at = (sliding_min((trigger & ~_LOW) | np.arange(len(trigger), dtype=np.uint64), width - TRIGGER + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    ok = np.arange(len(at)) + width <= ends[text]
    new = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(text) != 0)))
    first = np.flatnonzero(new & ok)
    stop = np.concatenate((np.flatnonzero(new), [len(at)]))
    last = np.minimum(stop[np.searchsorted(stop, first, side="right")] - 1, ends[text[first]] - width)
    phrase = mixed(whole[first] * _M1 + mixed(whole[last] + (last - first).astype(np.uint64)))
    return text[first], first, last, trigger[at[first]], phrase


def suffix_ranks(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the suffixes that begin at the places `at`, ordered by their first `width` bytes; equal ones share a rank.

    By prefix doubling: the ranks of eight bytes come from the bytes, those of twice as many from pairs of ranks, and the
    last pair overlaps where width is no power of two. No suffix may end before its `width` bytes.
    """
    x = np.concatenate((data, np.zeros(width, np.uint8))).astype(np.uint64)
    key, size = np.zeros(len(data), np.uint64), 8
    for k in range(8):
        key = key << np.uint64(8) | x[k : k + len(data)]
    while size < width:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        step = min(size, width - size)
        key = rank << np.uint64(32)
        key[: len(key) - step] |= rank[step:]
        size += step
    return np.unique(key[at], return_inverse=True)[1]


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


#: One layout for all packed rows; kind: what the row holds, key: the group it goes to. Columns that a kind lacks are empty.
LAYOUT = "key long, kind int, part binary, uid binary, doc binary, first binary, size binary, a binary, p binary, text binary"
OCCURS, REMOVED, ASKED, SPELLED = 0, 1, 2, 3
_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("part", "uid", "doc", "first", "size", "a", "p", "text"))])


def _pack(key: int, kind: int, part, uid, doc, first, size, a=None, p=None, text=b"") -> dict:
    """part: the text's part of the corpus; first, size: window range; a, p: hashes of trigger and phrase."""
    empty = np.empty(0, np.uint64)
    a = empty if a is None else a
    raw = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 3:]  # 40 bits; the key holds others
    return {"key": int(key), "kind": kind, "part": _zip(np.asarray(part, "<i4")), "uid": _zip(np.asarray(uid, "<i8")), "doc": _zip(np.asarray(doc, "<i8")), "first": _zip(np.asarray(first, "<i8")), "size": _zip(np.asarray(size, "<u1")), "a": raw.tobytes(), "p": (empty if p is None else p).astype("<u8").tobytes(), "text": text}


def _unpack(rows: list[dict]) -> dict[str, np.ndarray]:
    kinds = {"part": "<i4", "uid": "<i8", "doc": "<i8", "first": "<i8", "size": "<u1"}
    out = {k: np.concatenate([_unzip(r[k], t) for r in rows]).astype(np.int64) for k, t in kinds.items()}
    raw = np.frombuffer(b"".join(r["a"] for r in rows), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 3:] = raw
    out["a"] = wide.view("<u8").ravel()
    out["p"] = np.frombuffer(b"".join(r["p"] for r in rows), dtype="<u8")
    return out


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _slices(batch: pa.RecordBatch, column: str, most: int):
    """Runs of rows with about `most` bytes of text."""
    sizes = np.array([len(x.as_buffer()) for x in batch.column(column)], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _keys(part: np.ndarray):
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(part[own[0]]), own


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, part_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of each text without its repeated strings, as bytes.

    A byte goes if a string of `width` bytes over it also starts in a document with a smaller id; strings never cross
    documents. The corpus is written once, bucketed by part, so that it is never shuffled. Then:
    1. Each part is parsed into phrases. A phrase that also stands earlier in the part is removed at once; the others go,
       16 bytes each and packed, to the group of their trigger's hash.
    2. A group is the dictionary of its triggers: equal phrases are one entry, held by the smallest id; in all later
       documents the whole phrase is removed. Triggers with several entries need more: their bytes are asked for.
    3. The parts spell out the entries asked for, and a group puts the suffixes of its dictionary in order, to a depth of
       `width` bytes: those that are equal to there stand side by side, and the smallest document that the parse has for
       any of their phrases tells which begin earlier. No phrase goes on into the next one's windows, so the order of the
       parse beyond a phrase, and of suffixes beyond `width` bytes, decides nothing here and is not built.
    4. The parts join their removals, and are cut.
    Equality of phrases rests on 128 bits of two hashes (104 that travel), of windows in step 3 on their bytes.

    Ids must be whole numbers. Null text is empty. Rows with a null id keep all and remove nothing; rows of equal ids
    don't remove from each other. Texts of any length are parsed whole, in overlapping pieces. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    if not TRIGGER < width < 200:
        raise ValueError("width must be over 16 and under 200")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("data"))
    total = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    tasks = max(1, rows.rdd.getNumPartitions())
    subs = max(1, round(total / tasks / part_bytes))
    groups = max(1, -(-total // max(4 << 20, min(64 << 20, total // 8192))))  # of 4 MB of text, up to 64 MB where that makes many
    buckets = min(50_000, tasks * subs)
    part = F.spark_partition_id() * subs + F.pmod(F.xxhash64("doc"), F.lit(subs))
    rows = rows.select(part.cast("int").alias("part"), F.monotonically_increasing_id().alias("uid"), "doc", "data")
    name = f"corpus_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "part").option("path", shared_path(spark, "corpus")).option("compression", "zstd").saveAsTable(name)
    corpus = spark.table(name)

    def parsed(batch):
        """Pieces of a batch as (part, uid, doc, offset, first, last, trigger, phrase) of each phrase."""
        for piece in _slices(batch, "data", 2 << 20):
            held = [(i, x.as_buffer()) for i, x in enumerate(piece.column("data")) if len(x.as_buffer()) >= width]
            doc = piece.column("doc").to_pylist()
            step = 1 << 21
            cut = [(i, a, memoryview(b)[a : a + step + width - 1]) for i, b in held if doc[i] is not None for a in range(0, max(1, len(b) - width + 1), step)]
            uid, numbers = piece.column("uid").to_numpy(), piece.column("part").to_numpy()
            while cut:
                own, size = [], 0
                while cut and (not own or size + len(cut[-1][2]) <= 3 << 20):
                    own.append(cut.pop())
                    size += len(own[-1][2])
                data = np.frombuffer(b"".join(b for *_, b in own), dtype=np.uint8)
                ends = np.cumsum([len(b) for *_, b in own])
                starts = ends - [len(b) for *_, b in own]
                t, first, last, a, p = parse(data, starts, ends, width)
                row = np.array([i for i, *_ in own], dtype=np.int64)[t]
                offset = np.array([a for _, a, _ in own], dtype=np.int64)[t] - starts[t]
                docs_ = np.array([doc[i] for i, *_ in own], dtype=np.int64)[t]
                yield numbers[row].astype(np.int64), uid[row].astype(np.int64), docs_, first + offset, last - first, a, p

    def pack(phrases):
        """Packed rows of a few hundred thousand phrases: those that stand earlier among them are removed at once."""
        part, uid, doc, first, size, a, p = map(np.concatenate, zip(*phrases))
        order = np.lexsort((doc, p, a))
        new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(p[order]) != 0)))
        low = np.empty(len(order), dtype=np.int64)
        low[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.flatnonzero(doc > low)
        for k, o in _keys(part[gone]):
            own = gone[o]
            yield _table([_pack(k, REMOVED, part[own], uid[own], doc[own], first[own], size[own])]).to_batches()[0]
        left = np.flatnonzero(doc <= low)
        left = left[np.lexsort((first[left], uid[left]))]
        for k, o in _keys((a[left] % np.uint64(groups)).astype(np.int64)):
            own = left[o]
            yield _table([_pack(-1 - k, OCCURS, part[own], uid[own], doc[own], first[own], size[own], a[own], p[own])]).to_batches()[0]

    def occurrences(batches):
        held, n = [], 0
        for batch in batches:
            for phrases in parsed(batch):
                if len(phrases[0]):
                    held.append(phrases)
                    n += len(phrases[0])
                if n >= 400_000:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    def dictionary(table):
        """One group of triggers: what is removed, and the entries whose bytes are needed."""
        rows = table.to_pylist()
        if rows[0]["kind"] == REMOVED:
            return table
        x = _unpack(rows)
        order = np.lexsort((x["doc"], x["p"], x["a"]))
        a, p, doc = x["a"][order], x["p"][order], x["doc"][order]
        new_a = np.concatenate(([True], np.diff(a) != 0))
        new = new_a | np.concatenate(([True], np.diff(p) != 0))
        low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        group = np.cumsum(new_a) - 1
        several = np.bincount(group, weights=new)[group] > 1
        shared = (np.maximum.reduceat(doc, np.flatnonzero(new_a)) > np.minimum.reduceat(doc, np.flatnonzero(new_a)))[group] if len(doc) else several
        out = []
        for kind, mask in ((REMOVED, doc > low), (ASKED, (doc == low) & several & shared)):
            own = order[mask]
            for k, o in _keys(x["part"][own]):
                o = own[o]
                out.append(_pack(k, kind, x["part"][o], x["uid"][o], x["doc"][o], x["first"][o], x["size"][o], x["a"][o] if kind == ASKED else None))
                if kind == ASKED:
                    out[-1]["text"] = np.int64(-1 - rows[0]["key"]).tobytes()
        return _table(out)

    found = materialize(corpus.mapInArrow(frugal(occurrences), LAYOUT).groupBy("key").applyInArrow(dictionary, LAYOUT), "phrases", compression="zstd")

    def spell(left, right):
        """Bytes of the entries asked for, by group."""
        rows = right.to_pylist()
        if not rows or not left.num_rows:
            return _table([])
        group = np.concatenate([np.full(len(r["a"]) // 5, np.frombuffer(r["text"], np.int64)[0]) for r in rows])
        x, held = _unpack(rows), dict(zip(left.column("uid").to_pylist(), left.column("data")))
        out = []
        for g, own in _keys(group):
            said = [held[u].as_buffer()[f : f + s + width] for u, f, s in zip(x["uid"][own].tolist(), x["first"][own].tolist(), x["size"][own].tolist())]
            said = zstandard.ZstdCompressor(level=1).compress(b"".join(said))
            out.append(_pack(g, SPELLED, x["part"][own], x["uid"][own], x["doc"][own], x["first"][own], x["size"][own], x["a"][own], text=said))
        return _table(out)

    def suffixes(table):
        """Windows of the entries that also begin in an earlier document, by the order of the dictionary's suffixes."""
        rows = table.to_pylist()
        x = _unpack(rows)
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["text"]) for r in rows), dtype=np.uint8)
        sizes = x["size"] + 1  # windows of each entry
        begin = np.cumsum(sizes + width - 1) - (sizes + width - 1)
        order = np.argsort(x["a"], kind="stable")
        new = np.concatenate(([True], np.diff(x["a"][order]) != 0))
        spent = np.cumsum(sizes[order] + width - 1)
        # equal windows have one trigger: a few megabytes of whole triggers at a time
        cut = np.maximum.accumulate(np.where(new, (spent - (sizes[order] + width - 1)) >> 22, 0))
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
            said = np.concatenate([data[b : b + s + width - 1] for b, s in zip(begin[own].tolist(), sizes[own].tolist())])
            entry = np.repeat(np.arange(len(own)), sizes[own])
            offset = np.arange(len(entry)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            starts = np.cumsum(sizes[own] + width - 1) - (sizes[own] + width - 1)
            rank = suffix_ranks(said, starts[entry] + offset, width)
            doc = x["doc"][own][entry]
            low = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, rank, doc)
            gone = np.flatnonzero(doc > low[rank])
            if not len(gone):
                continue
            e, o = entry[gone], offset[gone]
            i = np.flatnonzero(np.concatenate(([True], (np.diff(e) != 0) | (np.diff(o) != 1))))
            size = np.diff(np.concatenate((i, [len(gone)]))) - 1
            e, first = own[e[i]], x["first"][own[e[i]]] + o[i]
            out += [_pack(k, REMOVED, x["part"][e[o]], x["uid"][e[o]], x["doc"][e[o]], first[o], size[o]) for k, o in _keys(x["part"][e])]
        return _table(out)

    spelled = corpus.groupBy("part").cogroup(_numbered(found, ASKED).groupBy("number")).applyInArrow(spell, LAYOUT)
    later = materialize(spelled.groupBy("key").applyInArrow(suffixes, LAYOUT), "suffixes", compression="zstd")

    def cut(left, right):
        rows = right.to_pylist()
        x = _unpack(rows) if rows else None
        order = np.argsort(x["uid"], kind="stable") if rows else np.empty(0, int)
        uid = x["uid"][order] if rows else order
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for u, doc, data in zip(left.column("uid").to_pylist(), left.column("doc").to_pylist(), left.column("data")):
            data = data.as_buffer()
            a, b = np.searchsorted(uid, [u, u + 1])
            kept, removed, spans = bytes(data), 0, 0
            if a < b:
                own = order[a:b]
                first = x["first"][own]
                edge = np.bincount(first, minlength=len(data) + 1) - np.bincount(first + x["size"][own] + width, minlength=len(data) + 1)
                gone = np.cumsum(edge)[: len(data)] > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((np.diff(gone.astype(np.int8)) > 0).sum())
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            for k, v in zip(out, (doc, len(data), removed, spans, kept)):
                out[k].append(v)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=list(out))

    removed = _numbered(found, REMOVED).unionByName(_numbered(later, REMOVED))
    return corpus.groupBy("part").cogroup(removed.groupBy("number")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _numbered(rows: DataFrame, kind: int) -> DataFrame:
    """Packed rows of one kind with the number of their part first."""
    return rows.where(F.col("kind") == kind).select(F.col("key").cast("int").alias("number"), *rows.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
