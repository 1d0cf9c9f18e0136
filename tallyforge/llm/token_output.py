"""Token ids in a binary format: static range asymmetric numeral system over shared frequency tables."""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_table, materialize, shared_path, small_batches

#: Frequencies add up to 2 ** SCALE; states stay in [2 ** 31, 2 ** 63) and move in words of 32 bits.
SCALE = 20
LOW = np.uint64(1 << 31)
END_ID = 2

BLOCK_SCHEMA = "shard int, block int, start long, n_tokens long, doc_ids array<{id}>, doc_tokens array<long>, lanes int, states binary, words binary, every int, check_at array<long>, check_states array<binary>, crc32 long, table_crc32 long"


@dataclass
class Table:
    """Scaled frequencies of all ids (0: never seen); rest is derived."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = np.asarray(self.freq, dtype=np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)))[:-1].astype(np.uint64)
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc32 = zlib.crc32(self.freq.astype("<u8").tobytes())


def scaled(counts: np.ndarray) -> Table:
    """Counts as frequencies that add up to 2 ** SCALE, at least one for each id that is seen."""
    counts = np.asarray(counts, dtype=np.int64)
    seen, total, whole = counts > 0, int(counts.sum()), 1 << SCALE
    if not total:
        return Table(np.zeros(len(counts)))
    if int(seen.sum()) > whole:
        raise ValueError(f"more than {whole} ids in use")
    freq = np.where(seen, np.maximum(1, (counts.astype(np.float64) * (whole / total)).astype(np.int64)), 0)
    over = int(freq.sum()) - whole
    for i in np.argsort(-freq, kind="stable").tolist():  # the most frequent pay or gain
        if not over:
            break
        change = min(over, int(freq[i]) // 2) if over > 0 else over
        freq[i] -= change
        over -= change
    return Table(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = 2048, every: int = 128) -> dict:
    """One independent block: lanes interleaved coders; at every `every` steps a checkpoint from which decoding can begin.

    Id number t belongs to lane t mod lanes, step t div lanes. The coders run over the steps backwards; the words that a
    step puts out stand in lane order, so a decoder that runs forwards takes them in the same order.
    """
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks = []
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        part = ids[t * lanes : (t + 1) * lanes]
        f, now = table.freq[part], x[: len(part)]
        full = now >= (f << np.uint64(63 - SCALE))
        if full.any():
            out[t] = now[full].astype(np.uint32)
            now = np.where(full, now >> shift, now)
        q = now // f
        x[: len(part)] = (q << scale) + (now - q * f) + table.cum[part]
        if t and t % every == 0:
            marks.append(x.astype("<u8").tobytes())
    sizes = np.concatenate(([0], np.cumsum([len(o) for o in out])))
    words = np.concatenate(out) if out else np.empty(0, np.uint32)
    at = list(range(every, steps, every))
    return {"n_tokens": n, "lanes": lanes, "states": x.astype("<u8").tobytes(), "words": words.astype("<u4").tobytes(), "every": every, "check_at": [int(sizes[t]) for t in at], "check_states": marks[::-1]}


def decode_block(block: dict, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the steps from checkpoint `first` (0: the start) to before checkpoint `last` (None: the end)."""
    n, lanes, every = block["n_tokens"], block["lanes"], block["every"]
    steps = -(-n // lanes)
    begin, end = first * every, steps if last is None else min(steps, last * every)
    states, at = (block["states"], 0) if first == 0 else (block["check_states"][first - 1], block["check_at"][first - 1])
    x = np.frombuffer(states, dtype="<u8").astype(np.uint64)
    words = np.frombuffer(block["words"], dtype="<u4")
    out = np.empty(min(n, end * lanes) - begin * lanes, dtype=np.uint32)
    mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(begin, end):
        k = min(lanes, n - t * lanes)
        now = x[:k]
        slot = now & mask
        part = table.slots[slot.astype(np.int64)]
        out[(t - begin) * lanes : (t - begin) * lanes + k] = part
        now = table.freq[part] * (now >> scale) + slot - table.cum[part]
        need = now < LOW
        m = int(np.count_nonzero(need))
        if m:
            now[need] = (now[need] << shift) | words[at : at + m]
            at += m
        x[:k] = now
    return out


class Encoder:
    """Ids of texts by a tokenizers file, each distinct chunk between spaces or line feeds encoded once.

    The tokenizer must drop white space and ignore case, so chunks encode alike alone and in a text; one that shows
    otherwise on a few probes is refused. New chunks are
    encoded many at a time, parted by a mark, and the ids are cut at the mark's ids; a chunk that holds the mark is
    encoded alone. Chunks are kept up to a number, which bounds a worker's memory and doesn't change results.
    """

    MARK = "¤"

    def __init__(self, path: str, most: int = 1_700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in texts as they stand, with case
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for probe in ("The Quick  brown\nFOX, jumped.", " Ünï CÖDE\t12\n\n", "don't Stop-me 日本 x_Y"):
            if plain(probe) != [i for chunk in probe.lower().replace("\n", " ").split(" ") for i in plain(chunk)]:
                raise ValueError("the tokenizer keeps white space or case, so texts can't be encoded chunk by chunk")
        self.mark = np.array(self.tokenizer.encode(self.MARK, add_special_tokens=False).ids, dtype=self.kind)

    def new(self, words: list[str], many: int = 1024) -> None:
        plain = [w for w in words if self.MARK not in w]
        for w in set(words) - set(plain):
            self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        runs = [plain[i : i + many] for i in range(0, len(plain), many)]
        for i in range(0, len(runs), 16):
            joined = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(r) for r in runs[i : i + 16]], add_special_tokens=False)
            for run, found in zip(runs[i : i + 16], joined):
                ids, m = np.array(found.ids, dtype=self.kind), len(self.mark)
                at = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - m + 1 + k] == x for k, x in enumerate(self.mark)])) if len(ids) >= m else np.empty(0, int)
                if len(at) != len(run) - 1:  # the mark's ids arose elsewhere
                    self.known.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.kind).tobytes()) for w in run)
                    continue
                data, size = ids.tobytes(), self.kind.itemsize
                begins, ends = [0, *((at + m) * size).tolist()], [*(at * size).tolist(), len(data)]
                self.known.update((w, data[x:y]) for w, x, y in zip(run, begins, ends))

    def __call__(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known, get = self.known, self.known.get
        all_chunks, all_found, lacking = [], [], []
        for text in texts:
            text = text or ""
            chunks = None
            if text.isascii() or not _MARKS.search(text):  # nothing that combines: case can go first
                lowered = text.lower()
                if any(t in lowered and lowered.count(t) != text.count(t) for t in self.added):  # an added token that only its case keeps apart
                    chunks = [c if any(t in c.lower() for t in self.added) else c.lower() for c in text.replace("\n", " ").split(" ")]
                text = lowered
            chunks = chunks or text.replace("\n", " ").split(" ")
            found = list(map(get, chunks))
            lacks = [i for i, x in enumerate(found) if x is None] if None in found else ()
            all_chunks.append(chunks)
            all_found.append(found)
            lacking.append(lacks)
        if new := list({chunks[i] for chunks, lacks in zip(all_chunks, lacking) for i in lacks}):
            self.new(new)
        end, out = np.array([end_id], dtype=self.kind).tobytes(), []
        for chunks, found, lacks in zip(all_chunks, all_found, lacking):
            for i in lacks:
                found[i] = known[chunks[i]]
            out.append(b"".join(found) + end)
        return out


#: Lower case before or after composition is the same for texts of the characters below these.
_MARKS = re.compile("[\u0300-\U0010ffff]")
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(batch: pa.RecordBatch, most: int = 8 << 20):
    """A batch in slices of about `most` bytes of text (at least a row each)."""
    lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(1)).to_pylist()], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 19, lanes: int = 2048) -> np.ndarray:
    """Encodes all texts and writes the format to `path`: folder `table` (token, freq) and folder `blocks`.

    Blocks are rows of Parquet files, so they commit atomically and lie in any store Spark can write. A shard is a range
    of ids, in ascending order (null first, ties by the tokens), and holds blocks of whole documents of about `block`
    tokens; a longer document is a block of its own. Texts are tokenized once, before they are dealt to ranges; only
    tokens are shuffled. Returns the frequencies (as many as the tokenizer has ids).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    size, kind = encoder(tokenizer).size, encoder(tokenizer).kind
    id_arrow = to_arrow_type(rows.schema["doc_id"].dataType)

    def tokenize(batches):
        """Ids of each row; at the end of a task one row more, with the task's counts."""
        run, total = encoder(tokenizer), np.zeros(size, dtype=np.int64)
        names = ["doc_id", "ids", "used", "n"]
        for batch in batches:
            for part in pieces(batch):
                found = run(part.column(1).to_pylist(), end_id)
                total += np.bincount(np.frombuffer(b"".join(found), dtype=kind), minlength=size)
                none = pa.nulls(len(found), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), none, none], names=names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_arrow), pa.nulls(1, pa.binary()), pa.array([used], pa.list_(pa.int64())), pa.array([total[used]], pa.list_(pa.int64()))], names=names)

    ids = materialize(rows.mapInArrow(tokenize, f"doc_id {id_type}, ids binary, used array<long>, n array<long>"), "token-ids", compression="zstd")
    counts = np.zeros(size, dtype=np.int64)
    tallied = ids.select(F.inline(F.arrays_zip(F.col("used").alias("token"), F.col("n").alias("n"))))
    for r in tallied.groupBy("token").agg(F.sum("n").alias("n")).collect():  # one row an id
        counts[r["token"]] = r["n"]
    table = scaled(counts)
    used = np.flatnonzero(table.freq)
    spark.createDataFrame([(int(t), int(table.freq[t])) for t in used], "token int, freq long").coalesce(1).write.parquet(f"{path}/table")
    freq = spark.sparkContext.broadcast(table.freq)  # one number an id

    def encode(batches):
        from pyspark import TaskContext

        table, shard = Table(freq.value), TaskContext.get().partitionId()
        schema = None
        start, number, names, parts, held = 0, 0, [], [], 0

        def done():
            nonlocal start, number, names, parts, held
            raw = np.concatenate(parts)
            out = encode_block(raw, table, lanes)
            out |= {"shard": shard, "block": number, "start": start, "doc_ids": names, "doc_tokens": [len(p) for p in parts], "crc32": zlib.crc32(raw.astype("<u4").tobytes()), "table_crc32": table.crc32}
            start, number, names, parts, held = start + held, number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("doc_tokens", pa.list_(pa.int64())), ("lanes", pa.int32()), ("states", pa.binary()), ("words", pa.binary()), ("every", pa.int32()), ("check_at", pa.list_(pa.int64())), ("check_states", pa.list_(pa.binary())), ("crc32", pa.int64()), ("table_crc32", pa.int64())])
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(np.frombuffer(x.as_py(), dtype=kind))
                names.append(name)
                held += len(parts[-1])
                if held >= block:
                    yield done()
        if parts:
            yield done()

    ranged = ids.where("ids is not null").select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ranged.mapInArrow(encode, BLOCK_SCHEMA.format(id=id_type)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_table(ids)
    return table.freq


def read(spark: SparkSession, path: str, n_ids: int) -> DataFrame:
    """Reads the format back: (doc_id, shard, start, n_tokens, ids binary of 32-bit little-endian), checked by checksum.

    start counts the tokens of all documents before. Blocks decode independently of each other.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    freq = np.zeros(n_ids, dtype=np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():  # one row an id
        freq[r["token"]] = r["freq"]
    held = spark.sparkContext.broadcast(freq)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        table = Table(held.value)
        for batch in batches:
            for block in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if block["table_crc32"] != table.crc32:
                    raise ValueError("the blocks belong to another frequency table")
                raw = decode_block(block, table).astype("<u4")
                if zlib.crc32(raw.tobytes()) != block["crc32"]:
                    raise ValueError(f"shard {block['shard']}, block {block['block']}: checksum differs")
                ends = np.cumsum(block["doc_tokens"])
                begins = (ends - block["doc_tokens"]).tolist()
                for i in range(0, len(begins), 1000):
                    own = slice(i, i + 1000)
                    data = [raw[a:b].tobytes() for a, b in zip(begins[own], ends[own].tolist())]
                    k = len(data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block["doc_ids"][own], batch.schema.field("doc_ids").type.value_type), pa.array([block["shard"]] * k, pa.int32()), pa.array([block["start"] + a for a in begins[own]], pa.int64()), pa.array([len(d) // 4 for d in data], pa.int64()), pa.array(data, pa.binary())],
                        names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
                    )

    rows = blocks.mapInArrow(decode, f"doc_id {id_type}, shard int, start_in_shard long, n_tokens long, ids binary")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each shard, which is a partition
    return rows.join(F.broadcast(bases), "shard").select("doc_id", "shard", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs in the format and returns, from the files read back, (doc_id, start, n_tokens, ids_crc32).

    A null or empty text has the end id alone. Null ids come first, repeated ids and rows each have a place. An empty
    table gives an empty result. Other columns are not read.
    """
    path = shared_path(docs.sparkSession, "tokens")
    freq = write(docs, path, tokenizer, **options)
    back = read(docs.sparkSession, path, len(freq))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
