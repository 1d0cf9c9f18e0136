"""Language-model scores of texts by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, materialize, small_batches

#: Bits of a word's code, the decisions that predict it; documents read side by side to learn weights; bytes of text gathered for that.
BITS, SIDE, GATHER = 8, 512, 16 << 20
#: Documents read side by side where no weights are learned, so that no text depends on another: what a step holds stays in a core's cache.
APART = 64
#: Words between two updates: in a text's beginning, its length, and after it.
STEP, EARLY, LATER = 64, 512, 128
CODES = 1 << BITS
#: Contexts: none, the word before, the one before that, both. Entries of a block of a predictor's table.
ORDERS, BLOCK = 4, 1 << 16
#: Predictors that are mixed: one for each context, the document itself so far, and a constant.
INPUTS = ORDERS + 2
GATES = BITS * 4
#: A stretched probability of 1 is this many steps of a table's bytes.
SCALE = 15.5
END = b"\n"
#: Sums of logarithms are kept as whole numbers of this fraction, so that they don't depend on the order of rows.
PART = 10**10
SLOT_BITS = 20
#: Words that are looked up where a text is read, the most frequent ones, at most so many; all others are joined.
FREQUENT = 1 << 17


#: What is known of a word where texts are read: its number (XXH64, seed 42), and its place among the frequent words or -1.
WORD = np.dtype([("number", ">u8"), ("hot", ">i4")])


class Words(dict):
    """The WORD records of words: kept for the frequent ones, given in their order, made anew for each other word."""

    def __init__(self, frequent: list[bytes] = ()):
        super().__init__((word, self._record(word, at)) for at, word in enumerate(frequent))

    @staticmethod
    def _record(word: bytes, at: int) -> bytes:
        return xxhash.xxh64_digest(word, 42) + at.to_bytes(4, "big", signed=True)

    def __missing__(self, word: bytes) -> bytes:
        return xxhash.xxh64_digest(word, 42) + b"\xff\xff\xff\xff"


def split(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of bytes other than a space and 9 to 13."""
    return (text or b"").lower().split()


def read_words(texts: list[bytes | None], names: Words) -> list[np.ndarray]:
    """For each text the WORD records of its words and of its end."""
    return [np.frombuffer(b"".join(map(names.__getitem__, [*split(t), END])), WORD) for t in texts]


def streams(texts: list[bytes | None], names: Words) -> list[np.ndarray]:
    """For each text the numbers of its words and of its end."""
    return [found["number"].astype(np.uint64) for found in read_words(texts, names)]


def hot_sums(places: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """For each text a row: how many words have a place, and for each column of values the sum of count * value.

    places: for each text, the places of its words in the rows of values, or -1. Each different word of a text adds its
    count * value rounded to a whole number of parts of PART, so the order of words makes no difference.
    """
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    flat = np.concatenate([np.zeros(0, np.int64), *places])
    pair, n = np.unique((row * max(1, len(values)) + flat)[flat >= 0], return_counts=True)
    row, place = np.divmod(pair, max(1, len(values)))
    out = np.zeros((len(places), 1 + values.shape[1]), np.int64)
    if len(pair):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        parts = np.column_stack((n, np.rint(n[:, None] * values[place] * PART).astype(np.int64)))
        out[row[first]] = np.add.reduceat(parts, first, axis=0)
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)
_NODE = (np.arange(CODES, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(20)
_DEEP = np.arange(BITS)


_CODE = np.arange(CODES)[:, None]
#: The nodes that each code passes in the binary tree of codes, and the bit it takes at each.
_PATHS = (1 << _DEEP) | (_CODE >> (BITS - _DEEP))
_TURNS = (_CODE >> (BITS - 1 - _DEEP)) & 1
_SIGNS = (1 - 2 * _TURNS).astype(np.float32)
#: Where a code counts at each of its nodes: a node's zeros come before its ones.
_STEPS = _PATHS * 2 + _TURNS


def codes_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(CODES - 1)).astype(np.int64)


def contexts(before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts but the empty one, from the numbers of the word before and the one before that."""
    with np.errstate(over="ignore"):
        first = (before ^ np.uint64(0x51ED27)) * _ODD
        second = (earlier ^ np.uint64(0xA2F1B5)) * _ODD
        second ^= second >> np.uint64(29)
        both = (first ^ (second * np.uint64(0xD6E8FEB86659FD93))) * _ODD
    return [h ^ (h >> np.uint64(31)) for h in (first, second, both)]


def spread(bits: int) -> np.ndarray:
    """What the nodes of each code's path add (by exclusive or) to a context's slot in a table of 2^bits entries."""
    return (_NODE[_PATHS] & np.uint64((1 << bits) - 1)).astype(np.int64)


def slots(contexts: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Slots of the contexts themselves in tables of 2^bits entries."""
    return [(h & np.uint64((1 << bits) - 1)).astype(np.int64) for h in contexts]


def laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row, the word before each in its text, and the one before that (0: none)."""
    lengths = np.array([len(t) for t in texts])
    flat, start = np.concatenate(texts), (np.cumsum(lengths) - lengths)[lengths > 0]
    found = [flat]
    for _ in range(2):
        before = np.zeros_like(flat)
        before[1:] = found[-1][:-1]
        before[start] = 0
        found.append(before)
    return tuple(found)


def stretched(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8.0, 8.0)


#: By a document's counts at a node, 256 * ones + zeros: the stretched probability, and the gate's class of how often.
_PAIR = np.arange(1 << 16)
_OWN = stretched(_PAIR // 256, _PAIR % 256).astype(np.float32)
_OFTEN = np.digitize(_PAIR // 256 + _PAIR % 256, (1, 3, 16)).astype(np.int8)


class Model:
    """Tables of the contexts (bytes of stretched probabilities), and the mixer's weights by gate."""

    def __init__(self, tables: list[np.ndarray], bits: int, weights: np.ndarray | None = None):
        self.tables, self.bits = tables, bits
        if weights is None:
            weights = np.zeros((GATES, INPUTS))
            weights[:, 0] = 1.0
        self.weights = weights.astype(np.float32)

    def read(self, texts: list[np.ndarray], learn: float = 0.0, own_rate: float = 0.05) -> np.ndarray:
        """Bits that each text costs: read side by side, STEP words at a time, after the first EARLY words LATER.

        Every bit of a word's code is predicted from the tables and from what the document had before the step; the
        gate is the bit's place and how often the document passed its node. After a step the document's counts take up
        its words (a node's two counts are halved when one passes 255 - LATER), and the offsets that a document adds to
        the weights move along the gradient. With `learn` the weights themselves move too, by SIDE texts at a time;
        without it a text costs the same beside any others.
        """
        cost = np.zeros(len(texts))
        by_length, wide = np.argsort([-len(t) for t in texts], kind="stable"), SIDE if learn else APART
        for at in range(0, len(texts), wide):
            side = by_length[at : at + wide]
            cost[side] = self._side([texts[i] for i in side], learn, own_rate)
        return cost

    def _side(self, texts: list[np.ndarray], learn: float, own_rate: float) -> np.ndarray:
        cost, lengths = np.zeros(len(texts)), np.array([len(t) for t in texts])
        seen = np.zeros(len(texts) * CODES, '<u2')  # ones in the upper byte
        counts = seen.view(np.uint8)
        offset = np.zeros((INPUTS, len(texts), 1), np.float32)
        squares = np.full((GATES, INPUTS), 1e-6)
        start = np.cumsum(lengths) - lengths
        flat, first, second = laid(texts)
        codes, hashed = codes_of(flat), slots(contexts(first, second), self.bits)
        apart, step = spread(self.bits), np.float32(1 / SCALE)
        empty = self.tables[0][_PATHS] * step
        constant = np.float32(0.3)
        longest = int(lengths.max(initial=0))
        for now in [*range(0, min(EARLY, longest), STEP), *range(EARLY, longest, LATER)]:
            n = np.clip(lengths - now, 0, STEP if now < EARLY else LATER)
            live = int((n > 0).sum())  # the longest come first
            n = n[:live]
            starts = np.cumsum(n) - n
            rows, doc = np.repeat(start[:live] + now - starts, n) + np.arange(n.sum()), np.repeat(np.arange(live), n)
            code = codes.take(rows)
            turn = _STEPS.take(code, axis=0)  # a row for each word, a column for each bit of its code, as in all that follows
            turn += (doc * (CODES * 2))[:, None]
            had, sign, far = seen.take(turn >> 1), _SIGNS.take(code, axis=0), apart.take(code, axis=0)
            x = [empty.take(code, axis=0)]
            x += [table.take(h.take(rows)[:, None] ^ far) * step for table, h in zip(self.tables[1:], hashed)]
            x += [_OWN.take(had), constant]
            gate = _OFTEN.take(had) + _DEEP * 4
            place = gate + (doc * GATES)[:, None]
            logit = np.zeros(gate.shape, np.float32)
            for i, part in enumerate(x):
                own = (self.weights[:, i] + offset[i, :live]).take(place)  # a text's weights by gate
                own *= part
                logit += own
            np.clip(logit, -12, 12, out=logit)
            logit *= sign
            miss = np.exp(logit, out=logit)  # odds against the bit that came
            cost[:live] += np.add.reduceat(np.log2(np.multiply.reduce(np.add(miss, 1, dtype=np.float64), axis=1)), starts)  # a logarithm for each word: BITS factors below e^12
            miss /= 1 + miss
            sign *= miss
            push, starts = np.negative(sign, out=sign), starts * BITS  # what the bit is above its probability
            if own_rate:
                rate = (own_rate / np.sqrt(n * BITS)).astype(np.float32)
                for i, part in enumerate(x):
                    offset[i, :live, 0] += rate * np.add.reduceat((push * part).ravel(), starts)
            if learn:
                gate = gate.ravel()
                many = np.bincount(gate, minlength=GATES)
                grad = np.stack([np.bincount(gate, weights=(push * part).ravel(), minlength=GATES) for part in x], axis=1)
                grad /= np.maximum(many, 1)[:, None]
                squares += grad * grad
                self.weights += (learn * grad / np.sqrt(squares)).astype(np.float32)
            np.add.at(counts, turn.ravel(), np.uint8(1))
            full = np.flatnonzero(counts[: live * CODES * 2] > 255 - LATER) // 2
            seen[full] = (seen[full] >> 1) & 0x7F7F
        return cost


def gathered(batches):
    """Batches put together to about GATHER bytes, so that many texts can be read side by side."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def counted(texts: list[np.ndarray], totals: list[np.ndarray], bits: int) -> None:
    """Adds how often the texts take each bit at each node of each context."""
    if not texts:
        return
    flat, first, second = laid(texts)
    totals[0][: CODES * 2] += np.bincount(_STEPS.ravel(), weights=np.repeat(np.bincount(codes_of(flat), minlength=CODES), BITS), minlength=CODES * 2).astype(np.uint32)
    apart = spread(bits) * 2 + _TURNS
    for at in range(0, len(flat), 1 << 13):
        cut = slice(at, at + (1 << 13))
        far = apart.take(codes_of(flat[cut]), axis=0)
        for k, h in enumerate(slots(contexts(first[cut], second[cut]), bits)):
            np.add.at(totals[k + 1], ((h * 2)[:, None] ^ far).ravel(), np.uint32(1))


def slot_bits(n_bytes: int) -> int:
    """A table's size follows the corpus: 2^20 slots to 1 GB, then a slot more for each cube root of 1 / 1,024 bytes."""
    return max(SLOT_BITS, math.ceil(math.log2(1024 * max(1, n_bytes) ** (1 / 3))))


def tables_of(docs: DataFrame, bits: int, names) -> list[np.ndarray]:
    """The contexts' tables over all rows of docs (text binary): counted in each task, summed block by block. names: Words, broadcast."""
    small_batches(docs.sparkSession)
    sizes = [max(BLOCK, CODES)] + [1 << bits] * (ORDERS - 1)

    def count(batches):
        totals = [np.zeros(n * 2, np.uint32) for n in sizes]
        for batch in batches:
            counted(streams(batch.column(0).to_pylist(), names.value), totals, bits)
        for k, total in enumerate(totals):
            for block in range(sizes[k] // BLOCK):
                own = total[block * BLOCK * 2 : (block + 1) * BLOCK * 2]
                if own.any():
                    planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes()  # upper bytes are mostly zero
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())], names=["k", "block", "counts"])

    def add(batches):
        key, total = None, None

        def told():
            ones, zeros = total[1::2].astype(np.float64), total[0::2].astype(np.float64)
            out = np.round(stretched(ones, zeros) * SCALE).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["k", "block", "steps"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if now != key:
                    if key:
                        yield told()
                    key, total = now, np.zeros(BLOCK * 2, np.int64)
                raw = pa.decompress(batch.column(2)[i].as_py(), BLOCK * 8, "zstd", asbytes=True)
                total += np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        if key:
            yield told()

    parts = docs.select("text").mapInArrow(frugal(count), "k int, block int, counts binary")
    parts = parts.repartition("k", "block").sortWithinPartitions("k", "block").mapInArrow(add, "k int, block int, steps binary")
    out = [np.zeros(n, np.int8) for n in sizes]
    for r in parts.toLocalIterator():  # 3 x 2^bits bytes and BLOCK
        out[r["k"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["steps"], np.int8)
    return out


def frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The words of counts (word, c) with the highest counts, as many whole steps of the count as hold at most `most`."""
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # about 1,000 rows
    least, held = None, 0
    for at, n in steps:
        held += n
        if held > (FREQUENT if most is None else most):
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.limit(0)


def weights_of(docs: DataFrame, sent, bits: int, learn: float, names) -> np.ndarray:
    """The mixer's weights after every task has read its rows of docs online, averaged by how much each has read."""

    def read(batches):
        model, n = Model(sent.value, bits), 0
        for batch in gathered(batches):
            texts = streams(batch.column(0).to_pylist(), names.value)
            model.read(texts, learn=learn)
            n += sum(map(len, texts))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES * INPUTS), pa.int32()), pa.array(np.round(model.weights.ravel().astype(np.float64) * 1e6).astype(np.int64) * n), pa.array([n] * (GATES * INPUTS))], names=["at", "w", "n"])

    found = docs.select("text").mapInArrow(frugal(read), "at int, w long, n long").groupBy("at").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()  # GATES x INPUTS rows
    out = Model([], bits).weights
    for r in found:
        out.ravel()[r["at"]] = float(r["w"]) / r["n"] / 1e6
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, mixing: int = 6, learn: float = 0.1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Tokens are the words, A-Z in lower case, and one end. Rows whose crc32 of the id modulo `folds` is `held` are held
    out; all others train. A word's probability has two factors. The BITS bits of its code (of XXH64) are predicted one
    by one: the contexts' predictors, tables of hashed (context, node) pairs with counts over all training rows but
    those of remainder `mixing`, and one of the document's own words so far are mixed in the logistic domain by weights
    that a gate picks; the weights are learned online from the rows of remainder `mixing` and go on moving within each
    document as it is read. The second factor is the word's share among the training words of its code, where (as in
    the base score) one place is kept for all words not known. Both are sums over the whole text; bits_per_byte is the
    total over the text's bytes, null where it has none.

    What is counted grows with the corpus: the words, which are counted and joined with all documents, and the tables,
    whose size follows the cube root of the bytes and that travel to all tasks (2^20 bytes each to 1 GB, 2^26 at 100 TB).
    The most frequent words, at most FREQUENT, go to all tasks with their counts; documents and all other words meet in a
    join on the word, with one row for each document that holds it. Ends are counted apart.

    Null texts are empty and have their end alone. Null ids train. Repeated rows count and are scored each. Without
    training rows a code costs BITS bits and all else nothing. An empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), fold.alias("fold"), F.col(text_col).cast("binary").alias("text"))
    small_batches(spark)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-documents", "zstd")

    def tally(batches):
        for table in gathered(batches):
            found = Counter(chain.from_iterable(map(split, table.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "c"])

    train = F.col("fold") != held
    code = F.xxhash64("word").bitwiseAND(F.lit(CODES - 1)).cast("int")
    counts = rows.where(train).select("text").mapInArrow(frugal(tally), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "lm-words")
    known = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    size = rows.agg(F.count_if(train).alias("docs"), F.sum(F.when(train, F.octet_length("text"))).alias("bytes")).first()
    ends = size["docs"] or 0
    total, different = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    classes = counts.withColumn("code", code).groupBy("code").agg((F.sum("c") + F.count(F.lit(1))).alias("t"))
    classes = {r["code"]: r["t"] + 1 for r in classes.collect()}  # CODES rows
    end_code = xxhash.xxh64_intdigest(END, 42) & (CODES - 1)
    classes[end_code] = classes.get(end_code, 1) + (ends + 1 if ends else 0)
    of_code = spark.createDataFrame(sorted(classes.items()), "code int, t long")

    each = math.log10(total + different + 1)
    found = frequent(counts).withColumn("code", code).collect()  # FREQUENT rows
    values = np.array([(math.log10(r["c"] + 1) - each, math.log10((r["c"] + 1) / classes[r["code"]])) for r in found]).reshape(-1, 2)
    values = spark.sparkContext.broadcast(values)
    names = spark.sparkContext.broadcast(Words([r["word"] for r in found]))

    def words(batches):
        is_hot = names.value.__contains__
        for batch in batches:
            row, word, n = [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(filterfalse(is_hot, split(text)))
                row += [at] * len(found)
                word += found
                n += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["row", "word", "n"])

    bits = slot_bits(size["bytes"] or 0)
    tables = spark.sparkContext.broadcast(tables_of(rows.where(train & (F.col("fold") != mixing)), bits, names))
    weights = weights_of(rows.where(F.col("fold") == mixing), tables, bits, learn, names)

    def score(batches):
        model = Model(tables.value, bits, weights)
        for table in gathered(batches):
            texts = read_words(table.column(0).to_pylist(), names.value)
            cost = np.round(model.read([t["number"].astype(np.uint64) for t in texts]) * PART).astype(np.int64)
            known, base, share = hot_sums([t["hot"][:-1] for t in texts], values.value).T  # ends are counted apart
            own = table.select(["row", "doc_id", "fold", "bytes"])
            for name, column in (("n_tokens", [len(t) for t in texts]), ("cost", cost), ("known", known), ("base", base), ("share", share)):
                own = own.append_column(name, pa.array(column, pa.int64()))
            yield from own.to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.select("text", "row", "doc_id", "fold", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(frugal(score), f"row long, doc_id {kind}, fold int, bytes long, n_tokens long, cost long, known long, base long, share long")
    whole = lambda x: F.round(F.col("n") * x * PART).cast("long")
    c = F.coalesce("c", F.lit(0)) + 1
    found = rows.select("row", "text").mapInArrow(words, "row long, word binary, n long").join(counts.hint("shuffle_hash"), "word", "left").withColumn("code", code).join(F.broadcast(of_code), "code", "left")
    found = found.select("row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("known"), whole(F.log10(c) - F.lit(each)).alias("base"), whole(F.log10(c / F.coalesce("t", F.lit(1)))).alias("share"))
    both = read.unionByName(found, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("fold").alias("fold"), F.max("bytes").alias("bytes"), F.max("n_tokens").alias("n_tokens"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("cost", "known", "base", "share")))
    end_base, end_share = math.log10((ends + 1) / (total + different + 1)), math.log10((ends + 1) / classes[end_code]) if ends else 0.0
    base = F.col("base") / PART + F.lit(end_base)
    score = F.col("share") / PART + F.lit(end_share) - F.col("cost") / PART * math.log10(2)
    out = both.select("doc_id", (F.col("fold") == held).alias("held_out"), "n_tokens", (F.col("known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.cast("double").alias("base_score"), score.cast("double").alias("score"), "bytes")
    return out.withColumn("bits_per_byte", F.when(F.col("bytes") > 0, -F.col("score") / math.log10(2) / F.col("bytes"))).drop("bytes")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
