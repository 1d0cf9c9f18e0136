"""Line dedup: overlapping documents by shared rare lines, aligned by patience diff."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, frugal, materialize, small_batches


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, given by rising first number, whose second numbers rise too."""
    tails: list[int] = []  # smallest last value of a chain of each length
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, e) in enumerate(pairs):
        k = bisect_left(tails, e)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [e], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(later: dict[int, int], earlier: dict[int, int], n_later: int, n_earlier: int) -> list[tuple[int, int]]:
    """Aligned places (later, earlier) of two documents, by place of the lines that both have.

    later, earlier: line by place. Equal lines at both ends of a range are aligned first; then the lines that stand once
    in both ranges are, along their longest rising chain; and the ranges between these are worked on alike.
    """
    out, stack = [], [(0, n_later, 0, n_earlier)]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and a in later and later[a] == earlier.get(c):
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and b - 1 in later and later[b - 1] == earlier.get(d - 1):
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once: list[dict[int, int]] = []
        for lines, x, y in ((later, a, b), (earlier, c, d)):
            at: dict[int, int] = {}
            for place in lines if y - x > len(lines) else range(x, y):
                if x <= place < y and (line := lines.get(place)) is not None:
                    at[line] = -1 if line in at else place
            once.append(at)
        chain = longest_rising(sorted((p, q) for line, p in once[0].items() if p >= 0 and (q := once[1].get(line, -1)) >= 0))
        for (p, q), (r, s) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)]) if chain else ():
            stack.append((p + 1, r, q + 1, s))
        out += chain
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], words: dict[int, int], least: int) -> list[tuple[int, int]]:
    """Ranges (first, last place in the later document) of unbroken aligned runs with at least `least` words."""
    out, i = [], 0
    while i < len(aligned):
        j = i
        while j + 1 < len(aligned) and aligned[j + 1][0] == aligned[j][0] + 1 and aligned[j + 1][1] == aligned[j][1] + 1:
            j += 1
        if sum(words[p] for p, _ in aligned[i : j + 1]) >= least:
            out.append((aligned[i][0], aligned[j][0]))
        i = j + 1
    return out


#: A line of a packed document: hash, words, number of the line in the text.
_LINE = np.dtype([("hash", "V16"), ("words", "<i4"), ("line", "<i4")])
_GAP = bytes(16)


def packed(text: bytes) -> np.ndarray:
    """The lines of a text that are not empty, without white space at their ends."""
    lines = [(n, said) for n, x in enumerate(text.split(b"\n")) if (said := x.strip(b" \t\r\f\x0b"))]
    return np.array([(xxhash.xxh3_128_digest(said), len(said.split()), n) for n, said in lines], dtype=_LINE)


def runs(lines: np.ndarray, least: int) -> dict[bytes, list[tuple[int, int]]]:
    """Places (first, last line) of the shortest runs of at least `least` words, by the hash of their lines.

    The shortest ones that begin and that end at each line, and where empty lines stand before it also the shortest one
    that reaches over them. Any block of `least` words is covered by such runs inside it, with the empty lines in it.
    Single lines of fewer words are there without places.
    """
    hashes, words, number = lines["hash"].tolist(), lines["words"].tolist(), lines["line"].tolist()
    n, found = len(words), set()
    sums = [0, *np.cumsum(lines["words"]).tolist()]
    j = 0
    for i in range(n):  # begins at i
        while j < n and sums[j] - sums[i] < least:
            j += 1
        if sums[j] - sums[i] < least:
            break
        found.add((i, j - 1))
    i = 0
    for j in range(n):  # ends at j
        while i < j and sums[j + 1] - sums[i + 1] >= least:
            i += 1
        if sums[j + 1] - sums[i] >= least:
            found.add((i, j))
            if i == j and j and number[j] > number[j - 1] + 1:
                found.add((j - 1, j))
    out: dict[bytes, list[tuple[int, int]]] = {key: [] for key in hashes}
    for i, j in sorted(found):
        key = hashes[i] if i == j else xxhash.xxh3_128_digest(b"".join(hashes[i : j + 1]))
        out.setdefault(key, []).append((number[i], number[j]))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8, min_words: int = 5, tried: list[int] | None = None) -> DataFrame:
    """Ranges of lines to delete: (id, text_hash, ranges array<struct<first, last>>), line numbers from 0.

    Each pair of a document and an earlier one is aligned on all lines that both hold, and all pairs count that can delete
    anything. Of equal texts, the one with the smallest id stands for all; the others go whole. A line, or run of lines of
    `min_words` words, that at most `rare` texts hold leads from each to every earlier one. A run of more leads each to
    the first that holds it, which deletes it nearly always. Where it is left, as it stands in another order there or more
    often here, all earlier ones are tried: those that share no rare line with the document meet it in frequent lines
    alone, so texts are classes by their outline, the frequent lines with what stands between as gaps. An outline meets
    the holders of its runs in rounds, a few first and eight times as many in each further one, until all places of its
    runs are deleted or all holders have been tried: a block consists of such runs, so no other holder could add to it. `tried` gets how many pairs of outlines each round aligned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    ranges = "array<struct<first:int,last:int>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def pack(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()), pa.array([packed(x).tobytes() for x in texts], pa.binary())], names=["id", "text_hash", "whole", "lines"])

    held = materialize(rows.mapInArrow(frugal(pack), f"id {id_type}, text_hash long, whole binary, lines binary"), "lines", compression="zstd")
    firsts = materialize(held.groupBy("whole").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("lines").alias("lines")).select("whole", "first.*", "lines"), "lines-first", compression="zstd")

    def span(batches):
        """Copies: all from the first to the last line, if long enough for a block."""
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), dtype=_LINE) for x in batch.column(2)]
            found = [[{"first": int(x["line"][0]), "last": int(x["line"][-1])}] if x["words"].sum() >= min_words else [] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["id", "text_hash", "ranges"])

    copies = held.join(firsts.select("whole", F.col("id").alias("e_id")), "whole").where("id > e_id").select("id", "text_hash", "lines")
    copies = copies.mapInArrow(frugal(span), f"id {id_type}, text_hash long, ranges {ranges}")

    def split(batches):
        for batch in batches:
            out = [(i, t, k, at) for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) for k, at in runs(np.frombuffer(x.as_buffer(), dtype=_LINE), min_words).items()]
            if out:
                i, t, k, at = zip(*out)
                at = [[{"first": a, "last": b} for a, b in x] for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(i, batch.column(0).type), pa.array(t, pa.int64()), pa.array(k, pa.binary()), pa.array(at, kind)], names=["id", "text_hash", "run", "at"])

    all_runs = firsts.select("id", "text_hash", "lines").mapInArrow(frugal(split), f"id {id_type}, text_hash long, run binary, at {ranges}")
    all_runs = materialize(all_runs, "runs", compression="zstd")
    known = all_runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "text_hash")).alias("first")).where("n > 1")
    shared = materialize(all_runs.join(known, "run"), "runs-shared", compression="zstd")
    drop_table(all_runs)
    often = shared.where((F.col("n") > rare) & (F.col("id") > F.col("first.id")) & (F.size("at") > 0))
    few = shared.where(F.col("n") <= rare).select("run", "id", "text_hash")
    earlier = shared.select("run", F.col("id").alias("e_id"), F.col("text_hash").alias("e_hash"))
    pair = ["id", "text_hash", "e_id", "e_hash"]
    to_first = often.select("id", "text_hash", F.col("first.id").alias("e_id"), F.col("first.text_hash").alias("e_hash"))
    pairs = few.join(earlier, "run").where("id > e_id").select(pair).unionByName(to_first).distinct()

    def align(batches):
        known: dict[tuple, tuple[list[bytes], set[bytes]]] = {}

        def lines(name, data):
            if name not in known:
                if len(known) >= 256:
                    known.clear()
                hashes = np.frombuffer(data.as_buffer(), dtype=_LINE)["hash"].tolist()
                known[name] = hashes, set(hashes)
            return known[name]

        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(4)]
            found = []
            for i, t, e, f, mine, other in zip(*names, batch.column(4), batch.column(5)):
                (a, a_set), (b, b_set) = lines((i, t), mine), lines((e, f), other)
                both = (a_set & b_set) - {_GAP}
                later, before = ({p: x for p, x in enumerate(y) if x in both} for y in (a, b))
                x = np.frombuffer(mine.as_buffer(), dtype=_LINE)
                words, number = x["words"].tolist(), x["line"].tolist()
                found.append([{"first": number[p], "last": number[q]} for p, q in blocks(patience(later, before, len(a), len(b)), words, min_words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["id", "text_hash", "ranges"])

    def aligned(pairs: DataFrame) -> DataFrame:
        other = firsts.select(F.col("id").alias("e_id"), F.col("text_hash").alias("e_hash"), F.col("lines").alias("e_lines"))
        met = pairs.join(firsts.drop("whole"), ["id", "text_hash"]).join(other, ["e_id", "e_hash"]).select(*pair, "lines", "e_lines")
        found = met.mapInArrow(frugal(align), f"id {id_type}, text_hash long, ranges {ranges}")
        return together(found)

    def together(found: DataFrame) -> DataFrame:
        return found.where(F.size("ranges") > 0).groupBy("id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"))

    once = materialize(aligned(pairs), "ranges")
    gone = lambda x: F.exists(F.coalesce("ranges", F.array().cast(ranges)), lambda r: (r["first"] <= x["first"]) & (x["last"] <= r["last"]))
    stays = lambda held, ranges: held.join(ranges, ["id", "text_hash"], "left").select("run", "id", "text_hash", F.filter("at", lambda x: ~gone(x)).alias("at")).where(F.size("at") > 0)
    left = materialize(stays(often, once), "runs-left", compression="zstd")

    def outline(batches):
        for batch in batches:
            key, lines, number = [], [], []
            for data, own in zip(batch.column(2), batch.column(3).to_pylist()):
                x, own = np.frombuffer(data.as_buffer(), dtype=_LINE), set(own)
                stays = np.array([h in own for h in x["hash"].tolist()])
                x = x[stays | np.concatenate(([True], stays[:-1]))].copy()  # one line of each gap
                x["hash"][[h not in own for h in x["hash"].tolist()]] = _GAP
                number.append(x["line"].tolist())
                key.append(xxhash.xxh3_128_digest(x["hash"].tobytes()))
                x["line"] = np.arange(len(x))
                lines.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(lines, pa.binary()), pa.array(number, pa.list_(pa.int32()))], names=["id", "text_hash", "outline", "lines", "number"])

    asked = shared.join(left.select("run").distinct(), "run", "left_semi").select("run", "id", "text_hash")
    # a line's run is its own hash, so the frequent lines of a text are among its shared runs
    frequent = shared.where(F.col("n") > rare).join(asked.select("id", "text_hash").distinct(), ["id", "text_hash"], "left_semi").groupBy("id", "text_hash").agg(F.collect_list("run").alias("own"))
    outlines = firsts.drop("whole").join(frequent, ["id", "text_hash"]).select("id", "text_hash", "lines", "own")
    outlines = materialize(outlines.mapInArrow(frugal(outline), f"id {id_type}, text_hash long, outline binary, lines binary, number array<int>"), "outlines", compression="zstd")
    of = outlines.select("id", "text_hash", "outline")
    there = asked.join(of, ["id", "text_hash"]).select("run", F.col("outline").alias("e_outline")).distinct()
    one = outlines.groupBy("outline").agg(F.min("id").alias("e_id"), F.min("lines").alias("lines"))
    one = materialize(one, "outlines-once", compression="zstd")
    holders = there.groupBy("run").agg(F.count(F.lit(1)).alias("holders"))
    # a number from 0 to the number of a run's holders, by hash: the order in which they are tried
    turn = F.pmod(F.xxhash64("e_outline"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("holders")
    there = there.join(one.select(F.col("outline").alias("e_outline"), "e_id"), "e_outline").join(holders, "run").withColumn("turn", turn).drop("holders")
    there = materialize(there, "outlines-holders", compression="zstd")
    most = there.agg(F.max("turn")).first()[0]

    def align_outlines(batches):
        for batch in batches:
            names = [batch.column(0), pa.nulls(batch.num_rows, pa.int64()), batch.column(1), pa.nulls(batch.num_rows, pa.int64()), batch.column(3), batch.column(4)]
            for found in align([pa.RecordBatch.from_arrays(names, names=[*pair, "lines", "e_lines"])]):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found.column(2)], names=["outline", "e_id", "ranges"])

    number = lambda k: F.get("number", F.col(f"at.{k}")).alias(k)
    found, first, last = [once], 0, 4
    while most is not None and first <= most and left.limit(1).count():
        # each outline that still holds a run meets the next of its holders; one whose runs are all deleted meets no more
        here = left.join(of, ["id", "text_hash"]).groupBy("run", "outline").agg(F.max("id").alias("last_id"))
        pairs = here.join(there.where((F.col("turn") >= first) & (F.col("turn") < last)), "run").where("last_id > e_id").select("outline", "e_outline", "e_id").distinct()
        if tried is not None:
            tried.append(pairs.count())
        met = pairs.join(one.select("outline", "lines"), "outline").join(one.select(F.col("outline").alias("e_outline"), F.col("lines").alias("e_lines")), "e_outline")
        met = met.select("outline", "e_outline", "e_id", "lines", "e_lines").mapInArrow(frugal(align_outlines), f"outline binary, e_id {id_type}, ranges {ranges}")
        met = met.select("outline", "e_id", F.explode("ranges").alias("at")).groupBy("outline", "at").agg(F.min("e_id").alias("e_id"))
        more = outlines.join(met, "outline").where("id > e_id").select("id", "text_hash", F.array(F.struct(number("first"), number("last"))).alias("ranges"))
        found.append(materialize(together(more), "ranges"))
        left = materialize(stays(left, found[-1]), "runs-left", compression="zstd")
        first, last = last, last * 8
    for more in found:
        copies = copies.unionByName(more)
    return together(copies)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8, min_words: int = 5) -> DataFrame:
    """docs with the aligned common blocks deleted from the later document of each pair; adds n_lines and n_removed.

    A document is later if its id is larger. Lines are compared without white space at their ends; empty ones are never
    deleted but inside a block. A block has at least min_words words. Rows with a null id or text stay as they are and
    are nobody's partner; a null text has 0 lines, an empty one has 1. Rows with equal ids are not compared with each
    other, and equal rows are treated alike. Long texts are compared whole. An empty table gives an empty result. All
    columns of docs are kept; columns named n_lines or n_removed are replaced.
    """
    found = repeats(docs, id_col, text_col, rare, min_words).select(F.col("id").alias("_ld_id"), F.col("text_hash").alias("_ld_hash"), F.col("ranges").alias("_ld_ranges"))
    rows = docs.drop("n_lines", "n_removed").withColumn("_ld_key", F.xxhash64(text_col))
    both = rows.join(found, (F.col(id_col) == F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_hash")), "left")
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("_ld_ranges", lambda r: (r["first"] <= i) & (i <= r["last"])))
    both = both.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    both = both.withColumn("_ld_kept", F.when(F.col("_ld_ranges").isNotNull(), kept))
    both = both.withColumn("n_removed", F.when(F.col("_ld_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_ld_kept")).cast("long"))
    both = both.withColumn(text_col, F.when(F.col("_ld_kept").isNull(), F.col(text_col)).otherwise(F.array_join("_ld_kept", "\n")))
    return both.drop("_ld_key", "_ld_id", "_ld_hash", "_ld_ranges", "_ld_kept")


def op4(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text, 256).alias("kept_sha256"))
