"""The operators on documents against plain versions of them."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tallyforge.llm import line_dedup, mixing, sentencepiece_dropout as spd, sharding, simhash, suffix_dedup, token_output, toxicity

from .fixtures import documents, rows
from .test_pipeline import plain_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(*values):
    """XXH64 of a row's values in turn, seed 42, as a signed number; nulls are passed over, a number is 8 bytes or (4-byte) 4."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_ring(data, shards, virtual_nodes):
    """(shard, slot) of each row by a walk of the ring, key by key."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", seed=42) - (1 << 63), s) for s in range(shards) for v in range(virtual_nodes))
    room = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]
    arcs = [[] for _ in points]
    for n, r in enumerate(data):
        text = (r[1] or "").encode()
        key = hashed(r[0]) if r[0] is not None else hashed(None if r[1] is None else text)
        arc = next((i for i, (p, _) in enumerate(points) if p >= key), 0)
        arcs[arc].append((key, r[0] is not None, r[0] or 0, zlib.crc32(text), len(text), n))
    where, late = {}, []
    for arc in arcs:
        arc.sort()
    for (_, s), arc in zip(points, arcs):  # first every arc's own shard
        fits = min(len(arc), room[s])
        room[s] -= fits
        where |= {x: s for x in arc[:fits]}
        late.append(arc[fits:])
    walking = []
    for turn in range(2):  # then what is over goes on clockwise, what has come last first
        for i, (_, s) in enumerate(points):
            while room[s] and walking:
                where[walking[-1].pop(0)] = s
                room[s] -= 1
                if not walking[-1]:
                    walking.pop()
            if not turn and late[i]:
                walking.append(late[i])
    used, out = Counter(), {}
    for arc in arcs:
        for x in arc:
            out[x[-1]] = where[x], used[where[x]]
            used[where[x]] += 1
    return out


@pytest.mark.parametrize("shards,virtual_nodes", [(7, 16), (3, 1), (40, 4), (1, 2)])
def test_sharding_equals_a_walk_of_the_ring(spark, shards, virtual_nodes):
    data = rows()
    found = sharding.shard(documents(spark), shards=shards, virtual_nodes=virtual_nodes).collect()
    want = plain_ring(data, shards, virtual_nodes)
    size = lambda t: len((t or "").encode()) + 16
    assert counted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == counted((r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), *want[n]) for n, r in enumerate(data))


def counted(found) -> Counter:
    return Counter(map(tuple, found))


def test_sharding(spark):
    docs = documents(spark)
    found = sharding.shard(docs, shards=7, virtual_nodes=16).collect()
    assert counted((r.doc_id, r.size, r.text_crc32) for r in found) == counted((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    sizes = Counter(r.shard for r in found)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    assert sharding.shard(docs.limit(0), shards=7).count() == 0


def test_ring_moves_little():
    loads = np.full(6 * 64, 100)
    _, six = sharding.ring(6, 64)
    plan = sharding.spread(loads, six, 6)
    assert sum(n for *_, n, _ in plan) == loads.sum()
    assert sum(n for a, _, n, s in plan if s == six[a]) > 0.8 * loads.sum()


def test_a_larger_ring_moves_few_keys():
    """From 40 to 41 shards: a new shard's part of the keys moves to it, and the overflow of full shards little more."""
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(-(1 << 63), 1 << 63, 100_000))

    def placed(shards):
        points, owners = sharding.ring(shards, 128)
        arc = np.searchsorted(np.array(points), keys) % len(points)
        where = np.empty(len(keys), dtype=np.int64)
        rank = np.empty(len(keys), dtype=np.int64)
        for a in np.unique(arc):
            own = np.flatnonzero(arc == a)
            rank[own] = np.arange(len(own))
        for a, first, n, s in sharding.spread(np.bincount(arc, minlength=len(points)), owners, shards):
            where[(arc == a) & (rank >= first) & (rank < first + n)] = s
        return where

    before, after = placed(40), placed(41)
    assert np.bincount(after).max() - np.bincount(after).min() <= 1
    assert (before != after).mean() < 0.06 and ((before != after) & (after != 40)).mean() < 0.035


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = documents(spark)
    found = simhash.near_dedup(docs).collect()
    want = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    prints = sorted({f for _, f in want})
    group = {f: f for f in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    low = {}
    for i, f in want:
        if i is not None:
            low[group[f]] = min(low.get(group[f], i), i)
    assert counted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == counted((i, f, low.get(group[f])) for i, f in want)
    assert simhash.near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,n", [(8, 400), (64, 1500)])
def test_trie_join(spark, leaf, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(3)]))
    edges = simhash.trie_join(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), leaf=leaf).collect()
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    got = simhash.forest(len(values), [(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))])
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
    assert (got == simhash.forest(len(values), [(i, j)])).all()


def brute_removals(docs, width=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - width + 1) if i is not None else ():
            w = b[k : k + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1) if i is not None else ():
            if first[b[k : k + width]] < i:
                gone[k : k + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(spark):
    docs = documents(spark)
    found = suffix_dedup.removals(docs, part_bytes=20_000).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == counted(brute_removals([(r[0], r[1]) for r in rows()]))
    assert suffix_dedup.removals(docs.limit(0)).count() == 0


def test_suffix_dedup_of_repetitive_texts(spark):
    data = [(i, ("ab" * (40 + i)) + "c" * i + "ab" * 30) for i in range(12)] + [(50, "z" * 200), (51, "z" * 60), (52, "y" + "z" * 49)]
    found = suffix_dedup.removals(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == counted(brute_removals(data))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs, tokenizer = documents(spark), Tokenizer.from_file(path)
    found = token_output.digests(docs, path, block=4000, lanes=64).collect()
    start, want = 0, []
    data = [(r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")) for r in rows()]
    for i, ids in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1].astype("<u2").tobytes())):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert counted(found) == counted(want)
    assert token_output.digests(docs.limit(0), path).count() == 0


def test_added_tokens_keep_their_case():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|EndOfText|> b", "A <|ENDOFTEXT|>\nx<|endoftext|>y <|StartOfText|>Z", "<|endoftext|> Plain"]
    found = [np.frombuffer(x, "<u2").tolist() for x in token_output.Encoder(path)(texts)]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (63, 2), (5000, 1), (70_000, 3000)])
def test_rans_blocks(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1).astype(np.int64) if n else np.empty(0, np.int64)
    table = token_output.scaled(np.bincount(ids, minlength=kinds + 5))
    assert not n or table.freq.sum() == 1 << token_output.SCALE
    if not n:
        return
    block = token_output.encode_block(ids, table, lanes=32, every=16)
    assert (token_output.decode_block(block, table) == ids).all()
    marks = len(block["check_at"])
    parts = [token_output.decode_block(block, table, i, i + 1 if i < marks else None) for i in range(marks + 1)]
    assert (np.concatenate(parts) == ids).all()


def test_damaged_block_is_found(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tallyforge.llm.common import shared_path
    from pyspark.sql import functions as F

    where = shared_path(spark, "damaged")
    freq = token_output.write(documents(spark), where, path)
    blocks = spark.read.parquet(f"{where}/blocks").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{where}2/blocks")
    spark.read.parquet(f"{where}/table").write.parquet(f"{where}2/table")
    with pytest.raises(Exception, match="checksum"):
        token_output.read(spark, f"{where}2", len(freq)).collect()


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark)
    found = spd.encode(docs, path).collect()
    assert all(r.lossless for r in found) and len(found) == len(rows())
    assert counted((r.doc_id, r.text_bytes, r.text_crc32) for r in found) == counted((r[0], len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows())
    back = spd.decode(spd.encode(docs, path), path).collect()
    assert counted((r.doc_id, r.text) for r in back) == counted((r[0], r[1] or "") for r in rows())
    plain, own = sentencepiece.SentencePieceProcessor(model_file=path), spd.Segmenter(path, 1, 0.0, 1)
    texts = [r[1] for r in rows() if r[1] and "▁" not in r[1]]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts, ["k"] * len(texts))] == plain.encode(texts)
    assert spd.encode(docs.limit(0), path).count() == 0


def test_dropout_depends_on_seed_and_document_alone():
    path = public_tokenizers.path("piece_bpe_32k.model")
    a, b, c = (spd.Segmenter(path, s, 0.3, 4) for s in (1, 1, 2))
    text = "the river stone across the green hills tomorrow " * 20
    b.encode(["other words first " * 9], ["z"])
    assert a.encode([text], ["d1"]) == b.encode([text], ["d1"])
    assert a.encode([text], ["d1"]) != a.encode([text], ["d2"]) and a.encode([text], ["d1"]) != c.encode([text], ["d1"])
    chunks, keys = [" river", "x▁y", " " * 70, "Ünïcode", "日本"], [1, 2, 3, 4, 5]
    assert a.vocabulary.segment_all(chunks, keys, a.dropout) == [np.array(a.vocabulary.segment(x, k, a.dropout), "<u2").tobytes() for x, k in zip(chunks, keys)]


def plain_dropout(model, chunk, key, dropout):
    """Byte-pair merging over a list of parts: at each step the best pair of neighbours that is not skipped, the first of equals."""
    mask = (1 << 64) - 1
    score = {model.id_to_piece(i).replace("\u2581", " "): (model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    parts = [(i, i + 1) for i in range(len(chunk))]

    def skipped(a, b):
        h = ((key ^ (a * 0x9E3779B97F4A7C15) ^ (b * 0xC2B2AE3D27D4EB4F)) * 0xFF51AFD7ED558CCD) & mask
        h ^= h >> 33
        return ((h * 0x9E3779B97F4A7C15) & mask) >> 32 < dropout

    while True:
        best = [(-score[chunk[a:d]][0], a, k) for k, ((a, _), (_, d)) in enumerate(zip(parts, parts[1:])) if chunk[a:d] in score and not skipped(a, d)]
        if not best:
            break
        k = min(best)[2]
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
    out = []
    for a, b in parts:
        out += [score[chunk[a:b]][1]] if chunk[a:b] in score else [model.piece_to_id(f"<0x{x:02X}>") for x in chunk[a:b].encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_dropout_equals_plain_merging(dropout):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, run = sentencepiece.SentencePieceProcessor(model_file=path), spd.Segmenter(path, 5, dropout)
    rng = np.random.default_rng(3)
    chunks = [" river", " extraordinarily", "  tomorrow", "x\u2581y", "\u65e5\u672c", " aaaaaaaa", "\n", " na\u00efve", " international" * 1, " the"]
    for chunk in chunks:
        for key in rng.integers(0, 1 << 63, 12).tolist():
            want = plain_dropout(model, chunk, key, run.dropout)
            assert run.vocabulary.segment(chunk, key, run.dropout) == want
            assert run.vocabulary.segment_all([chunk], [key], run.dropout) == [np.array(want, run.vocabulary.kind).tobytes()]


def test_every_place_has_its_own_dropout():
    run = spd.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 1, 0.3)
    cuts = run.encode(["tomorrow"] * 300, [f"d{i}" for i in range(300)])
    assert len(set(cuts)) > 8 and {run.decode(x) for x in cuts} == {b"tomorrow"}


def plain_taken(data, targets, sums):
    """What each row gives: whole epochs, and of the last one the rows by their keys up to the budget."""
    out = Counter()
    for source in sums:
        own = [(hashed(struct.pack("<i", 42), r[0], None if r[3] is None else r[3].encode(), None if r[1] is None else r[1].encode()), r[0] is not None, r[0] or 0, len(WORD.findall(r[1] or "")), r[0]) for r in data if r[3] == source]
        budget = int(targets[source] + 1e-9)
        epochs, so_far = min(2, budget // sums[source]) if sums[source] else 0, 0
        for *_, n, i in sorted(own, key=lambda x: x[:4]):
            part = max(0, min(n, budget - epochs * sums[source] - so_far))
            out[i, n, source, min(2 * n, epochs * n + part)] += 1
            so_far += n
    return out


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing(spark):
    docs = documents(spark)
    found = mixing.mix(docs, rows_per_bucket=5).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sums, want = defaultdict(int), rows()
    for r in want:
        sums[r[3]] += size(r[1])
    assert counted((r.doc_id, r.size, r.source, r.source_size) for r in found) == counted((r[0], size(r[1]), r[3], sums[r[3]]) for r in want)
    targets, taken = brute_targets(sums), defaultdict(int)
    for r in found:
        assert r.target == pytest.approx(targets[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(targets[s] + 1e-9) for s in sums)
    assert counted((r.doc_id, r.size, r.source, r.taken) for r in found) == plain_taken(want, targets, sums)
    assert counted(found) == counted(mixing.mix(docs.repartition(1)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    docs = documents(spark)
    found = line_dedup.dedup(docs).collect()
    gone = plain_lines(sorted({(r[0], r[1]) for r in rows() if r[0] is not None and r[1] is not None}))
    want = []
    for r in rows():
        lines = [] if r[1] is None else r[1].split("\n")
        cut = gone.get((r[0], r[1]), set())
        want.append((r[0], None if r[1] is None else "\n".join(x for n, x in enumerate(lines) if n not in cut), len(lines), len(cut)))
    assert counted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found) == counted(want)
    assert sum(w[3] for w in want) > 20 and set(docs.columns) < set(line_dedup.dedup(docs).columns)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def every_pair(docs, least=5):
    """Lines that go, by aligning each document with every earlier one on all lines that both hold."""
    clean = [(i, [(n, y) for n, x in enumerate(t.split("\n")) if (y := x.strip(" \t\r\f\x0b"))]) for i, t in docs]
    gone = {i: set() for i, _ in docs}
    for i, a in clean:
        for e, b in clean:
            both = {x for _, x in a} & {x for _, x in b}
            if e < i and both:
                later, earlier = ({p: x for p, (_, x) in enumerate(y) if x in both} for y in (a, b))
                words = {p: len(WORD.findall(x)) for p, (_, x) in enumerate(a)}
                for p, q in line_dedup.blocks(line_dedup.patience(later, earlier, len(a), len(b)), words, least):
                    gone[i].update(range(a[p][0], a[q][0] + 1))
    return gone


def test_line_dedup_equals_every_pair(spark):
    rng = np.random.default_rng(8)
    common = ["by the river", "under stones", "a paper moon", "seven birds fly over green hills", "fire", "", "never across the hills again tomorrow"]
    split = [(0, "under stones")] + [(i, f"own line number {i}\nby the river\nunder stones\na paper moon\nend of {i}") for i in range(1, 15)]
    order = [(20, "x y z u v\np q r s t")] + [(i, f"p q r s t\nx y z u v\nonly {i} is here") for i in range(21, 35)]
    twice = [(i, "\n".join(["l m n o p"] * (1 + (i % 3)) + [f"tail {i}"])) for i in range(40, 54)]
    mixed = [(i, "\n".join(common[k] for k in rng.integers(0, len(common), rng.integers(1, 9)))) for i in range(60, 120)]
    data = split + order + twice + mixed
    found = line_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    gone = every_pair(data)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in data}
    assert {r.doc_id: r.text for r in found} == want
    assert "by the river" not in want[5]


def crossed(n, seed=3):
    """Texts that hold two frequent lines in another order than the first holder, among short frequent and own lines."""
    rng = np.random.default_rng(seed)
    out = [(0, "x y z u v\np q r s t")]
    for i in range(1, n):
        lines = ["p q r s t", "x y z u v"]
        for k in range(9):
            lines.insert(int(rng.integers(0, len(lines) + 1)), f"short {k}")
        out.append((i, "\n".join(x for k, line in enumerate(lines) for x in (line, f"own {i} {k}"))))
    return out


def test_crossed_lines_do_not_meet_in_all_pairs(spark):
    made = {}
    for n in (100, 400):
        made[n] = tried = []
        data = crossed(n)
        found = {r.id: r.ranges for r in line_dedup.repeats(spark.createDataFrame(data, "doc_id long, text string"), tried=tried).collect()}
        if n == 100:
            got = {i: {k for a, b in found.get(i, []) for k in range(a, b + 1)} for i, _ in data}
            assert got == every_pair(data) and sum(map(len, got.values())) > n
    assert sum(made[400]) < 8 * sum(made[100]) and sum(made[400]) < 400 * 399 / 2 / 5, made


def test_patience_aligns_around_unique_lines():
    a, b = dict(enumerate("xabcyd")), dict(enumerate("abczxd"))
    assert line_dedup.patience(a, b, 6, 6) == [(1, 0), (2, 1), (3, 2), (5, 5)]
    assert line_dedup.longest_rising([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]


def brute_segments(s):
    """All maximal scoring segments by their definition, largest first."""
    out, spans = [], [(0, len(s))]
    while spans:
        a, b = spans.pop()
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-12:
            out.append((best[3], best[4]))
            spans += [(a, best[3]), (best[4], b)]
    return sorted(out)


def test_segments():
    rng = np.random.default_rng(3)
    for n in range(0, 24):
        s = rng.normal(-0.2, 1, n)
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == brute_segments(s.tolist())
        assert all(x == pytest.approx(s[a:b].sum()) for a, b, x in got)


def test_toxicity(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet")
    model = toxicity.learn(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(found[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(p >= 0.5) == bool(y) for p, y in held]) > 0.97
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.96
    odd = toxicity.score(documents(spark), model).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(documents(spark).limit(0), model).count() == 0
    assert toxicity.keep(documents(spark), model).columns == documents(spark).columns


def test_repeated_passages_are_found():
    model = toxicity.Model({"vile": 3.0, "scum": 3.0}, 0.5, 1.0, 0.01, (-2.0, 0.5, 1.0))
    text = " ".join(["vile", *["calm"] * 30, "scum", *["calm"] * 30, *["vile", "scum"] * 6, *["calm"] * 60, *["vile", "scum"] * 6])
    found = model.passages(toxicity.word_scores(text, toxicity.Scores(model.terms, model.drift)))
    assert [(a, b) for a, b, *_ in found] == [(62, 74), (134, 146)]


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score(docs, toxicity.learn(docs, none)).collect())
    some = spark.createDataFrame([(0, 1, None), (None, 1, 1), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score(docs, toxicity.learn(docs, some)).collect()) == len(rows())


def test_kept_hash_is_of_bytes(spark, sf_dir):
    found = suffix_dedup.op7(spark, sf_dir).where("n_removed = 0").limit(1).collect()[0]
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {found.doc_id}").collect()[0].text
    assert hashlib.sha256(text.encode()).hexdigest() == found.kept_sha256
