"""Language-model scores against a plain bit-by-bit version, base scores against plain counts, and held-out gain."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallyforge.llm import lm_scoring

from .fixtures import SCHEMA, rows

M64 = (1 << 64) - 1


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower)] + [b"\n"]


def fold(doc_id):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def keys(numbers, at, node, bits):
    """The entry of each of the four predictors for a node of the word at a place."""
    one, two = (numbers[at - n] if at >= n else 0 for n in (1, 2))
    first = (one ^ 0x51ED27) * 0x9E3779B97F4A7C15 & M64
    second = (two ^ 0xA2F1B5) * 0x9E3779B97F4A7C15 & M64
    second ^= second >> 29
    both = (first ^ second * 0xD6E8FEB86659FD93 & M64) * 0x9E3779B97F4A7C15 & M64
    spread = (node * 0x2545F4914F6CDD1D & M64) >> 20
    return [(0, node)] + [(k + 1, (h ^ h >> 31 ^ spread) & ((1 << bits) - 1)) for k, h in enumerate((first, second, both))]


def path(number):
    code, node = number & 255, 1
    for place in range(8):
        bit = code >> (7 - place) & 1
        yield place, node, bit
        node = node * 2 + bit


def plain_read(texts, table, weights, bits, learn):
    """Bits of each text, some words after another, side by side as far as learning goes."""
    cost, seen, shift = [0.0] * len(texts), [Counter() for _ in texts], [np.zeros(6) for _ in texts]
    squares = np.full((32, 6), 1e-6)
    start, step = 0, 64
    while start < max(map(len, texts), default=0):
        grads, many = np.zeros((32, 6)), np.zeros(32)
        passed = [Counter() for _ in texts]
        for d, numbers in enumerate(texts):
            own, n = np.zeros(6), 0
            for at in range(start, min(start + step, len(numbers))):
                n += 1
                for place, node, bit in path(numbers[at]):
                    ones, zeros = seen[d][node, 1], seen[d][node, 0]
                    x = [table.get(key, 0) / 15.5 for key in keys(numbers, at, node, bits)]
                    x = np.array([*x, max(-8, min(8, math.log((ones + 0.4) / (zeros + 0.4)))), 0.3])
                    often = ones + zeros
                    gate = place * 4 + (often > 0) + (often > 2) + (often > 15)
                    logit = max(-12, min(12, float(x @ (weights[gate] + shift[d]))))
                    p = 1 / (1 + math.exp(-logit))
                    cost[d] -= math.log2(p if bit else 1 - p)
                    own += (bit - p) * x
                    grads[gate] += (bit - p) * x
                    many[gate] += 1
                    passed[d][node, bit] += 1
            if n:
                shift[d] += 0.05 * own / math.sqrt(n * 8)
        for d, new in enumerate(passed):
            seen[d].update(new)
            for node in {node for node, _ in new if max(seen[d][node, 0], seen[d][node, 1]) > 127}:
                seen[d][node, 0], seen[d][node, 1] = seen[d][node, 0] // 2, seen[d][node, 1] // 2
        if learn:
            grads /= np.maximum(many, 1)[:, None]
            squares += grads * grads
            weights += learn * grads / np.sqrt(squares)
        start += step
        step = 64 if start < 512 else 128
    return cost


def plain(data, bits=20):
    every = [(i, tokens(t)) for i, t, *_ in data]
    train = [t for i, t in every if fold(i) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    code = lambda w: xxhash.xxh64_intdigest(w, 42) & 255
    share = Counter()
    for w, k in c.items():
        share[code(w)] += k + 1
    numbers = [[xxhash.xxh64_intdigest(w, 42) for w in t] for _, t in every]
    found: dict = {}
    for (i, _), own in zip(every, numbers):
        for at in range(len(own) if fold(i) not in (2, 6) else 0):
            for _, node, bit in path(own[at]):
                for key in keys(own, at, node, bits):
                    found.setdefault(key, [0, 0])[bit] += 1
    table = {k: round(max(-8, min(8, math.log((b + 0.4) / (a + 0.4)))) * 15.5) for k, (a, b) in found.items()}
    weights = np.zeros((32, 6))
    weights[:, 0] = 1
    mix = sorted((own for (i, _), own in zip(every, numbers) if fold(i) == 6), key=lambda own: -len(own))
    plain_read(mix, table, weights, bits, 0.1)
    cost = plain_read(numbers, table, weights, bits, 0)
    out = []
    for (i, t), bits_of in zip(every, cost):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10((c[w] + 1) / (share[code(w)] + 1)) for w in t) - bits_of * math.log10(2)
        out.append((i, fold(i) == 2, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out, key=repr)


def short(data):
    return [(r[0], r[1] if r[1] is None or len(r[1]) < 9000 else r[1][:9000], *r[2:]) for r in data]  # the plain version is slow


@pytest.mark.parametrize("which", ["all", "few", "held", "one"])
def test_scores(spark, which, monkeypatch):
    if which == "few":  # words in tasks and words that are joined
        monkeypatch.setattr(lm_scoring, "FREQUENT", 5)
    data = short(rows())
    data = {"all": data, "few": data, "held": [r for r in data if fold(r[0]) == 2], "one": data[:1]}[which]
    found = [tuple(r)[:7] for r in lm_scoring.scores(spark.createDataFrame(data, SCHEMA).coalesce(1)).collect()]
    want = plain(data)
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=lambda r: repr((r[0], *r[1:4], round(r[5], 3)))), sorted(want, key=lambda r: repr((r[0], *r[1:4], round(r[5], 3))))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-8) and a[6] == pytest.approx(b[6], rel=2e-4, abs=1e-3)


def test_empty_table_and_partitions(spark):
    data = short(rows())
    assert lm_scoring.scores(spark.createDataFrame([], SCHEMA)).count() == 0
    one, three = (Counter((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in lm_scoring.scores(spark.createDataFrame(data, SCHEMA).repartition(n)).collect()) for n in (1, 3))
    assert one == three


def test_codes_of_a_word_sum_to_one():
    """Over all codes the probabilities of a next word are a distribution, whatever tables and weights hold."""
    rng = np.random.default_rng(2)
    tables = [rng.integers(-120, 120, n).astype(np.int8) for n in (lm_scoring.BLOCK, 1 << 12, 1 << 12, 1 << 12)]
    model = lm_scoring.Model(tables, 12, rng.normal(size=(lm_scoring.GATES, lm_scoring.INPUTS)) * 0.3)
    start = [int(x) for x in rng.integers(0, 1 << 60, 70)]
    cost = model.read([np.array([*start, (start[0] & ~255) | code], dtype=np.uint64) for code in range(256)])
    before = model.read([np.array(start, dtype=np.uint64)])[0]
    assert sum(2.0 ** (before - c) for c in cost) == pytest.approx(1.0, rel=1e-3)


def test_held_out_texts_gain_on_the_base(spark, sf_dir):
    found = [r for r in lm_scoring.op13(spark, sf_dir.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found) * 0.97  # both are negative
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 2 ** (i // 2)) for i in range(10)], "word binary, c long")
    for most, want in ((0, 0), (1, 0), (2, 2), (5, 4), (10, 10), (99, 10)):
        assert sorted(r["c"] for r in lm_scoring.frequent(counts, most).collect()) == sorted(2 ** (i // 2) for i in range(10))[10 - want :]
    assert lm_scoring.frequent(counts.limit(0)).count() == 0


def test_tables_follow_the_corpus():
    assert [lm_scoring.slot_bits(n) for n in (0, 10**9, 10**11, 10**14)] == [20, 20, 23, 26]


def test_sums_of_frequent_words(monkeypatch):
    """Equal to a loop over the words of each text, in a part of its time, and no frequent word is hashed again."""
    rng = np.random.default_rng(3)
    frequent = [b"w%d" % i for i in range(20_000)]
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 25_000, n)) for n in [0, 1, 3000, *rng.integers(100, 600, 500)]]
    values = {w: (math.log10(i + 2) - 7.3, -math.log10(i + 3)) for i, w in enumerate(frequent)}
    began = time.process_time()
    want = []
    for text in texts:
        found = [(k, *values[w]) for w, k in Counter(text.split()).items() if w in values]
        want.append([sum(k for k, _, _ in found), *(sum(round(row[0] * row[at] * lm_scoring.PART) for row in found) for at in (1, 2))])
    plainly = time.process_time() - began
    names, table = lm_scoring.Words(frequent), np.array([values[w] for w in frequent])
    hashed, digest = Counter(), xxhash.xxh64_digest
    monkeypatch.setattr(lm_scoring.xxhash, "xxh64_digest", lambda word, seed: hashed.update([word]) or digest(word, seed))
    records = lm_scoring.read_words(texts, names)
    assert hashed and not hashed.keys() & values.keys()
    assert [r["number"].tolist() for r in records[:3]] == [[xxhash.xxh64_intdigest(w, 42) for w in [*t.split(), b"\n"]] for t in texts[:3]]
    places = [r["hot"][:-1] for r in records]
    began = time.process_time()
    found = lm_scoring.hot_sums(places, table)
    assert time.process_time() - began < plainly / 2  # about a tenth
    assert found.tolist() == want
    assert lm_scoring.hot_sums([], table).shape == (0, 3) and not lm_scoring.hot_sums([np.array([-1, -1])], np.zeros((0, 2))).any()


def test_bits_of_a_text_take_one_logarithm_a_word():
    """A text costs the same alone and beside others, and what it costs is exact where bits are nearly certain."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in [1, 700, 2, *rng.integers(1, 300, 150)]]
    tables = [rng.integers(-120, 120, n).astype(np.int8) for n in (lm_scoring.BLOCK, 1 << 12, 1 << 12, 1 << 12)]
    model = lm_scoring.Model(tables, 12, rng.normal(size=(lm_scoring.GATES, lm_scoring.INPUTS)) * 0.3)
    assert model.read(texts).tolist() == [model.read([t])[0] for t in texts]
    sure = lm_scoring.Model([np.full(lm_scoring.BLOCK, -124, np.int8)] + [np.zeros(1 << 12, np.int8)] * 3, 12)
    sure.weights[:, 0] = 1.5  # logits of -12, so that each bit of a code of zeros costs log2(1 + e^-12)
    assert sure.read([np.zeros(64, np.uint64)])[0] == pytest.approx(512 * math.log1p(math.exp(-12)) / math.log(2), rel=1e-6)
