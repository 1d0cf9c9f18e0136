"""Stages of the pipeline, each against a plain version over its own input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tallyforge.llm import mixing, shingle_groups, simhash, toxicity

from .fixtures import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).select(*cp.COLUMNS)


def plain(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]


def maximal(scores):
    """Sums of all maximal scoring segments: the best one, then those beside it."""
    best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if not best or best[0] <= 1e-12:
        return []
    return [best[0], *maximal(scores[: best[3]]), *maximal(scores[best[4] :])]


def plain_probability(model, text):
    scores = []
    for word in (text or "").split():
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
        names = [bare] + [bare[:n] + "*" for n in (6, 5, 4) if len(bare) >= n] if bare else []
        scores.append(next((model.terms[n] for n in names if n in model.terms), 0.0) - model.drift)
    n, found = max(1, len(scores)), maximal(scores)
    x = min(30.0, max(-30.0, model.lam * max([0.0, *found]) - math.log(model.k * n)))
    y = math.log1p(sum(model.k * n * math.exp(-model.lam * s) <= 0.01 for s in found))
    a, b, c = model.weights
    return 1 / (1 + math.exp(-(a + b * x + c * y)))


def test_toxic_documents_go(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").where("size(split(text, ' ')) < 60")
    model = toxicity.learn(every, labels)
    some = every.orderBy("doc_id").limit(60).collect()
    held = spark.createDataFrame(some, every.schema)
    got = {r.doc_id: r.score for r in toxicity.score(held, model).collect()}
    want = {r.doc_id: plain_probability(model, r.text) for r in some}
    assert all(got[i] == pytest.approx(p, abs=1e-9) for i, p in want.items())
    model = toxicity.learn(docs, labels)
    few = [r for r in rows() if len((r[1] or "").split()) < 60]
    kept = {r.doc_id for r in cp.not_toxic(spark, docs, sf_dir).collect()}
    assert {r[0] for r in few if plain_probability(model, r[1]) < 0.5} <= kept
    assert not kept & {r[0] for r in few if plain_probability(model, r[1]) >= 0.5 and r[0] is not None}


def in_step(a, b):
    """Pairs of equal lines of two lists in step, by patience: ends first, then lines that stand once on both sides."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(x + 1, y + 1) for x, y in in_step(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return in_step(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = [[p] for p in once]  # the longest rising chain that ends at each pair
    for k, p in enumerate(once):
        for other in best[:k]:
            if other[-1][1] < p[1] and len(other) >= len(best[k]):
                best[k] = [*other, p]
    if not best:
        return []
    chain, out, last = max(best, key=len), [], (-1, -1)
    for p in [*chain, (len(a), len(b))]:
        out += [(x + last[0] + 1, y + last[1] + 1) for x, y in in_step(a[last[0] + 1 : p[0]], b[last[1] + 1 : p[1]])]
        out += [p] if p[0] < len(a) else []
        last = p
    return out


def plain_lines(data):
    """Line numbers that go of each (id, text), by aligning it with every earlier document."""
    cut = {d: [(n, x.strip(" \t\r\f\x0b")) for n, x in enumerate(d[1].split("\n"))] for d in data}
    cut = {d: [(n, x) for n, x in v if x] for d, v in cut.items()}
    gone = {d: set() for d in data}
    for d in data:
        for e in data:
            if e[0] >= d[0]:
                continue
            pairs, i = in_step([x for _, x in cut[d]], [x for _, x in cut[e]]), 0
            while i < len(pairs):
                j = i
                while j + 1 < len(pairs) and pairs[j + 1] == (pairs[j][0] + 1, pairs[j][1] + 1):
                    j += 1
                if sum(len(WORD.findall(cut[d][p][1])) for p, _ in pairs[i : j + 1]) >= 5:
                    gone[d].update(range(cut[d][pairs[i][0]][0], cut[d][pairs[j][0]][0] + 1))
                i = j + 1
    return gone


def test_lines_stay_once(spark, docs, sf_dir):
    short = [r for r in rows() if len(r[1] or "") < 20_000]
    held = docs.where("text is null or length(text) < 20000")
    gone = plain_lines(sorted({(r[0], r[1]) for r in short if r[0] is not None and r[1] is not None}))
    want = Counter()
    for r in short:
        cut = gone.get((r[0], r[1]), set())
        text = r[1] if not cut else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in cut)
        if not cut or WORD.search(text):
            want[r[0], text, r[2], r[3], None if text is None else len(text)] += 1
    assert plain(cp.lines_once(spark, held, sf_dir)) == want
    assert sum(want.values()) < len(short)


def shingled(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(data, least=0.8):
    """Smallest id reachable from each id by links, all pairs compared."""
    sets, low = [shingled(t) for _, t in data], list(range(len(data)))
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    links = [(i, j) for i in range(len(data)) for j in range(i) if alike(sets[i], sets[j])]
    for _ in data:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    named = {}
    for (i, _), g in zip(data, low):
        if i is not None:
            named[g] = min(named.get(g, i), i)
    return Counter((i, named.get(g)) for (i, _), g in zip(data, low)), sum(sets[i] != sets[j] for i, j in links)


def test_one_document_of_each_group_stays(spark, docs, sf_dir):
    found = cp.one_of_each_group(spark, docs, sf_dir).collect()
    groups, _ = plain_groups([(r[0], r[1]) for r in rows()])
    want = {i for i, c in groups if i == c and i is not None}
    assert Counter(r.doc_id for r in found if r.doc_id is not None) == Counter(want)
    assert sum(r.doc_id is None for r in found) == sum(r[0] is None for r in rows())


def test_near_copies_are_found(spark):
    """Copies with one word in thirty changed: each is found with the text it comes from, and nothing else is."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    data = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(60, 300))]
        data.append((4 * i, " ".join(text)))
        for k in range(1, 4):
            near = list(text)
            for at in rng.sample(range(len(near)), max(1, len(near) // 60)):
                near[at] = word()
            data.append((4 * i + k, " ".join(near)))
    want, links = plain_groups(data)
    got = Counter(map(tuple, simhash.near_dedup(spark.createDataFrame(data, "doc_id long, text string"), words=5, similarity=0.8).collect()))
    small = shingle_groups.group(spark.createDataFrame(data, "doc_id long, text string"), unit=7).collect()  # groups in units that meet two by two
    assert Counter(map(tuple, small)) == got
    assert links > 300 and all(c % 4 == 0 or c == i for i, c in got)
    assert sum((got & want).values()) > 0.95 * len(data)


def test_the_mix_takes_what_it_says(spark, docs, sf_dir):
    found = cp.mixed(spark, docs, sf_dir).collect()
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r in found:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    repeated = {i for i, n in Counter(r[0] for r in rows()).items() if n > 1}
    assert all(words[i] == n for i, n in taken.items() if i not in repeated)
    texts = {}
    for r in rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    assert all(any(t.startswith(r.text or "") for t in texts[r.doc_id]) for r in found)
    assert {r[0] for r in rows() if not WORD.search(r[1] or "")} <= {r.doc_id for r in found}


def test_whole_run_and_empty_input(spark, docs, sf_dir):
    found = cp.run(spark, sf_dir)
    assert found.where("not lossless").count() == 0 and found.count() > 100
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
