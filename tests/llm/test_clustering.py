"""Lloyd's rounds by two trees against a plain version, and what the bounds save."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm.clustering import Cover, DualWalk, centroid_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, id string, v string, cell int"


def brute(data, k=40, rounds=5, width=64):
    rows = [(i, [math.floor(256.0 * c) for c in v]) for i, v, *_ in data if v is not None and len(v) == width and all(c is not None and math.isfinite(256.0 * c) for c in v)]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<f8").tobytes()))
    cents = [v for _, v in first[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        where = [min(range(len(cents)), key=lambda c: (gap(v, cents[c]), c)) for _, v in rows]
        for c in range(len(cents)) if turn < rounds else ():
            own = [v for (_, v), w in zip(rows, where) if w == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    far = [gap(v, cents[w]) for (_, v), w in zip(rows, where)]
    end, by = (1 << 63) - 1, Counter()
    far = [min(end, f) for f in far]
    for w, f in zip(where, far):
        by[w] += f
    return Counter((i, w, f, min(end, by[w]), min(end, sum(far)), hashlib.sha256(",".join(map(str, cents[w])).encode()).hexdigest()) for (i, _), w, f in zip(rows, where, far))


def vectors(n=260, width=64, spread=0.1, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, width))
    x = base[rng.integers(0, 9, n)] + rng.normal(scale=spread, size=(n, width))
    out = [(i, v.tolist(), 0, "c", "i", "v", 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [1.0, None], [None] * width, [float("inf")] + [0.0] * (width - 1), [1e308] * width, [1.0] * (width + 1)]
    out += [(n + i, v, None, None, None, None, None) for i, v in enumerate(odd)]
    return out + [out[0], out[0], (5000, out[0][1], 1, "c", "i", "v", 1), (None, out[1][1], 1, "c", "i", "v", 1), (None, None, None, None, None, None, None)]


@pytest.mark.parametrize("n,spread,unit", [(260, 0.1, 4096), (500, 0.02, 40), (300, 2.0, 64), (20, 0.1, 4096)])
def test_clusters(spark, n, spread, unit):
    data = vectors(n, spread=spread)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert Counter(map(tuple, centroid_clusters(frame, unit=unit).collect())) == brute(data)


def test_ties_and_empty_clusters(spark):
    data = [(i, [float(i % 3)] * 4, None, None, None, None, None) for i in range(30)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert Counter(map(tuple, centroid_clusters(frame, k=7, width=4).collect())) == brute(data, k=7, width=4)
    assert centroid_clusters(frame.limit(0)).count() == 0


def test_components_beyond_doubles(spark):
    data = [(i, [1e300 if i % 5 == 0 else 1e9 * i, -(2.0 ** (40 + i)), 0.5], None, None, None, None, None) for i in range(25)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert Counter(map(tuple, centroid_clusters(frame, k=4, width=3).collect())) == brute(data, k=4, width=3)


@pytest.mark.parametrize("spread,share", [(0.01, 0.15), (0.05, 0.3)])
def test_bounds_save_products_on_clustered_vectors(spread, share):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    x = np.floor(256 * (np.repeat(base, 100, axis=0) + rng.normal(scale=spread, size=(4000, 64))))
    cents = np.floor(256 * base)
    tree, over = Cover(x), Cover(cents, leaf=1)
    for t in (tree, over):
        for n in range(len(t.center)):
            rows = t.order[t.begin[n] : t.end[n]]
            assert np.sqrt(((t.x[rows] - t.x[t.center[n]]) ** 2).sum(axis=1)).max() <= t.radius[n] + 1e-6
            assert all(t.radius[kid] <= t.radius[n] / 2 + 1e-6 for kid in range(t.kid[n], t.kid[n] + t.kids[n]))
    walk = DualWalk(Cover.unpacked(x, tree.packed()), over)
    where = walk.assign()
    assert (where == ((x[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert walk.products < share * len(x) * len(cents)


def test_scattered_vectors_cost_a_plain_round_and_little_more():
    x = np.floor(256 * np.random.default_rng(9).normal(size=(3000, 64)))
    walk = DualWalk(Cover(x), Cover(x[:40], leaf=1))
    assert (walk.assign() == ((x[:, None, :] - x[None, :40]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert 0.5 < walk.products / (len(x) * 40) < 1.2
