"""The operators on vectors against plain versions of them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyforge.llm import neighbours, vectors
from tallyforge.llm.whole import whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, c string, v string, cell int"


def rows(n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, d))
    x = np.concatenate([base, base + rng.normal(scale=0.1, size=base.shape), rng.normal(size=(n - 2 * len(base), d))])
    out = [(i, v.tolist(), 0, "c", "v", 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [1.0, None], [float("inf")] + [0.0] * (d - 1), [1.0, 2.0], [1e200] * d, [1e-200] * d]
    out += [(n + i, v, 0, "c", "v", 1) for i, v in enumerate(odd)]
    return out + [out[0], out[0], (5000, out[0][1], 1, "c", "v", 1), (None, out[1][1], 1, "c", "v", 1), (None, None, None, None, None, None)]


def unit(v):
    if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
        return None
    v = np.array(v) / max(map(abs, v))
    return v / np.sqrt((v * v).sum())


def brute_links(data, least=0.95):
    u = [unit(r[1]) for r in data]
    w = max((len(x) for x in u if x is not None), default=0)
    m = np.array([np.zeros(w) if x is None else np.concatenate((x, np.zeros(w - len(x)))) for x in u])
    near = m @ m.T >= least
    np.fill_diagonal(near, False)
    group = list(range(len(data)))
    for _ in data:
        for i, j in zip(*np.nonzero(near)):
            group[i] = group[j] = min(group[i], group[j])
    out = []
    for i, r in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if group[j] == group[i] and data[j][0] is not None]
        out.append((r[0], int(near[i].sum()), r[0] if u[i] is None else min(ids, default=None)))
    return Counter(out)


def test_near_pairs(spark):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = vectors.near_pairs(frame, cells=8, fit=64, unit=64).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == brute_links(data)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    assert vectors.near_pairs(frame.limit(0)).count() == 0


def test_near_pairs_in_several_units(spark):
    data = rows(n=200, seed=2)
    found = vectors.near_pairs(spark.createDataFrame(data, SCHEMA), cells=4, fit=50, unit=40).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found) == brute_links(data)


def pairs_of(walk):
    """All pairs of rows that a walk finds, blocks written out."""
    out = []
    for kind, i, j in walk:
        if kind == "rows":
            out += zip(i.tolist(), j.tolist())
        else:
            a, b = (t.order[t.begin[n] : t.end[n]].tolist() for t, n in ((walk.a, i), (walk.b, j)))
            both = [(p, q) for n, p in enumerate(a) for q in a[n + 1 :]] if walk.own and i == j else [(p, q) for p in a for q in b]
            out += [(min(x), max(x)) for x in both] if walk.own else both
    return out


@pytest.mark.parametrize("d,clusters,size,spread", [(5, 30, 40, 0.05), (3, 10, 100, 0.3), (64, 50, 10, 0.03), (8, 1, 300, 0.5), (16, 400, 1, 0.1)])
def test_dual_walk_finds_all(d, clusters, size, spread):
    rng = np.random.default_rng(d)
    x = np.repeat(rng.normal(size=(clusters, d)), size, axis=0)
    x += rng.normal(scale=spread, size=x.shape)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    tree = vectors.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.center)):
        rows = tree.order[tree.begin[k] : tree.end[k]]
        assert np.sqrt(((x[rows] - x[tree.center[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-6
        for kid in range(tree.kid[k], tree.kid[k] + tree.kids[k]):
            assert tree.radius[kid] <= tree.radius[k] / 2 + 1e-6
    got = pairs_of(vectors.DualWalk(vectors.CoverTree.unpacked(x, tree.packed()), None, 0.95))
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1))))
    n = len(x) // 3
    got = pairs_of(vectors.DualWalk(vectors.CoverTree(x[:n]), vectors.CoverTree(x[n:]), 0.95))
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(x[:n] @ x[n:].T >= 0.95)))


def test_cover_tree_has_levels_and_prunes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 6))
    for scale, n in ((0.3, 8), (0.1, 8), (0.02, 8)):  # clusters of clusters
        x = np.repeat(x, n, axis=0) + rng.normal(scale=scale, size=(len(x) * n, 6))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    tree = vectors.CoverTree(x)
    assert tree.depth() >= 3
    walk = vectors.DualWalk(tree, None, 0.999)
    pairs_of(walk)
    assert walk.compared < 0.02 * walk.total


def test_scattered_vectors_are_all_multiplied(sf_dir):
    """No bound parts vectors that lie in all directions: each pair is one product of two rows, and none is formed twice."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")["embedding"].to_pylist(), dtype=float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    walk = vectors.DualWalk(vectors.CoverTree(x), None, 0.95)
    assert len(set(pairs_of(walk))) == int(np.triu(x @ x.T >= 0.95, 1).sum())
    assert walk.compared + walk.whole == walk.total


def test_products_are_counted():
    """Rows of nodes of one row each are compared by their nodes' bound; the counter says so."""
    x = np.eye(40)
    walk = vectors.DualWalk(vectors.CoverTree(x), None, 0.95)
    assert pairs_of(walk) == [] and walk.compared == walk.total == 780
    walk = vectors.DualWalk(vectors.CoverTree(x[:15]), vectors.CoverTree(x[15:]), 0.95)
    assert pairs_of(walk) == [] and walk.compared == walk.total == 375


def brute_top(data, k=5, every=10):
    ok = []
    for r in data:
        v = r[1]
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            ok.append((r[0], [int(np.floor(256.0 * c)) for c in v]))
    out = []
    for i, (q, v) in enumerate(ok):
        if q is None or q % every:
            continue
        score = lambda u: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(u, v))))
        best = sorted(((-score(u), c is None, c or 0, c) for j, (c, u) in enumerate(ok) if j != i))[:k]
        out += [(q, n + 1, b[3], -b[0]) for n, b in enumerate(best)]
    return Counter(out)


def test_top_k(spark):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = neighbours.top_k(frame, every=10, pivots=8, fit=100, group=7).collect()
    assert Counter(map(tuple, found)) == brute_top(data)
    assert neighbours.top_k(frame.limit(0)).count() == 0
    few = spark.createDataFrame(data[:3], SCHEMA)
    assert Counter(map(tuple, neighbours.top_k(few, every=2).collect())) == brute_top(data[:3], every=2)


def test_top_k_of_many_blocks(spark, monkeypatch):
    data = [r for r in rows(n=240) if r[1] is None or not r[1] or max(abs(c or 0) for c in r[1]) < 1e9]  # products that doubles hold
    monkeypatch.setattr(neighbours, "UNIT", 12)
    monkeypatch.setattr(neighbours, "SHARE", 3)
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = neighbours.top_k(frame, every=10, pivots=8, fit=100, group=7).collect()
    assert Counter(map(tuple, found)) == brute_top(data)


def clustered(n=480):
    rng = np.random.default_rng(6)
    base = np.eye(8)[np.repeat(np.arange(8), n // 8)] * 4 + rng.normal(scale=0.05, size=(n, 8))
    return [(i, v.tolist(), i % 3, "c", "v", 1) for i, v in enumerate(base)]


def pairs_kept(spark, frame, k, wants):
    """Share of the pairs of a group of queries and a cell that summaries leave."""
    base = whole_vectors(frame, "vec_id", "embedding", 256.0, label=F.col("label"))
    cells = neighbours.Cells(base, 8, 480)
    dealt = cells.deal(base).withColumn("part", F.lit(0)).cache()
    summary = [r.asDict(recursive=True) for r in neighbours.summaries(dealt, k).first()["cells"]]
    pruner, kept = neighbours.Pruner(cells, k), []
    for r in dealt.where("id % 10 = 0").collect():
        q = np.frombuffer(r["v"], "<f8")[None, :]
        kept.append(len(pruner.needs(q, [r["label"]], None if wants is None else [[wants(q[0])]], summary)))
    return sum(kept) / len(kept) / len(summary)


def test_groups_get_what_they_need_alone(spark):
    """On clustered vectors a group of queries gets few of the cells; bounds from summaries keep the rest away."""
    frame = spark.createDataFrame(clustered(), SCHEMA)
    assert pairs_kept(spark, frame, 5, None) < 0.2
    assert pairs_kept(spark, frame, 10, lambda q: neighbours.band(int(q @ q))) <= 0.5
    assert Counter(map(tuple, neighbours.top_k(frame, every=10, pivots=8, group=7).collect())) == brute_top(clustered())


def brute_hard(data, every=10, positives=5, negatives=10):
    ok = [(r[0], r[2], [int(np.floor(256.0 * c)) for c in r[1]]) for r in data if r[2] is not None and r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    out = []
    for i, (a, label, v) in enumerate(ok):
        if a is None or a % every:
            continue
        score = lambda u: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(u, v))))
        near = lambda same: sorted(((-score(u), c is None, c or 0, c) for j, (c, m, u) in enumerate(ok) if j != i and (m == label) == same))
        others = near(False)
        for p in near(True)[:positives]:
            inside = [x for x in others if 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:negatives]
            out += [(a, p[3], n + 1, x[3], -p[0], -x[0]) for n, x in enumerate(inside)]
    return Counter(out)


@pytest.mark.parametrize("unit,share,large", [(8192, 16, True), (12, 3, False)])
def test_hard_negatives(spark, monkeypatch, unit, share, large):
    monkeypatch.setattr(neighbours, "UNIT", unit)
    monkeypatch.setattr(neighbours, "SHARE", share)
    data = [(r[0], r[1], (i * 7 % 4) if i % 11 else None, *r[3:]) for i, r in enumerate(rows())]
    data = [r for r in data if large or r[1] is None or not r[1] or max(abs(c or 0) for c in r[1]) < 1e9]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = neighbours.hard_negatives(frame, every=10, pivots=8, fit=100, group=7).collect()
    assert len(found) > 100 and Counter(map(tuple, found)) == brute_hard(data)
    assert neighbours.hard_negatives(frame.limit(0)).count() == 0


def test_hard_negatives_on_clusters(spark):
    data = clustered()
    frame = spark.createDataFrame(data, SCHEMA)
    assert Counter(map(tuple, neighbours.hard_negatives(frame, every=10, pivots=16, group=7).collect())) == brute_hard(data)


def test_bands():
    assert [neighbours.band(s) for s in (100, 101, 7, 0, -5)] == [(30, 90), (31, 90), (3, 6), (0, 0), (-1, -5)]
