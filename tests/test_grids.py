"""Components, rectangles and quantiles against plain versions of them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyforge.operators import graph, quantiles as qt, regions as rg


def flood(cells):
    """Each cell with the first cell of its component."""
    left, out = set(cells), {}
    for start in sorted(left):
        todo = [start] if start not in out else []
        while todo:
            r, c = todo.pop()
            if (r, c) in left and (r, c) not in out:
                out[r, c] = start
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def test_components_equal_a_flood_fill(spark):
    rng = random.Random(3)
    grids = {k: {(r, c) for r in range(20) for c in range(25) if rng.random() < share} for k, share in ((None, 0.5), ("a", 0.62), ("b", 0.8))}
    spiral, r, c, (dr, dc) = set(), 0, 0, (0, 1)
    for n in [21, *[k for m in range(20, 0, -2) for k in (m, m)]]:
        for _ in range(n):
            spiral.add((r, c))
            r, c = r + dr, c + dc
        dr, dc = dc, -dr
    grids["spiral"] = spiral
    data = [(k, r, c, "x") for k, cells in grids.items() for r, c in cells] + [("a", None, 1, "x"), ("a", 0, None, "x")]
    data += data[:50]
    found = rg.components(spark.createDataFrame(data, "k string, row int, col int, first string").repartition(3), "k").collect()
    got = {(x["k"], x["row"], c): (x["first"]["row"], x["first"]["col"]) for x in found for c in range(x["c0"], x["c1"] + 1)}
    assert got == {(k, *cell): first for k, cells in grids.items() for cell, first in flood(cells).items()}
    assert rg.components(spark.createDataFrame([], "k string, row int, col int"), "k").count() == 0


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 3), (7, 7), (20, 21), (21, 22), (22, 20), (None, 5), (40, 39)]
    found = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 20: 20, 21: 20, 22: 20, 40: 39, 39: 39}
    line = spark.range(300).selectExpr("id + 1 as a", "id as b")
    assert graph.connected(line).where("component <> 0").count() == 0
    with pytest.raises(RuntimeError):
        graph.connected(line, rounds=1)


def test_best_rectangle(spark):
    box = lambda k, r0, r1, c0, c1, gone=(): [(k, r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) not in gone]
    cells = box("a", 0, 3, 0, 5) + box("a", 5, 8, 0, 5) + box("a", 0, 8, 8, 8)  # two equal ones, and a strip
    cells += box("b", 0, 5, 0, 9, {(r, c) for r in range(1, 6) for c in range(1, 10)})  # an angle: large and hardly filled
    cells += box("c", 0, 9, 0, 9)
    frame = spark.createDataFrame(cells, "k string, row int, col int")
    best = rg.best_rectangle(rg.boxes(rg.components(frame, "k"), "k"), "k", 10, 10)
    got = {r["k"]: (r["rmin"], r["rmax"], r["cmin"], r["cmax"], r["fill"]) for r in best.collect()}
    assert got == {"a": (0, 3, 0, 5, 1.0), "c": (0, 9, 0, 9, 1.0)}
    regions = rg.region(best, 10, 10).select("k", "left", "lower", rg.crop_box(rg.F.lit(640), rg.F.lit(360)).alias("b")).collect()
    assert [(r["k"], round(r["left"], 3), round(r["lower"], 3), tuple(r["b"])) for r in regions] == [("a", 0.0, 0.42, (0, 0, 396, 151))]  # c is the whole frame


def test_a_screen_beside_a_still_wall_is_found(spark):
    rng = random.Random(4)
    data = []
    for frame in range(24):
        for r in range(12):
            for c in range(20):
                screen = 2 <= r <= 8 and 5 <= c <= 15
                data.append(("film", frame, r, c, rng.randint(0, 255) if screen else 40))
    data += [("short", f, 0, 0, f) for f in range(19)]
    found = rg.moving_regions(spark.createDataFrame(data, "film string, frame int, row int, col int, luma int"), "film", 12, 20).collect()
    assert [(r["film"], r["rmin"], r["rmax"], r["cmin"], r["cmax"]) for r in found] == [("film", 2, 8, 5, 15)]


@pytest.mark.parametrize("enough,ps", [(20, (0.6,)), (4096, (0.05, 1.0))])
def test_quantiles_equal_numpy(spark, enough, ps):
    rng = np.random.default_rng(5)
    groups = {"many": rng.normal(size=3000), "ties": rng.integers(0, 3, 900).astype(float), "one": np.array([7.5]), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), [-1e308, 1e308, 5e-324]]), None: np.array([1.0, 2.0])}
    data = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [("many", None, "x"), ("many", float("nan"), "x"), ("many", float("inf"), "x"), ("none", None, "x")]
    frame = spark.createDataFrame(data, "k string, v double, n string").repartition(4)
    for p in ps:
        got = {r["k"]: (r["n"], r["quantile"]) for r in qt.quantiles(frame, ["k"], "v", p, buckets=32 if enough < 4096 else 1024, enough=enough).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_quantiles_of_nothing_and_means_below(spark):
    assert qt.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", 0.5).count() == 0
    data = [("a", float(i % 10), float(i), "c") for i in range(100)]
    found = qt.means_below(spark.createDataFrame(data, "k string, v double, x double, cut string").drop("cut"), ["k"], "v", 0.05, ["x"]).first()
    assert (found["cut"], found["n"], found["x"]) == (0.0, 10, 45.0)
