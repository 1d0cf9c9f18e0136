"""Components that reach over edges of tiles, and grids that need no round of ties at all."""

from __future__ import annotations

import random

import pytest

from tallyforge.operators import regions as rg

from .test_grids import flood


@pytest.mark.parametrize("tile", [(3, 4), (1, 1), (128, 1024)])
def test_tiles_equal_a_flood_fill(spark, tile):
    rng = random.Random(8)
    grids = {k: {(r - 7, c - 9) for r in range(18) for c in range(23) if rng.random() < share} for k, share in ((None, 0.55), (1, 0.65), (2, 0.9))}
    data = [(k, r, c) for k, cells in grids.items() for r, c in cells]
    found = rg.components(spark.createDataFrame(data + data[:60], "k long, row int, col int").repartition(3), "k", tile).collect()
    got = {(x["k"], x["row"], c): (x["first"]["row"], x["first"]["col"]) for x in found for c in range(x["c0"], x["c1"] + 1)}
    assert got == {(k, *cell): first for k, cells in grids.items() for cell, first in flood(cells).items()}


def test_grids_of_a_tile_take_no_rounds(spark, monkeypatch):
    def never(*_):
        raise AssertionError("rounds over runs that lie in one tile")

    monkeypatch.setattr(rg, "connected", never)
    cells = spark.range(500).selectExpr("id % 40 as k", "id % 31 as row", "id % 84 as col")
    assert rg.boxes(rg.components(cells, "k"), "k").count() > 40
