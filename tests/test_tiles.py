"""Tiles of places against all pairs, and what graphs of tracks in places of their own shuffle."""

from __future__ import annotations

import numpy as np
import pytest

from platewise.operators import tiles as T
from tests.test_dense_places import crowded
from tests.test_places import agrees, shuffled


@pytest.mark.parametrize("n, most", [(0, 64), (1, 64), (700, 64), (700, 1024)])
def test_tiles_equal_all_pairs(spark, monkeypatch, n, most):
    monkeypatch.setattr(T, "SIZES", (most, most))
    monkeypatch.setattr(T, "BLOCK", (20, 50))
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 40, n), rng.uniform(0, 12, n)
    v = rng.uniform(0, 1, n)
    tiles = T.Tiles(spark.createDataFrame([(i, float(a), float(b), 1, float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))], "label bigint, x double, y double, n int, v double"), 2.5)
    assert tiles.rows.select("tile").distinct().count() >= n // (2 * most)
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    near = d <= 2.5
    got = tiles.sums(tiles.rows, {"s": "v"}, 0.3).toPandas().set_index("label").s
    assert np.allclose(got.sort_index(), np.where(near, np.exp(-0.3 * d * d), 0) @ v) and len(got) == n
    got = tiles.least(tiles.rows.where("label % 5 = 0"), ["v"]).toPandas().set_index("label").v.reindex(range(n)).fillna(np.inf)
    assert (got.to_numpy() == np.where(near & (np.arange(n) % 5 == 0), d + v, np.inf).min(axis=1, initial=np.inf)).all()
    cell = tiles.cells.toPandas().set_index("label").cell.sort_index().to_numpy()
    i, j = np.nonzero(near)
    assert {tuple(r) for r in tiles.touching().collect()} == set(zip(cell[i], cell[j], strict=True))


def test_paths_shuffle_no_edges(spark, tmp_path_factory):
    few, many = (crowded(tmp_path_factory.mktemp("tracks"), copies) for copies in (8, 64))
    agrees(spark, "L09_neighbour_graph", few)
    assert shuffled(spark, "L08_geodesics", many) < 12 * shuffled(spark, "L08_geodesics", few)  # eight times the tracks, 64 times the edges
