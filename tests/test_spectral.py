"""Spectral clustering against dense eigenvectors."""

import numpy as np
import pytest

from platewise.jobs import graphs
from platewise.operators import spectral


def planted(spark, sizes=(60, 50, 40), spread=1.0):
    rng = np.random.default_rng(4)
    at = [(0, 0), (7, 0), (0, 8)]
    points = [(k * 100 + i, *(np.array(at[k]) + rng.normal(0, spread, 2)).tolist()) for k, n in enumerate(sizes) for i in range(n)]
    points += [(9000, 500.0, 500.0), (9001, None, 1.0)]  # an isolate, and a point without a place
    return points, spark.createDataFrame(points, "label bigint, x double, y double")


def test_eigenvectors_equal_dense_ones(spark):
    points, rows = planted(spark)
    edges = spectral.neighbour_graph(rows, 6.5, 0.1)
    values, vectors = spectral.eigenvectors(edges)
    got = {r["i"]: list(r)[1:] for r in vectors.collect()}
    ids = sorted(got)
    assert ids == sorted(p[0] for p in points[:150])
    xy = np.array([dict((p[0], p[1:]) for p in points)[i] for i in ids])
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2))
    w = np.where((d <= 6.5) & ~np.eye(len(ids), dtype=bool), np.exp(-0.1 * d * d), 0)
    degree = w.sum(axis=1)
    want, u = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))
    want, u = want[::-1][: len(values)], (u / np.sqrt(degree)[:, None])[:, ::-1]
    assert np.allclose(values, want, atol=1e-8)
    v = np.array([got[i] for i in ids])
    for c in range(4):
        assert min(np.abs(v[:, c] - u[:, c]).max(), np.abs(v[:, c] + u[:, c]).max()) < 1e-4
    assert spectral.eigengap(values) == 3
    labels = {r["exp"]: r["label"] for r in graphs.clusters(edges)[1].collect()}
    assert len(labels) == 150 and len({(i // 100, label) for i, label in labels.items()}) == 3


@pytest.mark.parametrize("points", [[], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 1.0, 0.0)]])
def test_small_graphs(spark, points):
    values, vectors = spectral.eigenvectors(spectral.neighbour_graph(spark.createDataFrame(points, "label bigint, x double, y double"), 2.0, 0.1))
    assert len(values) == vectors.count() == (2 if len(points) == 2 else 0)
    assert len(values) == 0 or np.allclose(values, [1, -1])
