"""Graphs of points of which many share a place: the same as the graphs of all pairs, with edges between places only."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.jobs import graphs
from platewise.operators import manifold as M
from platewise.operators import spectral as L
from tests.test_places import agrees, copied, shuffled


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    new = tmp_path_factory.mktemp
    return copied(new("few"), 4), copied(new("many"), 32)


@pytest.fixture(scope="module")
def points(spark):
    """Two sets of places in a row with one to four points each, a place of three far off, one of a single point, and points without a place."""
    at = [(float(i), 0.5 * (i % 3)) for i in range(12)] + [(40.0 + i, 0.0) for i in range(9)]
    rows = [p for k, p in enumerate(at) for _ in range(1 + k % 4)] + [(90.0, 90.0)] * 3 + [(200.0, 0.0), (None, 1.0), (float("nan"), 1.0), (float("nan"), 1.0)]
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "label bigint, x double, y double").cache()


def test_vectors_of_places_are_vectors_of_points(spark, points):
    edges = L.neighbour_graph(points, 2.5, 0.3).toPandas()
    nodes = sorted(set(edges.i))
    w = edges.pivot(index="i", columns="j", values="w").reindex(index=nodes, columns=nodes).fillna(0.0).to_numpy()
    values, vectors = L.vectors_of_points(points, 2.5, 0.3)
    degree = w.sum(axis=1)
    want = np.sort(np.linalg.eigvalsh(w / np.sqrt(np.outer(degree, degree))))[::-1]
    assert np.allclose(values, want[: len(values)], atol=1e-5) and len(values) == 6
    got = vectors.toPandas().set_index("i").loc[nodes].to_numpy()
    assert len(vectors.toPandas()) == len(nodes)
    assert np.allclose(w @ got / degree[:, None], got * values, atol=1e-4)
    assert np.allclose(got.T @ (got * degree[:, None]), np.eye(6), atol=1e-4)


def test_vectors_that_sum_to_zero_in_a_place(spark):
    """Four points of one place: the eigenvalues are 1 and -1/3 three times."""
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(4)], "label bigint, x double, y double")
    assert np.allclose(L.vectors_of_points(points, 2.0, 0.3)[0], [1, -1 / 3, -1 / 3, -1 / 3], atol=1e-6)


def test_paths_of_places_are_paths_of_points(spark, points):
    edges = M.neighbours(points.where("not isnan(x)"), 2.5)
    want = M.geodesics(edges, M.landmarks(M.largest(edges), seed=3))
    plain = lambda df: sorted((r["landmark"], r["node"], round(r["d"], 9)) for r in df.collect())
    assert plain(M.paths_of_points(points, 2.5, seed=3)) == plain(want)


@pytest.mark.parametrize("name", ["L09_neighbour_graph", "L08_geodesics"])
def test_graphs_of_copies(spark, folders, name):
    agrees(spark, name, folders[0])


@pytest.mark.parametrize("name", ["L09_neighbour_graph", "L09_eigenvalues", "L08_geodesics"])
def test_edges_of_places_only(spark, folders, name):
    few, many = (shuffled(spark, name, f) for f in folders)
    assert many < 10 * few  # eight times the tracks, 64 times their pairs


def test_tracks_of_equal_values_are_in_one_place(spark, folders):
    at = graphs._points(spark, folders[1])
    assert at.select("x", "y").distinct().count() * 32 == at.count()
