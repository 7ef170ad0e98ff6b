"""Isomap with every node as a landmark is the dense one."""

import numpy as np
import pytest

from platewise.operators import manifold as M


def arc(spark, n=40):
    rng = np.random.default_rng(8)
    t = np.linspace(0, 4.5, n)
    points = [(i + 10, float(10 * np.cos(a) + e[0]), float(10 * np.sin(a) + e[1])) for i, (a, e) in enumerate(zip(t, rng.normal(0, 0.2, (n, 2)), strict=True))]
    others = [(1, 500.0, 0.0), (2, 501.0, 0.0), (3, None, 0.0), (4, -300.0, 5.0), points[0]]  # a small set, no place, an isolate, a repeated row
    return points, spark.createDataFrame(points + others, "label bigint, x double, y double")


def dense(points, radius):
    xy = np.array([p[1:] for p in points])
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2))
    d[d > radius] = np.inf
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


def test_isomap_equals_dense(spark):
    points, rows = arc(spark)
    paths, errors, places = M.isomap(rows, 3.0, most=2, count=1000)
    want = dense(points, 3.0)
    at = {p[0]: i for i, p in enumerate(points)}
    got = paths.collect()
    assert len(got) == len(points) ** 2
    assert max(abs(r["d"] - want[at[r["landmark"]], at[r["node"]]]) for r in got) < 1e-9
    j = np.eye(len(points)) - 1 / len(points)
    kernel = -j @ (want**2) @ j / 2
    values, vectors = np.linalg.eigh(kernel)
    values, vectors = values[::-1], vectors[:, ::-1]
    x = np.zeros((len(points), 2))
    for r in places.collect():
        x[at[r["node"]]] = r["x"]
    for c in range(2):
        full = vectors[:, c] * np.sqrt(values[c])
        assert min(np.abs(x[:, c] - full).max(), np.abs(x[:, c] + full).max()) < 1e-6
        assert abs(errors[c] - np.sqrt((kernel**2).sum() - (values[: c + 1] ** 2).sum()) / len(points)) < 1e-6
    for r in M.lost(paths, places, [1, 2]).collect():
        y = x[:, : r["k"]]
        new = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
        assert abs(r["lost"] - (1 - np.corrcoef(want.ravel(), new.ravel())[0, 1] ** 2)) < 1e-9
    assert np.corrcoef(x[:, 0], np.arange(len(points)))[0, 1] ** 2 > 0.99  # the arc is laid out along its length


def test_landmarks_lay_out_all_nodes(spark):
    points, rows = arc(spark)
    paths, _, places = M.isomap(rows, 3.0, most=1, count=6)
    assert paths.select("landmark").distinct().count() == 6 and places.count() == len(points)
    x = {r["node"]: r["x"][0] for r in places.collect()}
    assert np.corrcoef([x[p[0]] for p in points], np.arange(len(points)))[0, 1] ** 2 > 0.99


@pytest.mark.parametrize("points", [[], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 1.0, 0.0)]])
def test_small_sets(spark, points):
    _, errors, places = M.isomap(spark.createDataFrame(points, "label bigint, x double, y double"), 2.0)
    got = {r["node"]: r["x"] for r in places.collect()}
    assert len(errors) == (len(points) == 2) and len(got) == (2 if len(points) == 2 else 0)
    assert not got or abs(got[1][0] - got[2][0]) == pytest.approx(1.0)


def test_density(spark):
    places = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.5]), (3, [0.5, 0.5]), (4, [9.0, 9.0])], "node bigint, x array<double>")
    groups = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 7)], "node bigint, plate bigint")
    got = {(r["plate"], r["gx"], r["gy"]): (r["n"], r["share"]) for r in M.density(places, groups, 0, 2.0, 1.0).collect()}
    k = lambda x, y: np.exp(-((x - 1) ** 2 + (y - 1) ** 2))
    assert got[(7, 0, 0)] == (1, pytest.approx(k(0.5, 0.5) / (0.001 + k(0.5, 0.5) + k(0, 0) + k(1, 0.5))))
    assert got[(7, 4, 4)][1] == pytest.approx(1 / 1.001)
