"""Fuzzy c-means against plain numpy."""

import numpy as np
import pytest

from platewise.operators import fuzzy as Z


def blobs(spark, n=30):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.5, (n, 3)) for c in (0.0, 6.0, 12.0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    broken = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0])]
    return x, Z.usable(spark.createDataFrame(rows + broken, "exp bigint, f array<double>"))


@pytest.mark.parametrize("m", [1.25, 2.0])
def test_fuzzy_means_by_numpy(spark, m):
    x, rows = blobs(spark)
    assert rows.count() == len(x)
    starts = Z.fuzzy_means(rows, [(3, 1), (2, 4)], m, steps=0)
    got = Z.fuzzy_means(rows, [(3, 1), (2, 4)], m, steps=4, tolerance=0.0)
    for v, end, index in zip(starts, got, Z.indices(rows, got, m), strict=True):
        for step in range(5):
            d = ((x[:, None] - v) ** 2).sum(axis=2)
            u = np.array([[(row[c] == 0) / (row == 0).sum() if (row == 0).any() else 1 / sum((row[c] / o) ** (1 / (m - 1)) for o in row) for c in range(len(v))] for row in d])
            if step < 4:
                v = (u**m).T @ x / (u**m).sum(axis=0)[:, None]
        assert np.allclose(end, v, atol=1e-9)
        k, sugeno, beni, entropy = index
        assert sugeno == pytest.approx(((u**m) * (d - ((v - x.mean(axis=0)) ** 2).sum(axis=1))).sum())
        assert beni == pytest.approx(((u**m) * d).sum() / (len(x) * min(((a - b) ** 2).sum() for i, a in enumerate(v) for b in v[:i])))
        assert entropy == pytest.approx(-(u * np.log2(u)).sum() / len(x) / np.log2(k))
        assert all(np.allclose(r["u"], u[r["exp"]], atol=1e-9) for r in Z.belonging(rows, end, m).collect())


def test_ties_few_rows_and_none(spark):
    rows = Z.usable(spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [4.0])], "exp bigint, f array<double>"))
    (centres,) = Z.fuzzy_means(rows, [(5, 1)], steps=1)
    assert len(centres) == 3  # as many as there are rows, two of them at one place
    assert Z.indices(rows, [centres])[0][2] is None
    assert {tuple(r["u"]) for r in Z.belonging(rows, np.array([[0.0], [0.0], [4.0]])).collect()} == {(0.5, 0.5, 0.0), (0.0, 0.0, 1.0)}
    assert Z.fuzzy_means(rows.where("exp < 0"), [(2, 1)]) == [] == Z.indices(rows, [])
