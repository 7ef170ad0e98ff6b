"""Kernel k-means against the whole kernel matrix."""

import hashlib

import numpy as np
import pytest

from platewise.operators import kernels as K
from platewise.operators.fuzzy import usable

RUNS = [K.Run(K.Kernel(name, 0.3), k, seed) for name in ("rbf", "linear", "cosine", "poly", "sigmoid") for k, seed in ((2, 1), (3, 4))]


def rings(spark):
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 90), np.repeat([0.3, 2.0, 5.0], 30)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1) + rng.normal(0, 0.1, (90, 2))
    broken = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 0.0])]
    return x, usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + broken, "exp bigint, f array<double>"))


def matrix(r, x):
    g, p = r.kernel.gamma, x @ x.T
    n = np.linalg.norm(x, axis=1)
    return {"rbf": np.exp(-g * ((x[:, None] - x) ** 2).sum(axis=2)), "linear": p, "cosine": p / np.outer(n, n), "poly": (g * p + 1) ** 3, "sigmoid": np.tanh(g * p + 1)}[r.kernel.name]


def brute(r, x, steps):
    m = matrix(r, x)
    label = np.array([int(hashlib.md5(f"{r.seed}:{i}".encode()).hexdigest()[:8], 16) % r.k for i in range(len(x))])
    for _ in range(steps):
        d = np.full((len(x), r.k), np.inf)
        for c in range(r.k):
            own = label == c
            if own.any():
                d[:, c] = m[np.ix_(own, own)].mean() - 2 * m[:, own].mean(axis=1)
        label = np.round(d, 9).argmin(axis=1)
    return label, d.min(axis=1) + np.diag(m), (d.min(axis=1) ** 2).sum() / (len(x) * np.trace(m) - m.sum())


def test_all_rows_as_landmarks(spark):
    x, rows = rings(spark)
    model = K.kernel_means(rows, RUNS, steps=4, tolerance=0.0)
    got = K.belonging(rows, model).toPandas().sort_values(["run", "exp"])
    for i, (r, cohesion) in enumerate(zip(RUNS, K.cohesions(rows, model), strict=True)):
        label, d, want = brute(r, x, 4)
        own = got[got.run == i]
        assert own.exp.tolist() == list(range(len(x)))
        assert own.label.tolist() == label.tolist(), r
        np.testing.assert_allclose(own.d, d, atol=1e-5)
        assert cohesion == pytest.approx(want, rel=1e-5)


def test_landmarks_that_span_are_exact(spark):
    x, rows = rings(spark)
    runs = [r for r in RUNS if r.kernel.name in ("linear", "cosine")]
    few = K.belonging(rows, K.kernel_means(rows, runs, steps=4, tolerance=0.0, landmarks=5)).toPandas().sort_values(["run", "exp"])
    for i, r in enumerate(runs):
        assert few[few.run == i].label.tolist() == brute(r, x, 4)[0].tolist()


def test_it_stops_and_parts_what_is_apart(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0.0, 4.0)])
    rows = usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "exp bigint, f array<double>"))
    got = K.belonging(rows, K.kernel_means(rows, [K.Run(K.Kernel("rbf", 0.1), 2)], landmarks=20)).toPandas().sort_values("exp")
    assert got.label[:40].nunique() == got.label[40:].nunique() == 1 and got.label.nunique() == 2


def test_few_rows_ties_other_lengths_and_none(spark):
    rows = lambda data: usable(spark.createDataFrame(data, "exp bigint, f array<double>"))
    assert K.kernel_means(rows([]), RUNS) is None
    one = rows([(1, [0.0, 0.0])])
    model = K.kernel_means(one, RUNS)
    assert K.belonging(one, model).count() == len(RUNS)
    assert K.cohesions(one, model)[2] is None
    same = rows([(i, [1.0, 2.0]) for i in range(20)])
    assert K.belonging(same, K.kernel_means(same, RUNS)).count() == 20 * len(RUNS)
    mixed = rows([(i, [1.0, float(i)]) for i in range(20)] + [(99, [1.0, 2.0, 3.0])])
    got = K.belonging(mixed, K.kernel_means(mixed, RUNS[:1], seed=3))
    assert sorted(r.exp for r in got.collect()) == list(range(20))
    with pytest.raises(ValueError, match="unknown kernel"):
        K.kernel_means(same, [K.Run(K.Kernel("other"), 2)])
