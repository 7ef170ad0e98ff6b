"""The dip statistic against its definition."""

import numpy as np
import pytest

from platewise.operators import modes as M
from platewise.operators import statistics as S


def definition(values):
    """The smallest d for which some distribution function that is convex up to a mode and concave after it (which may jump there) stays within d."""
    v, n = np.unique(values, return_counts=True)
    after = np.cumsum(n) / n.sum()
    before, k = after - n / n.sum(), len(v)
    best = np.inf
    for m in range(k):
        need = max([0.0, *[(after[j] - before[j]) / 2 for j in range(k) if j != m]])
        # what the convex part is at least at the mode, and the concave part at most: a + s d, for steps and for lines through two values
        least, most = [(after[j], 1.0) for j in range(m)], [(before[j], 1.0) for j in range(m + 1, k)]
        for i in range(m):
            for j in range(i + 1, m):
                r = (v[m] - v[j]) / (v[j] - v[i])
                least.append((after[j] + (after[j] - before[i]) * r, 1 + 2 * r))
                for q in range(j + 1, m):
                    t = (v[j] - v[i]) / (v[q] - v[i])
                    need = max(need, (after[j] - before[i] * (1 - t) - before[q] * t) / 2)
        for i in range(m + 1, k):
            for j in range(i + 1, k):
                r = (v[i] - v[m]) / (v[j] - v[i])
                most.append((before[i] - (after[j] - before[i]) * r, 1 + 2 * r))
                for q in range(i + 1, j):
                    t = (v[q] - v[i]) / (v[j] - v[i])
                    need = max(need, (after[i] * (1 - t) + after[j] * t - before[q]) / 2)
        need = max([need, *[(a - before[m]) / (s + 1) for a, s in least], *[(after[m] - b) / (s + 1) for b, s in most], *[(a - b) / (s + z) for a, s in least for b, z in most]])
        best = min(best, need)
    return best


def samples(seed, count, most=11):
    rng = np.random.default_rng(seed)
    for i in range(count):
        k = int(rng.integers(1, most))
        yield [rng.normal(size=k), rng.integers(0, 8, 2 * k).astype(float), np.concatenate([rng.normal(size=k), rng.normal(6, 1, k)])[:most], np.repeat(rng.exponential(size=k), rng.integers(1, 6, k))][i % 4].tolist()


def by_key(df):
    return {r.key: (r.n, r.dip) for r in df.collect()}


def test_dip_by_definition(spark):
    every = list(samples(0, 200))
    got = by_key(M.dip(spark.createDataFrame([(i, v) for i, s in enumerate(every) for v in s], "key bigint, v double"), ["key"], "v"))
    for i, s in enumerate(every):
        assert got[i] == (len(s), pytest.approx(definition(s), abs=1e-12)), s


def test_rounds_over_ranges_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    every = [rng.normal(size=300), np.concatenate([rng.normal(size=150), rng.normal(5, 1, 150)]), rng.exponential(size=200) ** 2, rng.integers(0, 40, 400).astype(float), np.log(np.arange(1, 200)), np.array([1.0, 2.0, 2.0])]
    rows = spark.createDataFrame([(i, float(v)) for i, s in enumerate(every) for v in s], "key bigint, v double")
    want = by_key(M.dip(rows, ["key"], "v"))
    monkeypatch.setattr(S, "RANGE_ROWS", 30)
    monkeypatch.setattr(M, "FAN", 4)
    got = by_key(M.dip(rows, ["key"], "v"))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-12)), k


def test_thinned_hulls(monkeypatch):
    x = np.linspace(0, 1, 1001)
    assert M.thinned(x, x**2)[1] == 0.0
    monkeypatch.setattr(M, "MOST_CORNERS", 100)
    keep, off = M.thinned(x, x**2)
    assert len(keep) <= 100 and keep[0] == 0 and keep[-1] == 1000 and 0 < off < 1e-3


def test_null_keys_ties_other_values_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, "a", 1.0), (None, "a", 2.0), (None, "a", 9.0), (None, None, 4.0), (1, "a", 5.0), (1, "a", 5.0), (1, "a", None), (1, "a", nan), (1, "a", inf), (2, "a", nan), (3, "b", 0.0), (3, "b", -0.0)]
    df = spark.createDataFrame(rows, "key bigint, n string, v double").withColumnRenamed("n", "dip of")
    got = {(r[0], r[1]): (r.n, r.dip) for r in M.dip(df, ["key", "dip of"], "v").collect()}
    assert got == {(None, "a"): (3, pytest.approx(1 / 6)), (None, None): (1, 0.0), (1, "a"): (2, 0.0), (3, "b"): (2, 0.0)}
    assert [tuple(r) for r in M.dip(df, [], "v").select("n").collect()] == [(8,)]
    assert M.dip(df.where("false"), ["key"], "v").count() == 0
    assert M.dip(df.where("false"), [], "v").count() == 0
