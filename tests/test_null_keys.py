"""Null keys are a group like any other, in one range of values and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import clean, hits, statistics


@pytest.fixture(params=[1 << 16, 7])
def values(request, monkeypatch):
    """The rows of three groups, one without a key, cut into ranges of so many values."""
    monkeypatch.setattr(statistics, "RANGE_ROWS", request.param)
    rng = np.random.default_rng(12)
    return {"a": rng.integers(0, 15, 60).astype(float), None: rng.integers(0, 25, 41).astype(float), "b": np.array([3.0])}


def frame(spark, values, name="k"):
    return spark.createDataFrame([(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)], f"{name} string, id int, v double")


def test_quantiles_and_numbers(spark, values):
    rows = frame(spark, values)
    got = {r["k"]: r["m"] for r in statistics.quantiles(rows, ["k"], "v", {"m": 0.4}).collect()}
    assert set(got) == set(values) and all(abs(got[k] - np.quantile(x, 0.4)) < 1e-9 for k, x in values.items())
    numbered = statistics.row_numbers(rows, "v", "id", "n", ["k"]).collect()
    for k, x in values.items():
        mine = sorted((r["n"], r["v"], r["id"]) for r in numbered if r["k"] == k)
        assert [n for n, *_ in mine] == list(range(1, len(x) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert {r["all_rows"] for r in numbered if r["k"] == k} == {len(x)}


def test_spearman(spark, values):
    rows = frame(spark, values).withColumn("w", F.col("v") * F.col("v") - 12 * F.col("v") + F.col("id") % 5)
    got = {r["k"]: (r["n"], r["rho"]) for r in statistics.spearman(rows, ["k"], "v", "w").collect()}
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for k, x in values.items():
        assert got[k][0] == len(x)
        if len(x) > 1:
            w = x * x - 12 * x + np.arange(len(x)) % 5
            assert abs(got[k][1] - np.corrcoef(rank(x), rank(w))[0, 1]) < 1e-9


def test_pools_within_a_null_key(spark, values):
    pool = {k: x[::2] + 1 for k, x in values.items()}
    both = statistics.against_pool(frame(spark, values), frame(spark, pool), ["k"], "v", within=["k"])
    got = {r["k"]: r for r in statistics.kolmogorov_smirnov(both, ["k"]).collect()}
    z = {r["k"]: r["n1"] for r in statistics.rank_sum(both, ["k"]).collect()}
    for k, x in values.items():
        at = np.unique(np.r_[x, pool[k]])
        assert abs(got[k]["d"] - max(abs((x <= v).mean() - (pool[k] <= v).mean()) for v in at)) < 1e-12
        assert (got[k]["n1"], got[k]["n2"], z[k]) == (len(x), len(pool[k]), len(x))


def test_false_discovery_rates_over_many_ranges(spark, values):
    p = np.round(np.random.default_rng(2).random(300) ** 2, 2) + 0.001
    got = statistics.bh(spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double")).collect()
    want = {v: min(min(1.0, u * len(p) / (p <= u).sum()) for u in p if u >= v) for v in set(p)}
    assert len(got) == 300 and all(abs(r["q"] - want[r["p"]]) < 1e-12 for r in got)


def test_z_scores_and_union(spark, values):
    rows = frame(spark, values)
    z = clean.z_scores(rows, ["k"], "v", F.lit(True)).collect()
    assert len(z) == sum(map(len, values.values())) and abs(sum(r["z"] for r in z if r["k"] is None)) < 1e-9
    right = rows.where("k is null").withColumn("v", F.lit(-1.0))
    got = clean.union_right_wins(rows, right, ["k"]).collect()
    assert len(got) == len(z) and {r["v"] for r in got if r["k"] is None} == {-1.0}


def test_rank_products_of_a_batch_without_a_name(spark, values):
    rows = spark.createDataFrame([(b, c, float(v)) for b in ("x", None) for c, v in (("p", 1), ("q", 2), ("r", 3)) if (b, c) != (None, "p")], "b string, c string, v double")
    got = {r["c"]: round(r["rank_product"], 9) for r in hits.rank_product(rows, "c", "b", "v").collect()}
    assert got == {"p": round((1 * 2) ** 0.5, 9), "q": round((2 * 1) ** 0.5, 9), "r": round((3 * 2) ** 0.5, 9)}


def test_pairs_of_sides(spark, values):
    """Every two sides of each group, as the test of one against the other has them; one side alone and a null side make no pair."""
    sided = [(k, None if i % 11 == 10 else i % 3, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    rows = spark.createDataFrame(sided, "k string, side int, v double")
    got = {(r["k"], r["i"], r["j"]): (r["n1"], r["n2"], r["d"]) for r in statistics.kolmogorov_smirnov_pairs(rows, ["k"], "side", "v").collect()}
    assert set(got) == {(k, i, j) for k in ("a", None) for i in range(3) for j in range(i + 1, 3)}
    for (k, i, j), (n1, n2, d) in got.items():
        a, b = (np.array([v for g, s, v in sided if g == k and s == side]) for side in (i, j))
        at = np.union1d(a, b)[:, None]
        assert (n1, n2) == (len(a), len(b)) and abs(d - np.abs((a <= at).mean(axis=1) - (b <= at).mean(axis=1)).max()) < 1e-12
    assert statistics.kolmogorov_smirnov_pairs(rows.where("side = 1"), ["k"], "side", "v").collect() == []
