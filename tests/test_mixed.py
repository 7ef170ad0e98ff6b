"""Clustering by mixed distances: seeding by brute force, mass, starved centres, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import mixed, samples

KINDS, WEIGHTS = ["euclidean", "hellinger", "total_variation"], [0.5, 0.3, 0.2]


def planted(n=60, seed=1):
    rng = np.random.default_rng(seed)
    centres = [([0.0, 0.0], [0.8, 0.1, 0.1], [0.5, 0.5]), ([6.0, 0.0], [0.1, 0.8, 0.1], [0.9, 0.1]), ([0.0, 6.0], [0.1, 0.1, 0.8], [0.1, 0.9])]
    rows = []
    for i in range(n):
        x, h, g = centres[i % 3]
        rows.append((i, [[float(v + rng.normal(0, 0.3)) for v in x], *[(rng.multinomial(50, p) / 50).tolist() for p in (h, g)]]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key bigint, parts array<array<double>>").repartition(3)


def gap(a, b):
    x, h, g = [np.array(p) for p in a], [np.array(p) for p in b], None
    return 0.5 * math.sqrt(((x[0] - h[0]) ** 2).sum()) + 0.3 * math.sqrt(((np.sqrt(x[1]) - np.sqrt(h[1])) ** 2).sum() / 2) + 0.2 * np.abs(x[2] - h[2]).sum()


@pytest.mark.parametrize("ranges", [1 << 16, 7])
def test_seeds_by_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixed, "RANGE_ROWS", ranges)
    rows = planted()
    by_key = dict(rows)
    got = mixed.seeds(frame(spark, [*rows, (None, rows[0][1])]), "key", KINDS, WEIGHTS, 4, 5)
    first = min(by_key, key=lambda k: mixed.hashlib.md5(f"5:{k}".encode()).hexdigest())
    closest = {k: gap(by_key[k], by_key[first]) ** 2 for k in by_key}
    want = [(first, sum(closest.values()))]
    for step in range(1, 4):
        upto, total, trials = 0.0, want[-1][1], []
        cumulated = [(k, upto := upto + closest[k]) for k in sorted(by_key)]
        for t in range(mixed.trials_of(4)):
            k = next(k for k, v in cumulated if v >= mixed.uniform(5, step, t) * total)
            new = {j: min(closest[j], gap(by_key[j], by_key[k])) for j in by_key}
            trials.append((round(sum(new.values()), 9), t, k, new))
        _, _, k, closest = min(trials, key=lambda x: x[:2])
        want.append((k, sum(closest.values())))
    assert [k for k, *_ in got] == [k for k, _ in want] and np.allclose([v for *_, v in got], [v for _, v in want])
    assert len({k % 3 for k, *_ in got[:3]}) == 3


def test_mini_batches_find_planted_clusters_and_keep_mass(spark):
    rows = frame(spark, planted(90))
    centres = mixed.mini_batches(rows, "key", KINDS, WEIGHTS, 3, 30, 4, 2)
    assert all(abs(sum(part) - 1) < 1e-9 for _, parts, _ in centres for part in parts[1:]) and sum(n for *_, n in centres) == 120
    got = mixed.assigned(rows, [(label, parts) for label, parts, _ in centres], KINDS, WEIGHTS).collect()
    assert len({(r["key"] % 3, r["label"]) for r in got}) == 3


def test_starved_centres_are_given_a_row(spark, monkeypatch):
    monkeypatch.setattr(mixed, "STARVED", 0.9)
    centres = mixed.mini_batches(frame(spark, planted(31)), "key", KINDS, WEIGHTS, 5, 12, 1, 2)
    top = max(n for *_, n in centres)
    assert all(n >= 0.9 * top for *_, n in centres)


def test_splitting_reads_the_largest_cluster_only(spark):
    got = mixed.split_sweep(frame(spark, planted()), "key", KINDS, WEIGHTS, 4, 3).collect()
    labels = {k: {r["key"]: r["label"] for r in got if r["k"] == k} for k in (2, 3, 4)}
    for k in (3, 4):
        old, new = labels[k - 1], labels[k]
        counts = np.bincount(list(old.values()))
        assert all(new[i] == old[i] or (new[i] == k - 1 and old[i] == counts.argmax()) for i in old) and len(set(new.values())) == k


def test_keyed_clusters_choose_the_planted_number(spark):
    space = mixed.Space(["euclidean", "hellinger", "hellinger"], WEIGHTS, [2, 3, 2])
    rows = frame(spark, planted(180)).withColumn("movie", F.when(F.col("key") < 150, 1).otherwise(F.when(F.col("key") % 2 == 0, 2)))
    runs = mixed.runs_of((2, 3), 3)
    got = mixed.keyed_clusters(rows.where("movie is not null"), "movie", "key", space, runs, 4, 1)
    rows_of = got.collect()
    assert len(rows_of) == 150 + 15
    assert all(0.9 < sum(v * v for v in r["e"][2:5]) < 1.1 for r in rows_of)
    per = {(r["movie"], r["k"]): r for r in mixed.stability(got, runs).collect()}
    assert set(per) == {(m, k) for m in (1, 2) for k in (2, 3)} and all(0 < r["stability"] <= 1 + 1e-9 for r in per.values())
    assert [sum(per[m, k]["chosen"] for k in (2, 3)) for m in (1, 2)] == [1, 1]


def test_few_alike_and_no_rows(spark):
    same = frame(spark, [(i, [[1.0], [1.0, 0.0], [0.5, 0.5]]) for i in range(4)])
    assert len(mixed.seeds(same, "key", KINDS, WEIGHTS, 3, 1)) == 1
    assert {r["label"] for r in mixed.split_sweep(same, "key", KINDS, WEIGHTS, 3, 1).collect()} == {0}
    assert mixed.seeds(same.limit(0), "key", KINDS, WEIGHTS, 3, 1) == [] and mixed.mini_batches(same.limit(0), "key", KINDS, WEIGHTS, 3, 9, 2, 1) == []
    space = mixed.Space(["euclidean", "hellinger", "hellinger"], WEIGHTS, [1, 2, 2])
    assert mixed.keyed_clusters(same.limit(0).withColumn("m", F.lit(1)), "m", "key", space, mixed.runs_of((2,), 1), 1, 1).collect() == []
    assert samples.order_sql("key", 1)


def test_keyed_distances_are_taken_once(spark):
    """The plan has one distance (two square roots of sums) for each kind of weight, whatever is read from it, and elements are no rows."""
    space = mixed.Space(["euclidean", "hellinger", "hellinger"], WEIGHTS, [2, 3, 2])
    rows = frame(spark, planted(30)).select(F.lit(1).alias("movie"), "key", space.flat(F.col("parts")).alias("e"), F.array(F.lit(0)).alias("subsamples"))
    centres = rows.select("movie", F.array(F.struct(F.lit(0).alias("run"), F.lit(0).alias("s"), F.array(F.struct(F.lit(0).alias("label"), "e")).alias("cs"))).alias("runs")).limit(1)
    plan = mixed._with_centres(rows, centres, space)._jdf.queryExecution().analyzed().toString().lower()
    labels = next(line for line in plan.splitlines() if " as labels#" in line)
    assert labels.count("sqrt(") == sum(w != 0 for w in WEIGHTS)
