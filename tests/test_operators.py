"""Small cases with known answers, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.operators import assignment, clean, distances, hits, layout, statistics, tracks

POINTS = "plate bigint, track_id bigint, frame int, x double, y double"


def track(spark, *paths):
    return spark.createDataFrame([(0, t, i, float(x), float(y)) for t, path in enumerate(paths) for i, (x, y) in enumerate(path)], POINTS)


def test_straight_track(spark):
    r = tracks.track_features(track(spark, [(i, 0) for i in range(12)])).first()
    assert (r["n_steps"], r["total_length"], r["effective_length"], r["persistence"], r["mean_turning"], r["mean_acceleration"], r["straightness"]) == (11, 11.0, 11.0, 1.0, 0.0, 0.0, 1.0)
    s = tracks.shape_features(track(spark, [(i, 0) for i in range(12)]), 1.0).first()
    assert s["hull_area"] == 0 and s["balls"] == 4


def test_unit_square(spark):
    r = tracks.track_features(track(spark, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), 1).first()
    assert r["total_length"] == 4 and r["effective_length"] == 0 and abs(r["persistence"]) < 1e-12 and abs(r["mean_turning"] - math.pi / 2) < 1e-12
    assert tracks.hull_area(np.array([0, 1, 1, 0, 0]), np.array([0, 0, 1, 1, 0])) == 1


def test_common_drift_is_removed(spark):
    points = track(spark, [(i, 0) for i in range(6)], [(5 + i, 3) for i in range(6)])
    assert [(r["drift_x"], r["drift_y"]) for r in tracks.drift(points).orderBy("frame").collect()] == [(float(i), 0.0) for i in range(1, 6)]
    assert {(r["track_id"], r["x"], r["y"]) for r in tracks.corrected(points).collect()} == {(0, 0.0, 0.0), (1, 5.0, 3.0)}


def test_features_do_not_change_when_a_track_is_moved_or_turned(spark):
    rng = random.Random(1)
    path = [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(20)]
    turned = [(10 - y, 5 + x) for x, y in path]
    a, b = tracks.track_features(track(spark, path, turned)).orderBy("track_id").collect()
    assert all(math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-9) for c in a.asDict() if c != "track_id")


def test_moment_scaling_of_ballistic_motion(spark):
    r = tracks.scaling(track(spark, [(2 * i, i) for i in range(30)])).first()
    assert abs(r["movement_type"] - 1) < 1e-9 and r["adequation"] == 0


def test_longest_run_and_run_lengths(spark):
    rows = spark.createDataFrame([(1, v) for v in (1, 2, 3, 7, 8, 3)], "k int, v int")
    assert tuple(tracks.longest_runs(rows, ["k"], "v").first()) == (1, 1, 3, 3)
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, s string")
    assert [(r["s"], r["length"]) for r in tracks.run_lengths(rows, ["k"], "i", "s").orderBy("run").collect()] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]


def both(spark, a, b):
    rows = lambda values: spark.createDataFrame([("g", float(v)) for v in values], "k string, v double")
    return statistics.against_pool(rows(a), rows(b), ["k"], "v")


def test_ks_and_rank_sum(spark):
    assert statistics.kolmogorov_smirnov(both(spark, [1, 2, 3], [4, 5, 6]), ["k"]).first()["d"] == 1
    r = statistics.kolmogorov_smirnov(both(spark, [1, 2, 3], [1, 2, 3]), ["k"]).first()
    assert r["d"] == 0 and r["p"] == 1
    r = statistics.rank_sum(both(spark, [1, 2, 3], [4, 5, 6]), ["k"]).first()
    assert abs(r["z"] + 1.9639610121239315) < 1e-9 and abs(r["p"] - 0.04953461) < 1e-6
    assert statistics.kolmogorov_smirnov(both(spark, [1], []), ["k"]).count() == 0


def test_ks_and_rank_sum_by_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 12, 40).astype(float)
    groups = {g: rng.integers(0, 8 + 3 * g, 25).astype(float) for g in range(4)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g int, v double")
    both = statistics.against_pool(rows, spark.createDataFrame([(float(v),) for v in pool], "v double"), ["g"], "v")
    d = {r["g"]: r["d"] for r in statistics.kolmogorov_smirnov(both, ["g"]).collect()}
    z = {r["g"]: r["z"] for r in statistics.rank_sum(both, ["g"], ties=True).collect()}
    for g, x in groups.items():
        at = np.unique(np.r_[x, pool])
        assert abs(d[g] - max(abs((x <= v).mean() - (pool <= v).mean()) for v in at)) < 1e-12
        every = np.r_[x, pool]
        rank = np.array([(every < v).sum() + ((every == v).sum() + 1) / 2 for v in every])
        n1, n2, n = len(x), len(pool), len(every)
        tie = sum(t**3 - t for t in np.unique(every, return_counts=True)[1])
        off = rank[:n1].sum() - n1 * (n + 1) / 2
        want = np.sign(off) * max(0, abs(off) - 0.5) / np.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
        assert abs(z[g] - want) < 1e-9


def test_control_against_control_is_uniform(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(g, float(v)) for g in range(200) for v in rng.normal(size=30)], "g int, v double")
    pool = spark.createDataFrame([(float(v),) for v in rng.normal(size=6000)], "v double")
    p = np.array([r["p"] for r in statistics.rank_sum(statistics.against_pool(rows, pool, ["g"], "v"), ["g"]).collect()])
    assert abs((p < 0.5).mean() - 0.5) < 0.12 and (p < 0.05).mean() < 0.12


def test_planted_hits_are_found(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(g, float(v + (3 if g < 5 else 0))) for g in range(40) for v in rng.normal(size=40)], "g int, v double")
    pool = spark.createDataFrame([(float(v),) for v in rng.normal(size=1600)], "v double")
    q = {r["g"]: r["q"] for r in statistics.bh(statistics.kolmogorov_smirnov(statistics.against_pool(rows, pool, ["g"], "v"), ["g"])).collect()}
    assert all(q[g] < 0.01 for g in range(5)) and sum(q[g] < 0.05 for g in range(5, 40)) <= 2


def test_quantiles_and_running_sums_by_brute_force(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=301).round(1), "b": np.full(50, 2.0), "c": np.array([5.0]), "d": rng.integers(0, 3, 200).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("e", None)], "k string, v double")
    qs = {"low": 0.0, "q": 0.25, "m": 0.5, "h": 0.93, "top": 1.0}
    got = {r["k"]: r for r in statistics.quantiles(rows, ["k"], "v", qs).collect()}
    assert set(got) == set(groups) and all(abs(got[k][n] - np.quantile(x, q)) < 1e-9 for k, x in groups.items() for n, q in qs.items())
    every = np.concatenate(list(groups.values()))
    assert abs(statistics.quantiles(rows, [], "v", {"m": 0.3}).first()["m"] - np.quantile(every, 0.3)) < 1e-9
    numbered = statistics.row_numbers(rows.where("v is not null").withColumn("id", F.monotonically_increasing_id()), "v", "id")
    assert sorted(r["row"] for r in numbered.collect()) == list(range(1, len(every) + 1))


def test_bh_and_fisher(spark):
    rows = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,), (None,)], "p double")
    assert {round(r["q"], 12) for r in statistics.bh(rows).collect()} == {0.04}
    rng = np.random.default_rng(8)
    p = np.sort(rng.random(300).round(2) ** 2)
    raw = np.minimum(1, p * len(p) / np.arange(1, len(p) + 1))
    want = np.minimum.accumulate(raw[::-1])[::-1]
    got = statistics.bh(spark.createDataFrame([(float(v),) for v in p], "p double")).orderBy("p", "q").collect()
    assert np.allclose(sorted(r["q"] for r in got), want)
    r = spark.range(1).select(X.chi2_sf_even(F.lit(4 * math.log(2)), F.lit(2)).alias("p"), X.normal_sf(F.lit(1.959963985)).alias("n"), X.kolmogorov_sf(F.lit(1.3581)).alias("k")).first()
    assert abs(r["p"] - 0.25 * (1 + 2 * math.log(2))) < 1e-12 and abs(r["n"] - 0.025) < 1e-7 and abs(r["k"] - 0.05) < 1e-4


@pytest.mark.parametrize("m, x", [(1, 0.0), (1, 3.0), (9, 20.0), (60, 130.0), (200, 380.0), (200, 9000.0), (5000, 10_100.0), (200, 1.0), (100_000, 199_000.0)])
def test_chi2_survival_of_any_number_of_p_values(spark, m, x):
    terms = [i * math.log(x / 2) - math.lgamma(i + 1) - x / 2 for i in range(m)] if x else [0.0]
    want = min(1.0, math.fsum(math.exp(t) for t in terms))
    got = spark.range(1).select(X.chi2_sf_even(F.lit(x), F.lit(m)).alias("p")).first()["p"]
    assert abs(got - want) < 1e-9


def test_empirical_p(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 0.5), (3, 2.0)], "id int, v double")
    null = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "c double")
    assert {r["id"]: r["p"] for r in statistics.empirical_p(rows, null, "v", "c").collect()} == {1: 0.25, 2: 1.0, 3: 0.75}


def test_divergences_and_transport(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0)))
    r = spark.range(1).select(X.emd_1d(a, b).alias("emd"), X.total_variation(a, b).alias("tv"), X.hellinger(a, b).alias("h")).first()
    assert (r["emd"], r["tv"], r["h"]) == (2.0, 2.0, 1.0)
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.ones(8), 20), rng.dirichlet(np.ones(8), 20)
    exact = np.abs(np.cumsum(p - q, axis=1)).sum(axis=1) / 7
    assert np.allclose(distances.sinkhorn(p, q, 200.0, 3000), exact, atol=0.02) and (distances.sinkhorn(p, p, 10.0) == 0).all()


def test_neighbours(spark):
    rows = spark.createDataFrame([(1,), (14,)], "position int")
    got = {(r["position"], r["neighbour"]) for r in layout.neighbours(rows).collect()}
    assert {n for p, n in got if p == 1} == {2, 13, 14} and len([1 for p, _ in got if p == 14]) == 8
    near = layout.isolated(spark.createDataFrame([("a", 1), ("a", 14), ("a", 100), ("b", 2)], "k string, position int"), ["k"])
    assert {(r["k"], r["position"]): r["has_neighbour"] for r in near.collect()} == {("a", 1): True, ("a", 14): True, ("a", 100): False, ("b", 2): False}


def test_rank_product_and_hits(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0), ("a", 2, 1.0), ("c", 2, 2.0)], "c string, b int, v double")
    assert {r["c"]: round(r["rank_product"], 9) for r in hits.rank_product(rows, "c", "b", "v").collect()} == {"a": 1.0, "b": 2.0, "c": round(math.sqrt(6), 9)}
    rows = spark.createDataFrame([("g", "s1", True)] * 2 + [("g", "s2", False)] * 3 + [("h", "s3", True)], "gene string, sirna string, hit boolean")
    assert {r["gene"]: r["hit"] for r in hits.two_level_hits(rows, "sirna", "gene", "hit").collect()} == {"g": True, "h": False}


def test_extremal_difference(spark):
    curves = spark.createDataFrame([("e", "c1", 0, 0.8), ("e", "c1", 1, 0.5), ("e", "c2", 0, 0.2), ("e", "c2", 1, 0.5)], "k string, cls string, t int, v double")
    control = spark.createDataFrame([("c1", 0, 0.9), ("c1", 1, 0.9), ("c2", 0, 0.1), ("c2", 1, 0.1)], "cls string, t int, v double")
    assert {r["cls"]: round(r["score"], 9) for r in hits.extremal_difference(curves, control, ["k", "cls"], ["cls", "t"]).collect()} == {"c1": -0.4, "c2": 0.4}


def test_radius_join_is_exact(spark):
    rng = random.Random(6)
    rows = [(f, i + 100 * f, rng.uniform(-30, 30), rng.uniform(-30, 30)) for f in range(3) for i in range(60)]
    table = spark.createDataFrame(rows, "frame int, label int, x double, y double")
    got = {(r["label"], r["to_label"]) for r in assignment.within_radius(table, table, ["frame"], 5.0).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 5}


def test_chains(spark, tmp_path):
    links = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 101)], "label int, to_label int")
    got = {(r["label"], r["track"], r["position"]) for r in assignment.chains(links, f"file://{tmp_path}").collect()}
    assert got == {(i, 0, i) for i in range(38)} | {(100, 100, 0), (101, 100, 1)}


def test_renumbering_and_doses(spark):
    rows = spark.createDataFrame([(f, f) for f in range(6)], "frame int, label int")
    gone = spark.createDataFrame([(1,), (3,)], "frame int")
    assert [(r["label"], r["frame"]) for r in clean.without_frames(rows, gone).orderBy("label").collect()] == [(0, 0), (2, 1), (4, 2), (5, 3)]
    doses = spark.createDataFrame([("12,5 uM",), ("3 nM",), ("1 mg",)], "d string")
    assert [r[0] for r in doses.select(F.round(clean.molar(F.col("d")), 12)).collect()] == [1.25e-05, 3e-09, 0.0]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_rows(spark, n):
    points = track(spark, [(0, 0)] * n)
    assert tracks.steps(points).count() == 0 and tracks.drift(points).count() == 0 and tracks.scaling(points).count() == 0 and tracks.shape_features(points, 1.0).count() == n


def test_nearest_centre_past_one_array(spark, monkeypatch):
    from platewise.operators import clusters

    monkeypatch.setattr(clusters, "MOST_CENTRES", 3)
    centres = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "label bigint, f array<double>")
    rows = spark.createDataFrame([(i, [i + 0.25, 1.0]) for i in range(10)] + [(10, [4.5, 0.0])], "exp bigint, f array<double>")
    got = {r["exp"]: (r["label"], r["d"]) for r in clusters.nearest(rows, centres).collect()}
    assert {e: c for e, (c, _) in got.items()} == {i: i for i in range(10)} | {10: 4} and all(math.isclose(got[i][1], math.hypot(0.25, 1)) for i in range(10))


def test_trajectory_vectors_do_not_change_when_a_track_is_moved_or_turned(spark):
    rng = np.random.default_rng(12)
    path = np.cumsum(rng.normal(size=(30, 2)), axis=0)
    turn = np.array([[np.cos(1.1), -np.sin(1.1)], [np.sin(1.1), np.cos(1.1)]])
    rows = [(0, k, i, float(x), float(y)) for k, p in enumerate((path, path + [40, -7], path @ turn.T)) for i, (x, y) in enumerate(p)]
    got = tracks.trajectory_vectors(spark.createDataFrame(rows, "plate bigint, track_id bigint, frame int, x double, y double")).toPandas().set_index("track_id").drop(columns="plate")
    assert len(got.columns) >= 24 and np.allclose(got.loc[0], got.loc[1]) and np.allclose(got.loc[0], got.loc[2], atol=1e-9)
    steps = np.diff(path, axis=0)
    length = np.hypot(*steps.T)
    cosine = (steps[1:] * steps[:-1]).sum(axis=1) / (length[1:] * length[:-1])
    r = got.loc[0]
    assert abs(r.total_length - length.sum()) < 1e-9 and abs(r.largest_move - length.max()) < 1e-9 and abs(r.mean_persistence - cosine.mean()) < 1e-9 and abs(r.speed_correlation - np.corrcoef(length[:-1], cosine)[0, 1]) < 1e-9


def test_end_codes_from_lineage(spark):
    spans = spark.createDataFrame([(0, 1, 0, 9), (0, 2, 3, 7), (0, 3, 4, 9), (0, 4, 5, 6), (0, 5, 2, 8)], "plate bigint, track_id bigint, first int, last int")
    lineage = spark.createDataFrame([(2, 3), (2, 8), (4, 9), (5, 9)], "parent bigint, child bigint")
    got = {r["track_id"]: (r["start_code"], r["end_code"]) for r in tracks.end_codes(spans, lineage).collect()}
    assert got == {1: (0, 0), 2: (1, 2), 3: (2, 0), 4: (1, 3), 5: (1, 3)}


def test_control_pca_is_a_projection_with_fixed_signs(spark):
    from platewise.operators import clusters

    rng = np.random.default_rng(13)
    f = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    control = np.arange(60) < 40
    rows = spark.createDataFrame([(i, bool(control[i]), f[i].tolist()) for i in range(60)], "exp int, is_control boolean, f array<double>")
    got = clusters.control_pca(rows, 2).orderBy("exp").toPandas()
    _, vectors = np.linalg.eigh(np.cov(f[control].T))
    for i in range(2):
        v = vectors[:, -1 - i]
        assert np.allclose(got[f"pc{i}"], f @ (v * np.sign(v[np.abs(v).argmax()])), atol=1e-5)


def test_best_assignment_and_optimal_links_by_brute_force(spark):
    from itertools import permutations

    from platewise.operators import assignment

    rng = np.random.default_rng(14)
    for _ in range(40):
        n, m = rng.integers(1, 6, 2)
        gain = np.where(rng.random((n, m)) < 0.7, rng.random((n, m)).round(3), 0.0)
        got = assignment.best_assignment(gain)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(gain[i, j] > 0 for i, j in got)
        wide = gain if n <= m else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(gain[i, j] for i, j in got) - best) < 1e-9
    # mutual nearest neighbours would link 2 and 11 only
    pairs = spark.createDataFrame([(0, 1, 11, 3.0), (0, 2, 11, 1.0), (0, 2, 12, 2.0), (0, 5, 15, 7.9), (1, 1, 11, 4.0)], "frame int, label bigint, to_label bigint, d double")
    assert sorted(tuple(r) for r in assignment.optimal_links(pairs, ["frame"], 8.0).collect()) == [(0, 1, 11, 3.0), (0, 2, 12, 2.0), (0, 5, 15, 7.9), (1, 1, 11, 4.0)]


def test_ward_by_brute_force(spark):
    from platewise.operators import clusters

    rng = np.random.default_rng(15)
    f = rng.normal(size=(12, 3))
    held, heights = {i: [i] for i in range(12)}, []
    squares = lambda rows: ((f[rows] - f[rows].mean(axis=0)) ** 2).sum()
    for k in range(11):
        a, b = min(((a, b) for a in held for b in held if a < b), key=lambda p: squares(held[p[0]] + held[p[1]]) - squares(held[p[0]]) - squares(held[p[1]]))
        heights.append(np.sqrt(2 * (squares(held[a] + held[b]) - squares(held[a]) - squares(held[b]))))
        held[12 + k] = held.pop(a) + held.pop(b)
    assert np.allclose([h for *_, h in clusters.ward(f)], heights)
    rows = spark.createDataFrame([(i, (f[i] + (10 if i >= 6 else 0)).tolist()) for i in range(12)], "condition bigint, f array<double>")
    got = {r["condition"]: (r["cluster"], r["place"]) for r in clusters.ward_clusters(rows, "condition").collect()}
    assert {c for c, _ in got.values()} == {0, 6} and all(got[i][0] == (6 if i >= 6 else 0) for i in range(12)) and sorted(p for _, p in got.values()) == list(range(12))


def test_local_fits_of_lines_and_constants(spark):
    from platewise.operators import smoothing

    rows = spark.createDataFrame([("line", i, 2.0 * i + 1) for i in range(20)] + [("flat", i, 3.0) for i in range(20)], "k string, frame int, v double")
    for held_out in (False, True):
        assert all(abs(r["fit"] - r["v"]) < 1e-9 for r in smoothing.local_fits(rows, ["k"], 0.4, 1, held_out).collect())
    got = smoothing.local_fits(rows, ["k"], 0.4, 0).collect()
    assert all(abs(r["fit"] - 3) < 1e-9 for r in got if r["k"] == "flat") and len(got) == 40


def test_lowess_and_two_segments_of_known_curves():
    from platewise.operators import smoothing

    line = 0.5 * np.arange(30) - 2
    assert np.allclose(smoothing.lowess(line), line) and np.allclose(smoothing.lowess(np.full(9, 4.0)), 4)
    noisy = line + np.random.default_rng(16).normal(size=30)
    assert np.abs(smoothing.lowess(noisy) - line).mean() < np.abs(noisy - line).mean()
    corner = np.array([[float(i), 0.0] for i in range(6)] + [[5.0, float(i)] for i in range(1, 5)])
    assert smoothing.two_segments(corner) == (5, 0.0)


def test_distances_with_transport_are_their_parts(spark):
    from platewise.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    squared, plain = ({(r["i"], r["j"]): r for r in QUERIES[n](spark, sf).collect()} for n in ("K12_squared_with_transport", "K13_distance_with_transport"))
    transport = {(r["i"], r["j"]): r["sinkhorn"] for r in QUERIES["K11_sinkhorn"](spark, sf).collect()}
    for k, r in squared.items():
        assert abs(r["numeric"] - plain[k]["numeric"] ** 2) < 1e-3 and r["transport"] == plain[k]["transport"] == transport[k]
        assert abs(r["d"] - 0.7 * r["numeric"] - 0.3 * r["transport"]) < 1e-5
