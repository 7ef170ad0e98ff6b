"""Tracking with events against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import events as E
from platewise.operators.assignment import next_frame, within_radius
from platewise.operators.components import components


def covers(nodes, scores):
    """The best score of all ways to take each node once, by trying every one."""
    all_nodes = sorted({n for x in nodes for n in x})

    def search(left):
        if not left:
            return 0.0
        node = min(left)
        return max((scores[i] + search(left - set(x)) for i, x in enumerate(nodes) if node in x and set(x) <= left), default=-np.inf)

    return search(frozenset(all_nodes))


def planted(spark, rows):
    objects = spark.createDataFrame(rows, "plate int, frame int, label bigint, x double, y double")
    pairs = within_radius(objects, next_frame(objects, ["plate"]), ["plate", "frame"], 8.0)
    sides = objects.where("frame = 0").select("plate", "frame", "label", F.lit(0).alias("side")).unionByName(objects.where("frame = 1").select("plate", F.lit(0).alias("frame"), "label", F.lit(1).alias("side")))
    return E.hypotheses(pairs, sides, ["plate", "frame"], 8.0)


def events_of(chosen):
    return sorted((r["event"], tuple(r["nodes"])) for r in chosen.collect())


def test_each_event_is_found(spark):
    rows = [
        (0, 0, 1, 0.0, 0.0), (0, 1, 2, 1.0, 0.0),  # moves
        (0, 0, 3, 100.0, 0.0), (0, 1, 4, 101.0, 0.0), (0, 1, 5, 99.0, 0.0),  # splits
        (0, 0, 6, 200.0, 0.0), (0, 0, 7, 202.0, 0.0), (0, 1, 8, 201.0, 0.0),  # merge
        (0, 0, 9, 300.0, 0.0), (0, 1, 10, 400.0, 0.0), (0, 0, 11, None, 1.0),  # gone, new, without a place
        (0, 0, 1, 0.0, 0.0),  # a repeated row
    ]
    chosen, parts = E.infer(planted(spark, rows))
    assert events_of(chosen) == [("appear", (21,)), ("disappear", (18,)), ("disappear", (22,)), ("merge", (12, 14, 17)), ("move", (2, 5)), ("split", (6, 9, 11))]
    assert all(r["proven"] for r in parts.collect())


@pytest.mark.parametrize("exact", [0, 24])
def test_choice_against_exhaustive_search(spark, exact):
    rng = np.random.default_rng(3)
    rows = [(c, f, 100 * c + 10 * f + i, *(rng.uniform(0, 7, 2)).tolist()) for c in range(12) for f in (0, 1) for i in range(4)]
    hyps = planted(spark, rows)
    chosen, parts = E.infer(hyps, exact=exact, rounds=4)
    parts = {r["component"]: r for r in parts.collect()}
    owner = {r["node"]: r["component"] for r in E.parts(hyps).collect()}
    held = {}
    for r in hyps.collect():
        held.setdefault(owner[r["nodes"][0]], []).append((tuple(r["nodes"]), r["score"]))
    taken = [n for r in chosen.collect() for n in r["nodes"]]
    assert sorted(taken) == sorted(owner) and set(held) == set(parts)
    for c, h in held.items():
        best = covers([x for x, _ in h], [s for _, s in h])
        assert parts[c]["score"] <= best + 1e-9 and best <= parts[c]["bound"] + 1e-9
        assert not parts[c]["proven"] or abs(parts[c]["score"] - best) < 1e-6
        assert exact == 0 or parts[c]["proven"]


def test_prices_bound_every_hypothesis_and_fall(spark):
    rng = np.random.default_rng(5)
    hyps = planted(spark, [(0, f, 100 * f + i, *(rng.uniform(0, 20, 2)).tolist()) for f in (0, 1) for i in range(15)])
    sums = []
    for rounds in (0, 1, 3):
        u = {r["node"]: r["u"] for r in E.prices(hyps, rounds).collect()}
        assert all(sum(u[n] for n in r["nodes"]) >= r["score"] - 1e-9 for r in hyps.collect())
        sums.append(sum(u.values()))
    assert sums[0] >= sums[1] >= sums[2]


def test_no_objects(spark):
    chosen, parts = E.infer(planted(spark, []))
    assert chosen.count() == parts.count() == 0


def test_margins(spark):
    hyps = planted(spark, [(0, 0, 1, 0.0, 0.0), (0, 1, 2, 1.0, 0.0)])
    truth = spark.createDataFrame([([2, 5],)], "nodes array<bigint>")
    got = {r["event"]: r["score"] for r in E.augmented(hyps, truth, 10.0).collect()}
    assert got == {"move": 7.0, "appear": 10.0, "disappear": 10.0}
    assert events_of(E.infer(E.augmented(hyps, truth, 10.0), rounds=2)[0]) == [("appear", (5,)), ("disappear", (2,))]


@pytest.mark.parametrize("edges", [[], [(1, 2), (3, 2), (5, 4), (6, 6), (None, 3)], [(i, i + 1) for i in range(40)], [(99, i) for i in range(30)] + [(200, 100)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


@pytest.mark.parametrize("exact", [0, 24])
def test_choice_within_frames_is_the_same(spark, exact):
    rng = np.random.default_rng(7)
    hyps = planted(spark, [(c, f, 1000 * c + 100 * f + i, *(rng.uniform(0, 25, 2)).tolist()) for c in range(4) for f in (0, 1) for i in range(20)]).cache()
    (plain, about), (keyed, about_keyed) = E.infer(hyps, exact=exact), E.infer(hyps, exact=exact, keys=["plate", "frame"])
    assert events_of(plain) == events_of(keyed)
    rows = lambda df: sorted((r["component"], r["objects"], round(r["bound"], 9), round(r["score"], 9), r["proven"]) for r in df.collect())
    assert rows(about) == rows(about_keyed)
    u, v = ({r["node"]: r["u"] for r in df.collect()} for df in (E.prices(hyps, 3), E.prices_by(hyps, ["plate", "frame"], 3)))
    assert u.keys() == v.keys() and all(abs(u[n] - v[n]) < 1e-9 for n in u)
