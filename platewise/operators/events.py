"""Tracking with events: hypotheses that an object moves, splits, merges, appears or disappears, and the best set of them.

Between two frames every object of the first is the source of exactly one hypothesis, and every object of the second the target of exactly one.
That is an integer program. Its parts are the connected sets of candidates, which are found in Spark. The relaxation is bounded by prices: a
price for each object, such that no hypothesis scores more than its objects' prices; their sum bounds every solution. Small parts are then
solved exactly, and larger ones by rounds in which each object takes its tightest hypothesis, so that their gap to the bound is known.

Labels are unique over all frames. Objects are numbered 2 * label as a source and 2 * label + 1 as a target, and the sorted numbers of a
hypothesis (nodes) are its key. Objects with null coordinates have no candidates, and so appear and disappear. Repeated objects count once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.operators.components import components
from platewise.sources import stored

#: What a split or a merge costs beside two moves, the candidates of an object, rounds of price cuts, and the objects of a part solved exactly.
COST, NEAREST, ROUNDS, EXACT = 5.0, 4, 8, 24
SCHEMA = "nodes array<bigint>, event string, score double"


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs that are among the k nearest of both ends (equal distances by label)."""
    a = F.row_number().over(W.partitionBy("label").orderBy(F.round("d", 9), "to_label"))
    b = F.row_number().over(W.partitionBy("to_label").orderBy(F.round("d", 9), "label"))
    return pairs.withColumns({"ka": a, "kb": b}).where((F.col("ka") <= k) & (F.col("kb") <= k)).drop("ka", "kb")


def hypotheses(pairs: DataFrame, objects: DataFrame, keys: list[str], radius: float, cost: float = COST, nearest: int = NEAREST) -> DataFrame:
    """keys, nodes, event, score. pairs: keys, label, to_label, d of consecutive frames; objects: keys, label, side (0 source, 1 target), once
    for each pair of frames that it is in. A move scores radius - d, a split or merge its two moves' scores less the cost, and an object that
    appears or disappears nothing. An object has at most `nearest` moves, nearest^2 / 2 splits and as many merges."""
    near = _nearest(pairs.select(*keys, "label", "to_label", "d").distinct(), nearest)
    arcs = stored(near.select(*keys, (F.col("label") * 2).alias("s"), (F.col("to_label") * 2 + 1).alias("t"), (F.lit(radius) - F.col("d")).alias("g")), "arcs")

    def double(shared: str, other: str, event: str) -> DataFrame:
        two = arcs.select(*keys, shared, F.col(other).alias("o1"), F.col("g").alias("g1")).join(arcs.select(shared, F.col(other).alias("o2"), F.col("g").alias("g2")), shared).where("o1 < o2")
        return two.select(*keys, F.array_sort(F.array(shared, "o1", "o2")).alias("nodes"), F.lit(event).alias("event"), (F.col("g1") + F.col("g2") - cost).alias("score"))

    moves = arcs.select(*keys, F.array_sort(F.array("s", "t")).alias("nodes"), F.lit("move").alias("event"), F.col("g").alias("score"))
    single = objects.select(*keys, F.array(F.col("label") * 2 + F.col("side")).alias("nodes"), F.when(F.col("side") == 0, "disappear").otherwise("appear").alias("event"), F.lit(0.0).alias("score")).distinct()
    return reduce(DataFrame.unionByName, [moves, double("s", "t", "split"), double("t", "s", "merge"), single])


def parts(hyps: DataFrame) -> DataFrame:
    """node, component: the objects that hypotheses connect; an object without a candidate is a part by itself."""
    edges = hyps.where("size(nodes) > 1").select(F.element_at("nodes", 1).alias("a"), F.explode(F.slice("nodes", 2, 2)).alias("b"))
    joined = components(edges)
    alone = hyps.where("size(nodes) = 1").select(F.col("nodes")[0].alias("node")).join(joined.select("node"), "node", "left_anti")
    return joined.unionByName(alone.select("node", F.col("node").alias("component")))


def prices(hyps: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, u: prices such that no hypothesis scores more than its nodes' sum. They start at the largest score that a hypothesis has for each of
    its nodes; in each round a node gives up the least slack of a node among its hypotheses, which keeps them valid and never raises the sum.
    Cuts of single prices can stall above the relaxation's optimum: the sum is a bound all the same."""
    share = F.col("score") / F.size("nodes")
    now = hyps.select(F.explode("nodes").alias("node"), share.alias("u")).groupBy("node").agg(F.max("u").alias("u"))
    spread = stored(hyps.select("nodes", "score", F.explode("nodes").alias("node")), "incidence")
    for _ in range(rounds):
        now = stored(now, "prices")
        slack = spread.join(now, "node").groupBy("nodes").agg(((F.sum("u") - F.max("score")) / F.count("*")).alias("slack"))
        cut = slack.select(F.explode("nodes").alias("node"), "slack").groupBy("node").agg(F.greatest(F.min("slack"), F.lit(0.0)).alias("cut"))
        now = now.join(cut, "node").select("node", (F.col("u") - F.col("cut")).alias("u"))
    return stored(now, "prices")


def prices_sql(name: str, hyps: str, rounds: int = ROUNDS) -> str:
    """The same as common table expressions; hyps has nodes and score."""
    out = [f"{name}_i as materialized (select nodes, score, len(nodes) as n, unnest(nodes) as node from {hyps})", f"{name}0 as (select node, max(score / n) as u from {name}_i group by node)"]
    for r in range(rounds):
        out.append(f"{name}{r}_s as (select nodes, (sum(u) - max(score)) / count(*) as slack from {name}_i join {name}{r} using (node) group by nodes)")
        out.append(f"{name}{r + 1} as materialized (select node, max(u) - greatest(min(slack), 0) as u from {name}{r} join (select unnest(nodes) as node, slack from {name}{r}_s) using (node) group by node)")
    return ", ".join([*out, f"{name} as (select * from {name}{rounds})"])


def _slack(hyps: DataFrame, priced: DataFrame) -> DataFrame:
    """hyps with slack: what its nodes' prices are over its score."""
    over = hyps.select("nodes", "score", F.explode("nodes").alias("node")).join(priced, "node").groupBy("nodes").agg((F.sum("u") - F.max("score")).alias("slack"))
    return hyps.join(over, "nodes")


def by_rounds(slacked: DataFrame) -> DataFrame:
    """nodes, event, score: a hypothesis is taken when it is the tightest (then best, then smallest) of each of its nodes; those that touch it
    go, and the rest go on. The tightest of all is always taken, so it ends; every node has a hypothesis of its own, so all are covered."""
    rest, out = stored(slacked.select("nodes", "event", "score", F.round("slack", 9).alias("slack")), "open"), []
    while not rest.isEmpty():
        key = F.struct("slack", (-F.col("score")).alias("worse"), "nodes")
        spread = rest.select("nodes", "event", "score", key.alias("k"), F.explode("nodes").alias("node"))
        best = spread.groupBy("node").agg(F.min_by("nodes", "k").alias("best"))
        taken = stored(spread.join(best, "node").groupBy("nodes").agg(F.min("event").alias("event"), F.min("score").alias("score"), F.bool_and(F.col("best") == F.col("nodes")).alias("all")).where("all").drop("all"), "taken")
        out.append(taken)
        gone = taken.select(F.explode("nodes").alias("node"))
        hit = spread.select("nodes", "node").join(gone, "node").select("nodes").distinct()
        rest = stored(rest.join(hit, "nodes", "left_anti"), "open")
    return reduce(DataFrame.unionByName, out) if out else slacked.select("nodes", "event", "score")


def best_cover(nodes: list[tuple[int, ...]], scores: list[float], u: dict[int, float]) -> list[int]:
    """The indices of the hypotheses that cover every node once with the largest score (the first found of equals). A branch ends where the
    score so far and the prices of what is left cannot beat the best."""
    of: dict[int, list[int]] = {}
    for i, around in enumerate(nodes):
        for node in around:
            of.setdefault(node, []).append(i)
    slack = [sum(u[n] for n in around) - s for around, s in zip(nodes, scores, strict=True)]
    for node in of:
        of[node].sort(key=lambda i: (slack[i], nodes[i]))
    best, chosen = (-float("inf"), []), []

    def go(left: frozenset, score: float, bound: float) -> None:
        nonlocal best
        if not left:
            if score > best[0] + 1e-9:
                best = (score, list(chosen))
            return
        if score + bound <= best[0] + 1e-9:
            return
        node = min(left, key=lambda n: (len(of[n]), n))
        for i in of[node]:
            if left.issuperset(nodes[i]):
                chosen.append(i)
                go(left.difference(nodes[i]), score + scores[i], bound - sum(u[n] for n in nodes[i]))
                chosen.pop()

    go(frozenset(of), 0.0, sum(u[n] for n in of))
    return best[1]


def _decided(hyps: DataFrame, keys: list[str], rounds: int, exact: int) -> DataFrame:
    """prices(), parts() and by_rounds() of the hypotheses of each of keys (a pair of frames, which hypotheses don't leave), as arrays of one task. kind
    0: a node, its price (score) and component; 1: a hypothesis that is taken; 2: one of a part that is still open and has at most `exact` objects; 3: a
    component, its objects, bound (price) and score."""
    schema = "kind int, component bigint, nodes array<bigint>, event string, score double, price double, objects bigint"

    def decide(table):
        lists, event, score = table.column("nodes").combine_chunks(), table.column("event").combine_chunks(), table.column("score").to_numpy()
        of, node = np.repeat(np.arange(len(score)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        ids, at = np.unique(node, return_inverse=True)
        size, n = np.bincount(of, minlength=len(score)), len(ids)
        u, label = np.full(n, -np.inf), np.arange(n)
        np.maximum.at(u, at, (score / size)[of])
        over = lambda: np.bincount(of, u[at], len(score)) - score
        for _ in range(rounds):
            cut = np.full(n, np.inf)
            np.minimum.at(cut, at, (over() / size)[of])
            u = u - np.maximum(cut, 0.0)
        while True:  # nodes of a component get its smallest node
            least = np.full(len(score), n)
            np.minimum.at(least, of, label[at])
            new = label.copy()
            np.minimum.at(new, at, least[of])
            new = new[new]
            if (new == label).all():
                break
            label = new
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        padded = [np.where(size > i, node[np.minimum(first + i, len(node) - 1)], -1) for i in range(int(size.max()))]
        rank = np.empty(len(score), np.int64)
        rank[np.lexsort((*padded[::-1], -score, np.round(over(), 9)))] = np.arange(len(score))
        free, taken = np.ones(n, bool), np.zeros(len(score), bool)
        left = np.arange(len(of))
        while len(left):
            best = np.full(n, len(score))
            np.minimum.at(best, at[left], rank[of[left]])
            lost = np.zeros(len(score), bool)
            lost[of[left][best[at[left]] != rank[of[left]]]] = True
            now = left[~lost[of[left]]]
            taken[of[now]], free[at[now]] = True, False
            lost[:] = False
            lost[of[left][~free[at[left]]]] = True
            left = left[~lost[of[left]]]
        part = label[at[first]]
        bound, objects = np.bincount(label, u, n), np.bincount(label, minlength=n)
        total = np.bincount(part[taken], score[taken], n)
        hard = (bound - total > 1e-9) & (objects <= exact)
        parts, nodes = np.flatnonzero(objects), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), ids)
        none = lambda k, kind: pa.nulls(k, kind)

        def rows(kind, component, nodes, event, score, price, objects):
            k = len(component)
            return pa.table([pa.array(np.full(k, kind, np.int32)), pa.array(ids[component]), nodes, event, pa.array(score), pa.array(price), objects], names)

        names = [c.split()[0] for c in schema.split(", ")]
        out = [rows(0, label, nodes, none(n, pa.string()), u, u, none(n, pa.int64()))]
        for kind, which in ((1, np.flatnonzero(taken)), (2, np.flatnonzero(hard[part]))):
            out.append(rows(kind, part[which], lists.take(pa.array(which)), event.take(pa.array(which)), score[which], score[which], none(len(which), pa.int64())))
        out.append(rows(3, parts, none(len(parts), lists.type), none(len(parts), pa.string()), total[parts], bound[parts], pa.array(objects[parts])))
        target = pa.schema([("kind", pa.int32()), ("component", pa.int64()), ("nodes", pa.list_(pa.int64())), ("event", pa.string()), ("score", pa.float64()), ("price", pa.float64()), ("objects", pa.int64())])
        return pa.concat_tables([t.cast(target) for t in out])

    return stored(hyps.select(*keys, "nodes", "event", "score").groupBy(*keys).applyInArrow(lambda table: decide(table), schema), "decided")


def prices_by(hyps: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """prices() of hypotheses that stay within keys, such as a pair of frames, each of which is in one task."""
    return _decided(hyps, keys, rounds, 0).where("kind = 0").select(F.col("nodes")[0].alias("node"), F.col("price").alias("u"))


def infer(hyps: DataFrame, exact: int = EXACT, rounds: int = ROUNDS, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen hypotheses (nodes, event, score, component), and for each component: objects, bound (the prices' sum), score, proven. All are
    chosen by rounds; components of up to `exact` objects, whose score is then under the bound, are solved exactly, each as one row of at most
    that many objects. A larger component is never in one row; there, the score is proven only where it meets the bound. With keys that hypotheses stay
    within, such as a pair of frames, prices, components and rounds are a task's work for each of them, and hypotheses are in one shuffle."""
    if keys:
        all_ = _decided(hyps, keys, rounds, exact)
        member = priced = all_.where("kind = 0").select(F.col("nodes")[0].alias("node"), "component", F.col("price").alias("u"))
        priced, member = priced.select("node", "u"), member.select("node", "component")
        tight = all_.where("kind = 1").select("nodes", "event", "score", "component")
        about = all_.where("kind = 3").select("component", "objects", F.col("price").alias("bound"), "score", (F.col("price") - F.col("score") > 1e-9).alias("open"))
        held = all_.where("kind = 2").select("nodes", "event", "score", "component")
    else:
        hyps = stored(hyps.select("nodes", "event", "score"), "hypotheses")
        priced = prices(hyps, rounds)
        member = stored(parts(hyps), "members")
        first = member.select(F.col("node").alias("first"), "component")
        within = lambda rows: rows.withColumn("first", F.element_at("nodes", 1)).join(first, "first").drop("first")
        tight = stored(within(by_rounds(_slack(hyps, priced))), "tight")
        about = member.join(priced, "node").groupBy("component").agg(F.count("*").alias("objects"), F.sum("u").alias("bound"))
        about = stored(about.join(tight.groupBy("component").agg(F.sum("score").alias("score")), "component").withColumn("open", F.col("bound") - F.col("score") > 1e-9), "parts")
        held = within(hyps)
    hard = about.where(F.col("open") & (F.col("objects") <= exact)).select("component")
    known = member.join(hard, "component").join(priced, "node").groupBy("component").agg(F.collect_list(F.struct("node", "u")).alias("u"))
    puzzles = held.join(hard, "component").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("nodes", "event", "score"))).alias("h")).join(known, "component")

    def solve(batches):
        import pandas as pd

        for batch in batches:
            for component, held, u in zip(batch.component, batch.h, batch.u, strict=True):
                keep = best_cover([tuple(int(n) for n in x["nodes"]) for x in held], [x["score"] for x in held], {int(x["node"]): x["u"] for x in u})
                yield pd.DataFrame([(held[i]["nodes"], held[i]["event"], held[i]["score"], component) for i in keep], columns=["nodes", "event", "score", "component"])

    solved = stored(puzzles.mapInPandas(solve, SCHEMA + ", component bigint"), "solved")
    chosen = tight.join(hard, "component", "left_anti").select("nodes", "event", "score", "component").unionByName(solved)
    better = solved.groupBy("component").agg(F.sum("score").alias("best"))
    result = about.join(better, "component", "left").select("component", "objects", "bound", F.coalesce("best", "score").alias("score"), (~F.col("open") | F.col("best").isNotNull()).alias("proven"))
    return chosen, result


def augmented(hyps: DataFrame, truth: DataFrame, margin: float = 1.0) -> DataFrame:
    """hyps whose score has the margin added where they are not in truth (nodes): the best set of these is the most violated constraint."""
    return hyps.join(truth.select("nodes", F.lit(True).alias("true")), "nodes", "left").withColumn("score", F.col("score") + F.when(F.col("true"), 0.0).otherwise(margin)).drop("true")
