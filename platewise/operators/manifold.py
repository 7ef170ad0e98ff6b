"""Isomap with landmarks: shortest paths on a sparse neighbour graph, then scaling of the landmarks' distances.

Neighbours are met in grid cells. Paths start at a bounded number of landmarks (LANDMARKS, a parameter) and grow by joins: a round extends the
paths that the last one shortened, so that there are as many rounds as the longest of the shortest paths has edges. The driver holds the
landmarks' distances to one another (LANDMARKS squared) and no row of any other node. Only the largest connected set of nodes (of equals, that
with the smallest label) is laid out, as distances between sets are not defined; points with a null coordinate have no neighbours.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.expressions import norm
from platewise.operators.assignment import finite_places, members, within_radius
from platewise.operators.components import components
from platewise.operators.samples import order
from platewise.operators.tiles import Tiles
from platewise.sources import stored

LANDMARKS = 16


def neighbours(points: DataFrame, radius: float) -> DataFrame:
    """i, j, w in both directions: the distances of points (label, x, y) within the radius. Repeated rows of a label count once."""
    rows = points.select("label", "x", "y").dropDuplicates(["label"])
    near = within_radius(rows, rows, [], radius).where(F.col("label") != F.col("to_label"))
    return near.select(F.col("label").alias("i"), F.col("to_label").alias("j"), F.col("d").alias("w"))


def largest(edges: DataFrame) -> DataFrame:
    """node: those of the largest connected set."""
    member = stored(components(edges.select(F.col("i").alias("a"), F.col("j").alias("b"))), "members")
    most = member.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return member.join(F.broadcast(most.select("component")), "component").select("node")


def landmarks(nodes: DataFrame, count: int = LANDMARKS, seed: int = 1) -> DataFrame:
    """landmark: `count` of the nodes in a seeded order, or all where they are fewer."""
    return nodes.orderBy(order("node", seed), "node").limit(count).select(F.col("node").alias("landmark"))


def geodesics(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """landmark, node, d: the length of the shortest path to every node that a landmark reaches."""
    edges = stored(edges.select(F.col("i").alias("at"), F.col("j").alias("node"), "w"), "edges")
    state = stored(marks.select("landmark", F.col("landmark").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("new")), "paths")
    while not state.where("new").isEmpty():
        front = state.where("new").select("landmark", F.col("node").alias("at"), "d")
        reached = front.join(edges, "at").groupBy("landmark", "node").agg(F.min(F.col("d") + F.col("w")).alias("found"))
        shorter = F.coalesce(F.col("found") < F.col("d"), F.col("d").isNull())
        both = state.select("landmark", "node", "d").join(reached, ["landmark", "node"], "full")
        state = stored(both.select("landmark", "node", F.least("d", "found").alias("d"), (F.col("found").isNotNull() & shorter).alias("new")), "paths")
    return state.select("landmark", "node", "d")


def shortest(tiles: Tiles, marks: DataFrame) -> DataFrame:
    """geodesics() of near places: a round meets the places whose paths the last one has shortened with all that are near them, in tiles. A place is a
    row with a path's length for each landmark, of which there are few (LANDMARKS)."""
    ids = sorted(r["landmark"] for r in marks.collect())
    cols, far = [f"p{c}" for c in range(len(ids))], F.lit(float("inf"))
    begin = [F.when(F.col("label") == i, F.lit(0.0)).otherwise(far).alias(c) for i, c in zip(ids, cols, strict=True)]
    state = stored(tiles.rows.select("label", "tile", "x", "y", *begin, F.col("label").isin(ids).alias("new")), "paths")
    while ids and not state.where("new").isEmpty():
        reached = tiles.least(state.where("new"), cols).withColumnsRenamed({c: f"to_{c}" for c in cols})
        both = state.join(reached, "label", "left")
        shorter = [F.coalesce(F.col(f"to_{c}") < F.col(c), F.lit(False)) for c in cols]
        state = stored(both.select("label", "tile", "x", "y", *[F.least(c, f"to_{c}").alias(c) for c in cols], reduce(or_, shorter).alias("new")), "paths")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("landmark"), F.col(c).alias("d")) for i, c in zip(ids, cols, strict=True)])) if ids else None
    if each is None:
        return marks.select("landmark", F.col("landmark").alias("node"), F.lit(0.0).alias("d"))
    return state.select(F.col("label").alias("node"), each.alias("p")).select("p.landmark", "node", "p.d").where(F.col("d") < far)


def paths_of_points(points: DataFrame, radius: float, count: int = LANDMARKS, seed: int = 1) -> DataFrame:
    """landmark, node, d of the largest connected set of points (label, x, y): geodesics() of their neighbours. Points of one place have the same paths,
    so that edges and paths are those of places, and are handed to the points in the end."""
    rows = stored(points.select("label", "x", "y").dropDuplicates(["label"]), "points")
    tiles = Tiles(finite_places(rows), radius)
    touch = stored(tiles.touching(), "touching")
    part = components(touch).select(F.col("node").alias("cell"), F.col("component").alias("of"))
    member = tiles.cells.join(part, "cell", "left").withColumn("of", F.coalesce("of", "cell"))
    size = member.groupBy("of").agg(F.min("label").alias("component"), F.sum("n").alias("points"))  # a single point has no neighbour
    member = stored(member.join(size.where("points > 1"), "of").select(F.col("label").alias("node"), "x", "y", "n", "component"), "members")
    most = member.groupBy("component").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = member.join(F.broadcast(most.select("component")), "component").select("x", "y", F.col("node").alias("place"))
    nodes = stored(members(inside, rows, []).select(F.col("label").alias("node"), "place"), "nodes")
    marks = stored(landmarks(nodes.select("node"), count, seed).select(F.col("landmark").alias("node")).join(nodes, "node"), "landmarks")
    paths = shortest(tiles, marks.select(F.col("place").alias("landmark")).distinct()).withColumnRenamed("node", "at").join(F.broadcast(marks.select(F.col("node").alias("mark"), F.col("place").alias("landmark"))), "landmark")
    return stored(paths.select(F.col("mark").alias("landmark"), F.col("at").alias("place"), "d").join(nodes, "place").select("landmark", "node", "d"), "paths")


def scaled(paths: DataFrame, most: int) -> tuple[list[float], DataFrame]:
    """The reconstruction error of 1, 2, ... dimensions (the root of the squares that the kernel keeps beyond them, over the landmarks' number), and
    node, x: its place in `most` dimensions, or as many as have a positive eigenvalue. A dimension's sign is such that the landmarks' cubes sum
    to a positive number. paths must hold every node for every landmark."""
    marks = paths.select(F.col("landmark").alias("node")).distinct()
    got = paths.join(F.broadcast(marks), "node").select("landmark", "node", "d").toPandas()  # at most LANDMARKS squared
    ids = sorted(got.landmark.unique())
    if not ids:
        return [], paths.select("node", F.array().cast("array<double>").alias("x"))
    square = got.pivot(index="landmark", columns="node", values="d").loc[ids, ids].to_numpy() ** 2
    square = (square + square.T) / 2
    mean = square.mean(axis=0)
    kernel = -(square - mean[:, None] - mean[None, :] + mean.mean()) / 2
    values, vectors = np.linalg.eigh(kernel)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > 1e-9 * max(values[0], 1e-300)).sum())
    errors = [float(np.sqrt(max((kernel**2).sum() - (values[: c + 1] ** 2).sum(), 0.0)) / len(ids)) for c in range(k)]
    turn = vectors[:, :k] * np.where((vectors[:, :k] ** 3).sum(axis=0) < 0, -1.0, 1.0) / np.sqrt(values[:k])
    spark = paths.sparkSession
    weights = spark.createDataFrame([(int(i), float(m), [float(v) for v in row]) for i, m, row in zip(ids, mean, turn, strict=True)], "landmark bigint, mean double, a array<double>")
    parts = paths.join(F.broadcast(weights), "landmark").withColumn("c", (F.col("d") * F.col("d") - F.col("mean")) * -0.5)
    sums = parts.groupBy("node").agg(F.count("*"), *[F.sum(F.col("c") * F.col("a")[i]).alias(f"x{i}") for i in range(k)])
    return errors, sums.select("node", F.array(*[F.col(f"x{i}") for i in range(k)]).cast("array<double>").alias("x"))


def lost(paths: DataFrame, places: DataFrame, ks: list[int]) -> DataFrame:
    """k, n, lost: 1 - r^2 of the paths' lengths and the distances in the first k dimensions, over all landmarks and nodes."""
    marks = paths.select(F.col("landmark").alias("node")).distinct()
    ends = places.join(F.broadcast(marks), "node").select(F.col("node").alias("landmark"), F.col("x").alias("y"))
    both = paths.join(places, "node").join(F.broadcast(ends), "landmark").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    d = F.sqrt(F.aggregate(F.slice(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(1), F.col("k")), F.lit(0.0), lambda s, v: s + v))
    r = F.corr("d", d)
    return both.groupBy("k").agg(F.count("*").alias("n"), (1 - r * r).alias("lost"))


def isomap(points: DataFrame, radius: float, most: int = 2, count: int = LANDMARKS, seed: int = 1) -> tuple[DataFrame, list[float], DataFrame]:
    """The paths (landmark, node, d), the reconstruction errors, and the places (node, x) of points (label, x, y)."""
    paths = paths_of_points(points, radius, count, seed)
    errors, places = scaled(paths, most)
    return paths, errors, stored(places, "places")


def density(places: DataFrame, groups: DataFrame, control: int, size: float, sigma: float) -> DataFrame:
    """plate, gx, gy, n, share: in square bins of the first two dimensions, the kernel weight exp(-d^2 / sigma^2) of a plate's nodes around the bin's
    centre, over that weight and the control plate's (and 0.001). groups: node, plate. Bins start at the smallest places."""
    at = places.where("size(x) >= 2").select("node", F.col("x")[0].alias("x"), F.col("x")[1].alias("y")).join(groups, "node")
    low = at.agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    bins = at.crossJoin(F.broadcast(low)).withColumns({"gx": F.floor((F.col("x") - F.col("lx")) / size), "gy": F.floor((F.col("y") - F.col("ly")) / size)})
    centre = lambda v: F.col(f"l{v}") + (F.col(f"g{v}") + 0.5) * size
    d = norm(F.col("x") - centre("x"), F.col("y") - centre("y"))
    per = bins.groupBy("plate", "gx", "gy").agg(F.count("*").alias("n"), F.sum(F.exp(-d * d / sigma**2)).alias("w"))
    base = per.where(F.col("plate") == control).select("gx", "gy", F.col("w").alias("base"))
    return per.where(F.col("plate") != control).join(base, ["gx", "gy"], "left").select("plate", "gx", "gy", "n", (F.col("w") / (0.001 + F.col("w") + F.coalesce("base", F.lit(0.0)))).alias("share"))
