"""Spectral clustering on a sparse neighbour graph: a normalised operator, block Krylov iteration, the eigengap, k-means on the vectors.

Neighbours are met in grid cells, so that the graph has as many edges as there are near pairs. Vectors are columns of one table; a
multiplication is a join with the edges and a sum, and vectors are made orthogonal by their inner products, which are all that the driver
knows of them (at most BLOCK * STEPS squared). Null coordinates have no neighbours; isolates are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.assignment import bundled, finite_places, members, near_places, within_radius
from platewise.operators.samples import order
from platewise.operators.tiles import Tiles
from platewise.sources import stored

#: Eigenvectors wanted, vectors of a block, multiplications before a new start, new starts at most, and the residual of a settled vector.
WANTED, BLOCK, STEPS, RESTARTS, TOLERANCE = 6, 4, 10, 3, 1e-5


def neighbour_graph(points: DataFrame, radius: float, delta: float) -> DataFrame:
    """i, j, w in both directions: exp(-delta d^2) of points (label, x, y) within the radius. Isolates are in no row."""
    near = within_radius(points, points, [], radius).where(F.col("label") != F.col("to_label"))
    return near.select(F.col("label").alias("i"), F.col("to_label").alias("j"), F.exp(-delta * F.col("d") * F.col("d")).alias("w"))


def normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with p = w / degree(i) (the random walk) and n = w / sqrt(degree(i) degree(j)), and the degrees (i, degree)."""
    degrees = edges.groupBy("i").agg(F.sum("w").alias("degree"))
    both = edges.join(degrees, "i").join(degrees.select(F.col("i").alias("j"), F.col("degree").alias("other")), "j")
    return both.select("i", "j", "w", (F.col("w") / F.col("degree")).alias("p"), (F.col("w") / F.sqrt(F.col("degree") * F.col("other"))).alias("n")), degrees


def random_walk(points: DataFrame, radius: float, delta: float) -> DataFrame:
    """i, j, p: the random walk on the points' neighbour graph. Degrees are those of places, and the points' pairs are written out in the end, in no shuffle."""
    rows = points.select("label", "x", "y")
    near = stored(near_places(stored(finite_places(rows), "places"), radius), "near")
    w = F.exp(-delta * F.col("d") * F.col("d"))
    degrees = near.groupBy("label").agg(F.sum(w * F.col("others")).alias("degree"))
    walk = near.join(degrees, "label").select("x", "y", "to_x", "to_y", (w / F.col("degree")).alias("p"))
    ours = bundled(rows, [], ["label"], "ours").drop("bundle")
    theirs = bundled(rows, [], ["label"], "theirs").select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), "theirs")
    both = walk.join(ours, ["x", "y"]).join(theirs, ["to_x", "to_y"]).select("p", "theirs", F.explode("ours.label").alias("i"))
    return both.select("i", F.explode("theirs.label").alias("j"), "p").where("i <> j")


def _start(c: int, seed: int) -> Column:
    """In [-0.5, 0.5), by the MD5 of seed, vector and node."""
    return F.conv(F.substring(order(F.concat_ws(":", F.lit(c), "i"), seed), 1, 12), 16, 10).cast("double") / 16.0**12 - 0.5


def _gram(rows: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
    """Inner products of the columns a with the columns b: matrix products where the rows are, whose entries Spark sums."""

    def run(batches):
        total = 0
        for batch in batches:
            x, y = (np.stack([batch.column(c).to_numpy() for c in names]) for names in (a, b))
            total = total + x @ y.T
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "x"])

    got = rows.select(*dict.fromkeys([*a, *b])).mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(len(a) * len(b))
    out[got["k"].to_numpy()] = got["x"].to_numpy()
    return out.reshape(len(a), len(b))


def _sum(q: list[str], m: np.ndarray) -> str:
    return " + ".join(f"{float(x)!r}D * {c}" for c, x in zip(q, m, strict=True))


def eigenvectors(edges: DataFrame, wanted: int = WANTED, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """The largest eigenvalues of the random walk on the graph, and i, v0, v1, ...: its eigenvectors, of unit length with the degrees as
    weights. The block of vectors is multiplied, made orthogonal to all vectors before it, and added to them, until the wanted ones' residuals are
    under TOLERANCE; after STEPS multiplications it starts again from the best vectors, RESTARTS times at most."""
    both, degrees = normalised(edges)
    degrees = stored(degrees, "degrees")
    both = stored(both.select("i", "j", "n"), "edges")

    def times(state, cols, out):
        return both.join(state.select(F.col("i").alias("j"), *cols), "j").groupBy("i").agg(*[F.expr(f"sum(n * {c}) as {z}") for c, z in zip(cols, out, strict=True)])

    values, best = _largest(times, degrees.select("i", F.sqrt("degree").alias("root")), wanted, seed)
    return values, best.join(degrees, "i").select("i", *[F.expr(f"b{c} / sqrt(degree) as v{c}") for c in range(len(values))])


def vectors_of_points(points: DataFrame, radius: float, delta: float, wanted: int = WANTED, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """eigenvectors() of the points' neighbour graph, whose edges are those of places: points of one place have the same neighbours, so that a vector
    of theirs is one value or sums to zero there. The latter have the eigenvalue -1 / degree; where one of these is wanted, the whole graph is taken."""
    rows = points.select("label", "x", "y")
    tiles = Tiles(finite_places(rows), radius)
    # a place's own points are among its sum, the point itself too; what has no other near it has no degree
    sums = tiles.sums(tiles.rows.withColumn("n", F.col("n").cast("double")), {"total": "n"}, delta)
    degrees = tiles.rows.join(sums, "label").select(F.col("label").alias("i"), "tile", "x", "y", "n", (F.col("total") - 1).alias("degree"))
    places = stored(degrees.where("degree > 0"), "degrees")
    scale = F.sqrt(F.col("n") / F.col("degree"))

    def times(state, cols, out):
        theirs = state.join(places, "i").select("tile", "x", "y", *[(scale * F.col(c)).alias(c) for c in cols])
        moved = tiles.sums(theirs, dict(zip(out, cols, strict=True)), delta).withColumnRenamed("label", "i")
        own = state.select("i", *[F.col(c).alias(f"own_{c}") for c in cols])
        return moved.join(places, "i").join(own, "i").select("i", *[(scale * F.col(z) - F.col(f"own_{c}") / F.col("degree")).alias(z) for c, z in zip(cols, out, strict=True)])

    values, best = _largest(times, places.select("i", F.sqrt(F.col("n") * F.col("degree")).alias("root")), wanted, seed)
    zero = places.where("n > 1").agg(F.max(-1 / F.col("degree"))).first()[0]  # of vectors that sum to zero in a place
    if zero is not None and (len(values) < wanted or values[-1] <= zero + TOLERANCE):
        return eigenvectors(neighbour_graph(rows, radius, delta), wanted, seed)
    best = best.join(places, "i").select("x", "y", *[F.expr(f"b{c} / sqrt(n * degree) as v{c}") for c in range(len(values))])
    return values, members(best, rows, []).select(F.col("label").alias("i"), *[f"v{c}" for c in range(len(values))])


def _largest(times: Callable, roots: DataFrame, wanted: int, seed: int) -> tuple[np.ndarray, DataFrame]:
    """The largest eigenvalues of a symmetric matrix, and i, b0, b1, ...: its vectors; root is the vector of the eigenvalue 1. times(vectors, columns, names)
    multiplies the columns by the matrix: i and names."""
    roots = stored(roots, "roots")
    nodes = roots.count()
    if not nodes:
        return np.empty(0), roots.select("i")
    size = min(BLOCK, nodes)
    # the first vector is known: the roots of the degrees
    start = roots.select("i", F.col("root").alias("b0"), *[_start(c, seed).alias(f"b{c}") for c in range(1, size)])
    for _ in range(1 + RESTARTS):
        state, cols = stored(start, "vectors"), [f"b{c}" for c in range(size)]
        length, axes = np.linalg.eigh(_gram(state, cols, cols))
        good = length > 1e-14 * length.max()
        state = state.select("i", *[F.expr(f"{_sum(cols, m)} as b{c}") for c, m in enumerate((axes[:, good] / np.sqrt(length[good])).T)])
        cols = cols[: int(good.sum())]
        last, h = cols, np.zeros((0, 0))
        for step in range(STEPS):
            z = [f"z{c}" for c in range(len(last))]
            together = stored(state.join(times(state, last, z), "i"), "vectors")
            products = _gram(together, [*cols, *z], z)
            inside, rest = products[: len(cols)], products[len(cols) :]
            old = len(cols) - len(last)
            h = np.block([[h, inside[:old]], [inside[:old].T, inside[old:]]])
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            rest = rest - inside.T @ inside
            off = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", turn[-len(last) :], rest, turn[-len(last) :]), 0))
            size_of, axes = np.linalg.eigh((rest + rest.T) / 2)
            good = size_of > 1e-13
            settled = off[:wanted].max() < TOLERANCE or not good.any()
            if settled or step == STEPS - 1:
                break
            new = axes[:, good] / np.sqrt(size_of[good])
            fresh = [f"b{len(cols) + c}" for c in range(new.shape[1])]
            state = together.select("i", *cols, *[F.expr(f"{_sum(z, new[:, c])} + {_sum(cols, -(inside @ new)[:, c])} as {x}") for c, x in enumerate(fresh)])
            cols, last = [*cols, *fresh], fresh
        k = min(max(wanted, size), len(values))
        best = together.select("i", *[F.expr(f"{_sum(cols, turn[:, c])} as b{c}") for c in range(k)])
        if settled:
            break
        start, size = best, k
    k = min(wanted, k)
    return values[:k], stored(best.select("i", *[f"b{c}" for c in range(k)]), "vectors")


def eigengap(values: np.ndarray, least: int = 2) -> int:
    """The number of clusters, at least two, after which the eigenvalues fall most (the first of equals)."""
    falls = values[least - 1 : -1] - values[least:]
    return least + int(np.argmax(np.round(falls, 9))) if len(falls) else min(least, len(values))


def embedded(vectors: DataFrame, k: int) -> DataFrame:
    """exp, f: the first k eigenvectors of each node as a point. A vector's sign is such that its sum of cubes is positive."""
    signs = vectors.agg(*[F.sum(F.pow(F.col(f"v{c}"), F.lit(3.0))).alias(f"s{c}") for c in range(k)])
    return vectors.crossJoin(F.broadcast(signs)).select(F.col("i").alias("exp"), F.array(*[F.when(F.col(f"s{c}") < 0, -F.col(f"v{c}")).otherwise(F.col(f"v{c}")) for c in range(k)]).alias("f"))
