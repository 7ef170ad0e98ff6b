"""Spectral clustering and Isomap of tracks (letters L and H)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.model import q6, query, r6, track_points
from platewise.operators import manifold as M
from platewise.operators import mixed
from platewise.operators import spectral as L
from platewise.operators.samples import order_sql
from platewise.sources import stored

#: Tracks are neighbours where their mean positions lie this near; DELTA: of the affinity exp(-delta d^2).
NEAR, DELTA, STEPS = 4.0, 0.05, 8
CENTRES = "t as (select track_id, avg(x) as x, avg(y) as y from track_points group by track_id)"
GRAPH = f"{CENTRES}, e as (select a.track_id as i, b.track_id as j, exp(-{DELTA} * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as w from t a join t b on a.track_id <> b.track_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {NEAR}), d as (select i, sum(w) as degree from e group by i)"


def _points(spark, sf_dir):
    """Mean positions of tracks. Values are summed in their order, so that tracks with the same values are in one place; a track is bounded by its movie."""
    rows = track_points(spark, sf_dir)
    values = lambda v: F.array_sort(F.collect_list(v))
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))
    rows = rows.groupBy(F.col("track_id").alias("label")).agg(values("x").alias("x"), values("y").alias("y"), F.min("plate").alias("plate"))
    return stored(rows.select("label", mean(F.col("x")).alias("x"), mean(F.col("y")).alias("y"), "plate"), "points")


def clusters(edges: DataFrame, k: int | None = None, seed: int = 2) -> tuple[np.ndarray, DataFrame]:
    """The eigenvalues, and exp, label, d of k clusters (as many as the eigengap says where k is not given) of the nodes with a neighbour."""
    values, vectors = L.eigenvectors(edges)
    return values, grouped(values, vectors, k or L.eigengap(values), seed)


def grouped(values: np.ndarray, vectors: DataFrame, k: int, seed: int = 2) -> DataFrame:
    """exp, label, d: k-means of the nodes on their first k eigenvectors."""
    if not len(values):
        return vectors.select(F.col("i").alias("exp"), F.lit(0).alias("label"), F.lit(0.0).alias("d"))
    points = stored(L.embedded(vectors, min(k, len(values))), "embedded").select(F.col("exp"), F.array("f").alias("parts"))
    centres = [(i, parts) for i, (_, parts, _) in enumerate(mixed.seeds(points, "exp", ["euclidean"], [1.0], k, seed))]
    for _ in range(STEPS):
        now = mixed.assigned(points, centres, ["euclidean"], [1.0])
        mean = now.groupBy("label").agg(*[F.avg(F.col("parts")[0][c]).alias(f"m{c}") for c in range(len(centres[0][1][0]))]).collect()  # k rows
        moved = dict((r["label"], [list(r)[1:]]) for r in mean)
        new = [(i, moved.get(i, parts)) for i, parts in centres]
        if np.allclose([p[0] for _, p in new], [p[0] for _, p in centres], rtol=0, atol=1e-12):
            break
        centres = new
    return mixed.assigned(points, centres, ["euclidean"], [1.0]).select("exp", "label", "d")


@query("L09_neighbour_graph", f"{GRAPH} select e.i, e.j, {q6('w / degree')} as p from e join d using (i)", "track_points")
def neighbour_graph(spark, sf_dir):
    """The random walk on the neighbour graph of tracks; isolates are not in it."""
    return L.random_walk(_points(spark, sf_dir), NEAR, DELTA).select("i", "j", r6(F.col("p")).alias("p"))


@query("L09_spectral_clusters")
def spectral_clusters(spark, sf_dir):
    """Tracks with a neighbour, in as many clusters as the eigengap of their graph says."""
    values, vectors = L.vectors_of_points(_points(spark, sf_dir), NEAR, DELTA)
    got = grouped(values, vectors, L.eigengap(values))
    return got.select(F.col("exp").alias("track_id"), "label")


@query("L09_eigenvalues")
def eigenvalues(spark, sf_dir):
    """The smallest eigenvalues of the graph's Laplacian, and whether the number of clusters ends there."""
    values, _ = L.vectors_of_points(_points(spark, sf_dir), NEAR, DELTA)
    gap = L.eigengap(values)
    return spark.createDataFrame([(i, round(1 - float(v), 6) + 0.0, i + 1 == gap) for i, v in enumerate(values)], "place int, value double, last boolean")


DELTAS, KS = (0.02, 0.2), (2, 4)


@query("H08_agreement_by_parameters")
def agreement_by_parameters(spark, sf_dir):
    """For each delta and number of clusters: the share of tracks that are in their plate's most frequent cluster."""
    points = _points(spark, sf_dir)
    out = []
    for delta in DELTAS:
        values, vectors = L.vectors_of_points(points, NEAR, delta)
        vectors = stored(vectors, "vectors")
        for k in KS:
            n = grouped(values, vectors, k).join(points.select(F.col("label").alias("exp"), "plate"), "exp").groupBy("plate", "label").agg(F.count("*").alias("n"))
            most = n.groupBy("plate").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
            out.append(most.agg(F.sum("n").alias("n"), r6(F.sum("most") / F.sum("n")).alias("ratio")).select(F.lit(delta).alias("delta"), F.lit(k).alias("k"), "n", "ratio"))
    return reduce(DataFrame.unionByName, out)


#: The longest paths' landmarks are drawn with this seed; DIMENSIONS of the sweep; radii of its neighbours; bins and kernel of the densities.
SEED, DIMENSIONS, RADII, BIN, SIGMA = 1, 3, (4.0, 6.0), 4.0, 4.0
PATHS = f"""r as (select i, i as j from d union select r.i, x.j from r join e x on r.j = x.i), c as (select i, min(j) as part from r group by i),
b as (select part from c group by part order by count(*) desc, part limit 1), m as (select i as landmark from c where part = (select part from b) order by {order_sql("i", SEED)}, i limit {M.LANDMARKS}),
h as materialized (select i, j, sqrt((a.x - z.x) ** 2 + (a.y - z.y) ** 2) as w from e join t a on a.track_id = i join t z on z.track_id = j union all select i, i, 0 from d),
g as (select 0 as round, landmark, landmark as node, 0.0::double as d from m union all select round + 1, landmark, h.j, min(g.d + h.w) from g join h on h.i = g.node where round < (select count(*) from d) group by round, landmark, h.j)"""


@query("L08_geodesics", f"{GRAPH}, {PATHS} select landmark, node, {q6('min(d)')} as d from g group by landmark, node", "track_points")
def geodesics(spark, sf_dir):
    """The lengths of the shortest paths from landmarks over the neighbour graph of tracks."""
    return M.paths_of_points(_points(spark, sf_dir), NEAR, seed=SEED).select("landmark", "node", r6(F.col("d")).alias("d"))


@query("L08_isomap_sweep")
def isomap_sweep(spark, sf_dir):
    """For each radius and number of dimensions: the reconstruction error, and what of the paths' variance is lost."""
    out, points = [], _points(spark, sf_dir)
    for radius in RADII:
        paths, errors, places = M.isomap(points, radius, DIMENSIONS, seed=SEED)
        per = spark.createDataFrame([(k + 1, float(e)) for k, e in enumerate(errors)], "k int, error double")
        rows = M.lost(paths, places, list(range(1, DIMENSIONS + 1))).join(F.broadcast(per), "k")
        out.append(rows.select(F.lit(radius).alias("radius"), "k", "n", r6(F.col("error")).alias("error"), r6(F.col("lost")).alias("lost")))
    return reduce(DataFrame.unionByName, out)


@query("L12_isomap_density")
def isomap_density(spark, sf_dir):
    """Where plates lie in the plane of an Isomap, bin by bin, against the control plate."""
    points = _points(spark, sf_dir)
    _, _, places = M.isomap(points, NEAR, 2, seed=SEED)
    return M.density(places, points.select(F.col("label").alias("node"), "plate"), 0, BIN, SIGMA).withColumn("share", r6(F.col("share")))
