"""Clustering: mean vectors, nearest centres, and sweeps with pyspark.ml."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.expressions import euclidean
from platewise.operators import samples
from platewise.sources import stored

#: Centres that are broadcast in one array; past it rows meet the centres in blocks of so many, one array each.
MOST_CENTRES = 10_000


def mean_vectors(rows: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """keys, f: the mean of each element."""
    mean = rows.select(*keys, F.posexplode(f).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("f"))


def nearest(rows: DataFrame, centres: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """exp, label, d: the nearest centre (label, f) of each row, the smallest label of equals. Centres are gathered into arrays of about MOST_CENTRES."""
    blocks = max(1, -(-centres.count() // MOST_CENTRES))
    block, best = F.pmod(F.xxhash64("label"), F.lit(blocks)), None
    for i in range(blocks):
        array = centres.where(block == i).agg(F.array_sort(F.collect_list(F.struct("label", "f"))).alias("centres "))
        apart = F.transform("centres ", lambda c: F.struct(c["label"].alias("label"), euclidean(F.col("f"), c["f"]).alias("d")))  # a distance is taken once
        of_block = F.array_min(F.transform(apart, lambda c: F.struct(F.round(c["d"], 9).alias("k"), c["label"].alias("label"), c["d"].alias("d"))))
        rows = rows.crossJoin(F.broadcast(array)).withColumn("b ", of_block if best is None else F.least("b ", of_block)).drop("centres ")
        best = F.col("b ")
    return rows.select("exp", *(keep or []), F.col("b ")["label"].alias("label"), F.col("b ")["d"].alias("d"))


def kmeans_sweep(rows: DataFrame, ks, seed: int = 7) -> DataFrame:
    """k, silhouette, cohesion (within / total sum of squares) for each k."""
    spark = rows.sparkSession
    data = rows.select(array_to_vector("f").alias("features")).cache()
    total = rows.select(F.posexplode("f").alias("i", "v")).groupBy("i").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s")).first()[0]
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
        out.append((k, round(ClusteringEvaluator().evaluate(model.transform(data)), 4), round(model.summary.trainingCost / total, 4)))
    data.unpersist()
    return spark.createDataFrame(out, "k int, silhouette double, cohesion double")


def mixture_sweep(rows: DataFrame, ks, dimensions: int | None = None, seed: int = 7) -> DataFrame:
    """k, log_likelihood, bic, partition_entropy (the mean entropy of a row's probabilities) of Gaussian mixtures, on all or on the first dimensions."""
    f = F.slice("f", 1, dimensions) if dimensions else F.col("f")
    dimensions = dimensions or len(rows.select("f").first()[0])
    data = rows.select(array_to_vector(f).alias("features")).cache()
    n, out = data.count(), []
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(data)
        likelihood = model.summary.logLikelihood
        free = k * (1 + dimensions + dimensions * (dimensions + 1) / 2) - 1
        p = vector_to_array(model.summary.probability["probability"])
        entropy = model.summary.probability.agg(F.avg(F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.ln(v)).otherwise(0.0)))).first()[0]
        out.append((k, round(likelihood, 3), round(-2 * likelihood + free * math.log(n), 3), round(entropy, 6)))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, log_likelihood double, bic double, partition_entropy double")


def mixture_labels(rows: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """exp, label, p: the component of a Gaussian mixture that each row most likely comes from, numbered by falling weight, and its probability.
    Rows whose vectors are null, or hold null or non-finite elements, are left out; vectors have one length."""
    bad = F.exists("f", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    data = rows.where(F.col("f").isNotNull() & ~bad).select("exp", array_to_vector("f").alias("features"))
    if not data.head(1):
        return data.select("exp", F.lit(0).alias("label"), F.lit(0.0).alias("p"))
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(data)
    heaviest = sorted(range(k), key=lambda i: (-model.weights[i], i))
    number = F.array(*[F.lit(heaviest.index(i)) for i in range(k)])
    return model.transform(data).select("exp", number[F.col("prediction")].alias("label"), vector_to_array("probability")[F.col("prediction")].alias("p"))


def control_pca(rows: DataFrame, components: int) -> DataFrame:
    """exp, and pc0, pc1, ...: the projection on the principal components of the controls. A component's largest loading is positive."""
    data = rows.select("exp", "is_control", array_to_vector("f").alias("features"))
    model = PCA(k=components, inputCol="features", outputCol="pc").fit(data.where("is_control"))
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] > 0 else -1.0 for column in loadings.T]
    a = model.transform(data).select("exp", vector_to_array("pc").alias("pc"))
    return a.select("exp", *[F.round(F.col("pc")[i] * signs[i], 6).alias(f"pc{i}") for i in range(components)])


def first_centres(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """label (from 0), f: k rows (exp, f) in a seeded random order."""
    chosen = samples.first_n(rows.select("exp", "f"), "exp", k, seed)
    return chosen.select((F.row_number().over(W.orderBy(samples.order("exp", seed), "exp")) - 1).cast("long").alias("label"), "f")  # k rows


def lloyd(rows: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """exp (a key), label, d after steps rounds of assignment to the nearest centre and of new means; clusters that are empty go. Centres are
    written each round, so that no round is made anew by the next, and rows keep their vector, so that none is shuffled."""
    centres = stored(centres, "centres")
    for _ in range(steps):
        centres = stored(mean_vectors(nearest(rows.where("exp is not null"), centres, keep=["f"]), ["label"]), "centres")
    return nearest(rows, centres)


def ward(f: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of Ward's clustering: of each pair the one whose union adds least to the sum of squares. Clusters are
    numbered from len(f) on as they are made."""
    n = len(f)
    size, name, out = np.ones(n), list(range(n)), []
    d = ((f[:, None] - f) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for k in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        out.append((name[i], name[j], float(np.sqrt(d[i, j]))))
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        new[[i, j]] = np.inf
        new[np.isinf(d[i])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = size[i] + size[j], n + k
    return out


#: Means that Ward's clustering takes: it compares all of them in one task.
MOST_WARD = 4000


def ward_clusters(means: DataFrame, key: str, level: float = 0.7) -> DataFrame:
    """key, cluster, place: the flat clusters below level times the largest height, named by their smallest key, and the order of the leaves."""
    if means.count() > MOST_WARD:
        raise ValueError(f"more than {MOST_WARD} rows: cluster their means")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key).reset_index(drop=True)
        merges, n = ward(np.stack(pdf.f.to_numpy())), len(pdf)
        leaves, cut = {i: [i] for i in range(n)}, {i: i for i in range(n)}
        top = max((h for *_, h in merges), default=0.0)
        for k, (a, b, h) in enumerate(merges):
            leaves[n + k] = leaves[a] + leaves[b]
            if h <= level * top:
                cut |= dict.fromkeys(leaves[n + k], min(leaves[n + k]))
        order = leaves[n + len(merges) - 1] if n else []
        place = {leaf: i for i, leaf in enumerate(order)}
        return pd.DataFrame({key: pdf[key], "cluster": [pdf[key][cut[i]] for i in range(n)], "place": [place[i] for i in range(n)]})

    kind = dict(means.dtypes)[key]
    return means.select(key, "f", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: run(pdf), f"{key} {kind}, cluster {kind}, place bigint")
