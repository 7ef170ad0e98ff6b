"""Histograms, divergences and pair tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows up to which a side of all pairs is broadcast; past it Spark meets blocks with blocks.
BROADCAST_ROWS = 20_000


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the upper edge belongs to the last bin."""
    width = F.when(high > low, (high - low) / bins)
    return F.coalesce(F.least(F.floor((value - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")


def histograms(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """keys, h: the share of each of bins equal-width bins over the range of all rows. Counted per bin, then laid out as an array."""
    bounds = rows.agg(F.min(value).alias("low "), F.max(value).alias("high "))
    binned = rows.crossJoin(F.broadcast(bounds)).select(*keys, bin_of(F.col(value), F.col("low "), F.col("high "), bins).alias("b"))
    wide = binned.groupBy(*keys).agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(bins)], F.count("*").alias("n "))
    return wide.select(*keys, F.array(*[F.col(f"b{i}") / F.col("n ") for i in range(bins)]).alias("h"))


def pair_table(rows: DataFrame, key: str, value: str, distance, within: list[str] | None = None) -> DataFrame:
    """i, j, d for i < j: distance is a function of the two value columns. Rows meet only within the keys of within: all pairs of a
    table are asked for only where the table is small, such as conditions or plates."""
    within = within or []
    a = rows.select(*within, F.col(key).alias("i"), F.col(value).alias("a"))
    b = rows.select(*within, F.col(key).alias("j"), F.col(value).alias("b"))
    if within:
        pairs = a.join(b, within).where("i < j")
    else:
        pairs = a.join(F.broadcast(b) if rows.count() <= BROADCAST_ROWS else b, F.col("i") < F.col("j"))
    return pairs.select(*within, "i", "j", distance(F.col("a"), F.col("b")).alias("d"))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def sinkhorn(a: np.ndarray, b: np.ndarray, sharpness: float, steps: int = 500) -> np.ndarray:
    """Entropic transport cost between the rows of a and b for the cost |i - j| / (bins - 1); equal rows cost 0."""
    n = a.shape[1]
    cost = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / max(1, n - 1)
    kernel = np.exp(-sharpness * cost)
    u, tiny = np.ones_like(a), 1e-300
    for _ in range(steps):
        v = b / np.maximum(u @ kernel, tiny)
        u = a / np.maximum(v @ kernel.T, tiny)
    out = np.einsum("ki,ij,kj->k", u, kernel * cost, v)
    return np.where((a == b).all(axis=1), 0.0, out)


def sinkhorn_distance(a: Column, b: Column, sharpness: float = 10.0) -> Column:
    """An Arrow UDF: batches of pairs of histograms."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(sinkhorn(np.stack(x.to_numpy()), np.stack(y.to_numpy()), sharpness)) if len(x) else pd.Series([], dtype=float)

    return run(a, b)
