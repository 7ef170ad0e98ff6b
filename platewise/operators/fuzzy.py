"""Fuzzy c-means: soft memberships, centres as means with powered memberships, and the usual indices.

All runs (numbers of clusters, restarts) advance in one pass over the rows. A task adds up its rows' weighted sums, Spark adds the tasks', and the
driver gets the centres: as many numbers as all runs' clusters have dimensions. Vectors that are null, or hold null, NaN or infinite elements, or have
another length than the first of a seeded order, are left out. A row on a centre belongs to it alone, or in equal parts to all centres there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.samples import first_n


def usable(rows: DataFrame) -> DataFrame:
    """exp, f: the rows whose vectors are whole."""
    bad = F.exists("f", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.select("exp", F.col("f").cast("array<double>").alias("f")).where(F.col("f").isNotNull() & (F.size("f") > 0) & ~bad)


def memberships(square: np.ndarray, m: float) -> np.ndarray:
    """Rows by clusters, from squared distances; rows sum to one."""
    zero = square == 0
    power = np.where(zero.any(axis=1, keepdims=True), zero, np.where(zero, 1.0, square) ** (-1 / (m - 1)))
    return power / power.sum(axis=1, keepdims=True)


def _pass(rows: DataFrame, runs: list[np.ndarray], m: float) -> list[dict]:
    """For each run (k x d centres): n, total (d), w (k), wx (k x d), wd (k), entropy, as sums over all rows."""

    def add(batches):
        total = 0.0
        for batch in batches:
            x = batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1)
            out = []
            for v in runs:
                square = np.stack([((x - c) ** 2).sum(axis=1) for c in v], axis=1)
                u = memberships(square, m)
                w = u**m
                out += [[len(x)], x.sum(axis=0), w.sum(axis=0), (w.T @ x).ravel(), (w * square).sum(axis=0), [(u * np.log2(np.where(u > 0, u, 1.0))).sum()]]
            total = total + np.concatenate(out)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    got = rows.select("f").mapInArrow(add, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros(len(got))
    flat[got["i"].to_numpy()] = got["s"].to_numpy()
    sums, at = [], 0
    for v in runs:
        k, d = v.shape
        cut = np.split(flat[at : at + 2 + d + 2 * k + k * d], np.cumsum([1, d, k, k * d, k]))
        sums.append({"n": cut[0][0], "total": cut[1], "w": cut[2], "wx": cut[3].reshape(k, d), "wd": cut[4], "entropy": cut[5][0]})
        at += 2 + d + 2 * k + k * d
    return sums


def fuzzy_means(rows: DataFrame, runs: list[tuple[int, int]], m: float = 2.0, steps: int = 20, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The centres of each run (clusters, seed), after `steps` rounds or when no centre moves more than the tolerance. It starts at rows in the seed's
    order; with fewer rows than clusters, each row is one."""
    starts = [np.array([r["f"] for r in first_n(rows, "exp", k, seed).collect()]) for k, seed in runs]  # k rows each
    if not len(starts) or not len(starts[0]):
        return []
    for _ in range(steps):
        new = [np.where(s["w"][:, None] > 0, s["wx"] / np.where(s["w"] > 0, s["w"], 1.0)[:, None], v) for s, v in zip(_pass(rows, starts, m), starts, strict=True)]
        still = all(np.abs(a - b).max() <= tolerance for a, b in zip(new, starts, strict=True))
        starts = new
        if still:
            break
    return starts


def indices(rows: DataFrame, centres: list[np.ndarray], m: float = 2.0) -> list[tuple[int, float, float | None, float | None]]:
    """k, Fukuyama-Sugeno, Xie-Beni and normalised partition entropy of each run; the last two are null with one cluster, and Xie-Beni with
    centres that coincide."""
    out = []
    for v, s in zip(centres, _pass(rows, centres, m) if centres else [], strict=True):
        k, mean = len(v), s["total"] / s["n"]
        apart = [((v[i] - v[j]) ** 2).sum() for i in range(k) for j in range(i)]
        sugeno = (s["wd"] - s["w"] * ((v - mean) ** 2).sum(axis=1)).sum()
        beni = s["wd"].sum() / (s["n"] * min(apart)) if apart and min(apart) > 0 else None
        out.append((k, float(sugeno), None if beni is None else float(beni), float(-s["entropy"] / (s["n"] * np.log2(k))) if k > 1 else None))
    return out


def belonging(rows: DataFrame, centres: np.ndarray, m: float = 2.0) -> DataFrame:
    """exp, u: the memberships of each row."""

    def run(batches):
        for batch in batches:
            x = batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1)
            u = memberships(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1), m)
            yield pa.RecordBatch.from_arrays([batch.column("exp"), pa.ListArray.from_arrays(np.arange(0, u.size + 1, u.shape[1], dtype=np.int32), u.ravel())], ["exp", "u"])

    return rows.select("exp", "f").mapInArrow(run, f"exp {dict(rows.dtypes)['exp']}, u array<double>")
