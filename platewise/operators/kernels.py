"""Kernel k-means with centres in the span of landmarks.

A centre is a weighted sum of at most LANDMARKS rows' images, so that a row needs its kernel with the landmarks and no matrix of all rows: each round
is one pass that adds up these columns by cluster, for all kernels, numbers of clusters and restarts at once. The driver gets as many numbers as the
clusters have landmarks. Where the landmarks span the images (linear and cosine kernels with as many landmarks as dimensions, or any kernel with all
rows as landmarks) the result is that of kernel k-means on the whole matrix; else centres are the nearest in the landmarks' span. Vectors that are
null, or hold null, NaN or infinite elements, or have another length than the first landmark, are left out. A cluster that loses all its rows goes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.samples import first_n, order

LANDMARKS = 256


@dataclass(frozen=True)
class Kernel:
    """One of rbf, linear, cosine, poly, sigmoid; gamma is one over the number of dimensions where it is not given."""

    name: str
    gamma: float | None = None
    degree: int = 3
    coef0: float = 1.0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gamma = 1 / a.shape[1] if self.gamma is None else self.gamma
        if self.name == "rbf":
            square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
            return np.exp(-gamma * np.maximum(square, 0))
        if self.name == "cosine":
            unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1.0)
            return unit(a) @ unit(b).T
        if self.name == "poly":
            return (gamma * a @ b.T + self.coef0) ** self.degree
        if self.name == "sigmoid":
            return np.tanh(gamma * a @ b.T + self.coef0)
        if self.name == "linear":
            return a @ b.T
        raise ValueError(f"unknown kernel {self.name}")

    def own(self, a: np.ndarray) -> np.ndarray:
        """The kernel of each row with itself."""
        square, gamma = (a * a).sum(axis=1), 1 / a.shape[1] if self.gamma is None else self.gamma
        if self.name == "rbf":
            return np.ones(len(a))
        if self.name == "cosine":
            return (square > 0).astype(float)
        if self.name == "poly":
            return (gamma * square + self.coef0) ** self.degree
        return np.tanh(gamma * square + self.coef0) if self.name == "sigmoid" else square


@dataclass(frozen=True)
class Run:
    kernel: Kernel
    k: int
    seed: int = 1


def starts(runs: list[Run]):
    """An array column with each row's first cluster in each run: the first 32 bits of its place in the seed's order, modulo k."""
    return F.array(*[(F.conv(F.substring(order("exp", r.seed), 1, 8), 16, 10).cast("bigint") % r.k).cast("int") for r in runs])


class Model:
    """Landmarks, and for each run its centres: their weights (k x landmarks) and squared lengths (infinite for a cluster without rows)."""

    def __init__(self, marks: np.ndarray, runs: list[Run]):
        self.marks, self.runs, self.centres = marks, runs, [None] * len(runs)
        self.inverse = {r.kernel: np.linalg.pinv(r.kernel(marks, marks), rcond=1e-10, hermitian=True) for r in runs}

    def columns(self, x: np.ndarray) -> dict:
        return {kernel: kernel(x, self.marks) for kernel in self.inverse}

    def moved(self, sums: list[dict]) -> Model:
        new = Model.__new__(Model)
        new.marks, new.runs, new.inverse, new.centres = self.marks, self.runs, self.inverse, []
        for r, s in zip(self.runs, sums, strict=True):
            mean = s["columns"] / np.maximum(s["n"], 1)[:, None]
            weights = mean @ self.inverse[r.kernel]
            new.centres.append((weights, np.where(s["n"] > 0, (weights * mean).sum(axis=1), np.inf)))
        return new


def _nearest(columns: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The label of each row (the smallest of equals), and its squared distance without its own kernel."""
    d = centres[1] - 2 * columns @ centres[0].T
    label = np.round(d, 9).argmin(axis=1)
    return label, d[np.arange(len(d)), label]


def _vectors(batch) -> np.ndarray:
    return batch.column("f").flatten().to_numpy().reshape(batch.num_rows, -1)


def _pass(rows: DataFrame, now: Model, before: Model | None) -> list[dict]:
    """For each run: n (k), columns (k x landmarks), changed (rows whose label differs from before's), square (the sum of the squared distances'
    squares) and own, as sums over all rows. A model without centres labels the rows by the column `start`."""
    m = len(now.marks)

    def labels(model, i, run, columns, start):
        return (start[:, i], np.zeros(len(start))) if model.centres[i] is None else _nearest(columns[run.kernel], model.centres[i])

    def add(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, out = _vectors(batch), []
            columns = now.columns(x)
            start = batch.column("start").flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, r in enumerate(now.runs):
                label, d = labels(now, i, r, columns, start)
                one = (label[:, None] == np.arange(r.k)).astype(float)
                changed = 0 if before is None else (label != labels(before, i, r, columns, start)[0]).sum()
                out += [one.sum(axis=0), (one.T @ columns[r.kernel]).ravel(), [changed, (d * d).sum(), r.kernel.own(x).sum()]]
            total = np.concatenate(out) if total is None else total + np.concatenate(out)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    got = rows.select("f", "start").mapInArrow(add, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    flat, at, out = np.zeros(len(got)), 0, []
    flat[got["i"].to_numpy()] = got["s"].to_numpy()
    for r in now.runs:
        n, columns, rest = np.split(flat[at : at + r.k * (m + 1) + 3], [r.k, r.k * (m + 1)])
        out.append({"n": n, "columns": columns.reshape(r.k, m), "changed": rest[0], "square": rest[1], "own": rest[2]})
        at += r.k * (m + 1) + 3
    return out


def _prepared(rows: DataFrame, model: Model) -> DataFrame:
    return rows.where(F.size("f") == model.marks.shape[1]).withColumn("start", starts(model.runs))


def kernel_means(rows: DataFrame, runs: list[Run], steps: int = 50, tolerance: float = 1e-3, landmarks: int = LANDMARKS, seed: int = 0) -> Model | None:
    """The model after `steps` rounds, or when in no run the share of rows that change their cluster is at least the tolerance; None without rows.
    rows: exp, f (see fuzzy.usable)."""
    marks = [r["f"] for r in first_n(rows.select("exp", "f"), "exp", landmarks, seed).collect()]  # at most `landmarks` rows
    if not marks:
        return None
    before, now = None, Model(np.array([f for f in marks if len(f) == len(marks[0])]), runs)
    ready = _prepared(rows, now)
    for _ in range(steps):
        sums = _pass(ready, now, before)
        if before is not None and all(s["changed"] < tolerance * s["n"].sum() for s in sums):
            break
        before, now = now, now.moved(sums)
    return now


def cohesions(rows: DataFrame, model: Model) -> list[float | None]:
    """For each run: the sum of the squares of the rows' distances to their centres (squared, without their own kernel), over n times the sum of own
    kernels less the sum of the kernel matrix; null where the latter is zero."""
    out = []
    for r, s in zip(model.runs, _pass(_prepared(rows, model), model, None), strict=True):
        every = s["columns"].sum(axis=0)
        total = s["n"].sum() * s["own"] - every @ model.inverse[r.kernel] @ every
        out.append(float(s["square"] / total) if total != 0 else None)
    return out


def belonging(rows: DataFrame, model: Model) -> DataFrame:
    """exp, run (its place in the model's runs), label, d (the squared distance in the kernel's space) of each row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            columns = model.columns(x)
            for i, r in enumerate(model.runs):
                label, d = _nearest(columns[r.kernel], model.centres[i])
                yield pa.RecordBatch.from_arrays([batch.column("exp"), pa.array(np.full(len(x), i, np.int32)), pa.array(label.astype(np.int32)), pa.array(d + r.kernel.own(x))], ["exp", "run", "label", "d"])

    return rows.where(F.size("f") == model.marks.shape[1]).select("exp", "f").mapInArrow(run, f"exp {dict(rows.dtypes)['exp']}, run int, label int, d double")
