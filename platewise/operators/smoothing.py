"""Curves: local regression and two-segment paths. One curve meets in one task; its length is that of a movie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lowess(y: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Tricube-weighted local line through the nearest share of points, at every point of an evenly spaced curve."""
    n = len(y)
    k = min(n, max(2, int(np.ceil(share * n))))
    x, out = np.arange(n, dtype=float), np.empty(n)
    for i in range(n):
        d = np.abs(x - i)
        h = max(np.partition(d, k - 1)[k - 1], 1e-9) * (1 + 1e-9)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        sw, mx, my = w.sum(), (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        vx = (w * (x - mx) ** 2).sum() / sw
        slope = ((w * (x - mx) * (y - my)).sum() / sw) / vx if vx > 1e-12 else 0.0
        out[i] = my + slope * (i - mx)
    return out


def smoothed(curves: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """keys, frame, v, smooth for curves (keys, frame, v)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pdf.assign(smooth=lowess(pdf.v.to_numpy(float), share).round(6))

    rows = curves.select(*keys, "frame", "v")
    return rows.groupBy(*keys).applyInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", smooth double")


def two_segments(points: np.ndarray) -> tuple[int, float]:
    """The middle index of the best polyline first - middle - last, and its sum of squared distances to the nearer of both segments' lines in turn."""

    def residual(p: np.ndarray) -> float:
        a, b = p[0], p[-1]
        d = b - a
        norm = float(d @ d)
        off = p - a
        along = np.outer(off @ d / norm, d) if norm > 0 else np.zeros_like(off)
        return float(((off - along) ** 2).sum())

    best = min(((residual(points[: m + 1]) + residual(points[m:]), m) for m in range(1, len(points) - 1)), default=(0.0, 0))
    return best[1], best[0]


def two_segment_paths(rows: DataFrame, key: str) -> DataFrame:
    """key, middle, residual for paths (key, frame, p array<double>)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        middle, residual = two_segments(np.stack(pdf.p.to_numpy()))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "middle": [middle], "residual": [round(residual, 6)]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "frame", "p").groupBy(key).applyInPandas(run, f"{key} {kind}, middle bigint, residual double")


def local_fits(curves: DataFrame, keys: list[str], share: str | float, degree: str | int, held_out: bool = False) -> DataFrame:
    """keys, frame, v, fit: local polynomials of degree 0 or 1 with tricube weights over the nearest share of the points; share and degree are
    numbers or columns, so that a grid of them is one more key. held_out: a point is left out of its own fit. Points meet within their
    curve alone, which a movie's length bounds."""
    share, degree = (F.col(p) if isinstance(p, str) else F.lit(p) for p in (share, degree))
    one = curves.select(*keys, "frame", "v", share.alias("share "), degree.alias("degree "))
    other = curves.select(*keys, F.col("frame").alias("x "), F.col("v").alias("y "))
    pairs = one.join(other, keys).withColumn("d ", F.abs(F.col("x ") - F.col("frame")))
    pairs = pairs.where(F.col("d ") > 0) if held_out else pairs
    at = W.partitionBy(*keys, "frame")
    pairs = pairs.withColumns({"k ": F.row_number().over(at.orderBy("d ", "x ")), "n ": F.count("*").over(at)})
    pairs = pairs.where(F.col("k ") <= F.greatest(F.lit(3), F.ceil(F.col("share ") * F.col("n "))))
    reach = F.max("d ").over(at) * 1.001 + 1e-9
    pairs = pairs.withColumn("w ", F.pow(1 - F.pow(F.col("d ") / reach, F.lit(3.0)), F.lit(3.0))).withColumn("u ", F.col("x ") - F.col("frame"))
    w, u, y = F.col("w "), F.col("u "), F.col("y ")
    sums = pairs.groupBy(*keys, "frame", "v", "degree ").agg(F.sum(w).alias("s0"), F.sum(w * u).alias("s1"), F.sum(w * u * u).alias("s2"), F.sum(w * y).alias("t0"), F.sum(w * u * y).alias("t1"))
    spread = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.when(spread > 1e-9, spread)
    return sums.select(*keys, "frame", "v", F.coalesce(F.when(F.col("degree ") == 1, line), F.col("t0") / F.col("s0")).alias("fit"))


def local_fits_sql(curves: str, keys: str, share: str, degree: str, held_out: bool = False) -> str:
    """The same, as a select from a relation (keys, frame, v, and the columns that share and degree name)."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""select {keys}, frame, v, coalesce(case when degree_ = 1 then (s2 * t0 - s1 * t1) / (case when s0 * s2 - s1 * s1 > 1e-9 then s0 * s2 - s1 * s1 end) end, t0 / s0) as fit from (
select {keys}, frame, v, degree_, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * y) as t0, sum(w * u * y) as t1 from (
select *, pow(1 - pow(d / (max(d) over (partition by {keys}, frame) * 1.001 + 1e-9), 3), 3) as w, x - frame as u from (
select {a}, a.frame, a.v, a.{share} as share_, a.{degree} as degree_, b.frame as x, b.v as y, abs(b.frame - a.frame) as d, row_number() over (partition by {a}, a.frame order by abs(b.frame - a.frame), b.frame) as k, count(*) over (partition by {a}, a.frame) as n from {curves} a join {curves} b on {on} {'where a.frame <> b.frame' if held_out else ''})
where k <= greatest(3, ceil(share_ * n))) group by all)"""
