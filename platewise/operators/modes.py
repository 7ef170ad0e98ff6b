"""The dip statistic: how far a distribution is from every distribution with one mode.

It is half the largest gap that is left when an interval around the mode is narrowed: the greatest convex minorant of the distribution function is
held from the left and the least concave majorant from the right, both over the interval alone; the interval shrinks to where they are furthest
apart, as long as that is more than what they miss outside it. Values are counted first, so that repeated ones are one row. A key whose different
values fit one range is one task's work. A larger one is narrowed by rounds: each range makes its own hulls, hulls of neighbours are merged FAN at a
time, and the ranges then measure their values against the stretch of hull above them. No task sees more than a range, or FAN hulls.

A hull of n random values has about n^(1/3) corners. One with more than MOST_CORNERS is thinned, and `thinned` says how far that moved it; it is zero
wherever the statistic is exact. Null, NaN and infinite values are left out; null keys are a group like any other. One value, however often, has no dip.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators import statistics as S
from platewise.sources import stored

MOST_CORNERS, FAN = 1 << 16, 16
#: Gaps that differ by less are equal.
SAME = 1e-15


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the corners of the greatest convex minorant of points in the order of x."""
    px, py, keep = x.tolist(), y.tolist(), []
    for i, (a, b) in enumerate(zip(px, py, strict=True)):
        while len(keep) > 1:
            p, q = keep[-2], keep[-1]
            if (py[q] - py[p]) * (a - px[p]) < (b - py[p]) * (px[q] - px[p]):
                break
            keep.pop()
        keep.append(i)
    return np.array(keep, dtype=int)


def thinned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Places of at most MOST_CORNERS corners, and how far the others lie from the chords between them."""
    keep = np.arange(len(x))
    while len(keep) > MOST_CORNERS:
        keep = np.union1d(keep[::2], keep[-1:])
    return keep, float(np.abs(np.interp(x, x[keep], y[keep]) - y).max())


def narrowed(gx, gy, lx, ly) -> tuple[float, float, float]:
    """The largest distance between minorant (g) and majorant (l), and the interval between their corners there."""
    at_g, at_l = np.interp(gx, lx, ly) - gy, ly - np.interp(lx, gx, gy)
    i, j = at_g.argmax(), at_l.argmax()
    if at_g[i] >= at_l[j]:
        return float(at_g[i]), float(gx[i]), float(lx[np.searchsorted(lx, gx[i])])
    return float(at_l[j]), float(gx[np.searchsorted(gx, lx[j], "right") - 1]), float(lx[j])


def missed(x, before, after, g, l, low: float, high: float) -> float:  # noqa: E741
    """How far the values under low lie above the minorant, or those over high below the majorant (g and l: corners' x and y)."""
    left, right = x < low, x > high
    return float(max([0.0, *(after[left] - np.interp(x[left], *g)), *(np.interp(x[right], *l) - before[right])]))


def dip_of(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> float:
    """The dip of values in order; before and after: the share of all rows under each, and up to each."""
    low, high, gap = x[0], x[-1], 0.0
    while True:
        inside = (x >= low) & (x <= high)
        v, b, a = x[inside], before[inside], after[inside]
        i, j = lower_hull(v, b), lower_hull(v, -a)
        height, to_low, to_high = narrowed(v[i], b[i], v[j], a[j])
        if height <= gap + SAME:
            return gap / 2
        gap = max(gap, missed(v, b, a, (v[i], b[i]), (v[j], a[j]), to_low, to_high))
        if (to_low, to_high) == (low, high):
            return gap / 2
        low, high = to_low, to_high


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v")
    return pd.DataFrame({"key": [pdf.key.iloc[0]], "dip": [dip_of(*(pdf[c].to_numpy() for c in ("v", "before", "after")))], "thinned": [0.0]})


CORNERS = "key string, side string, block bigint, x double, y double, at int, off double"


def _corners(pdf: pd.DataFrame) -> pd.DataFrame:
    """The corners of a range, the majorant's upside down."""
    pdf = pdf.sort_values("v")
    v, at = pdf.v.to_numpy(), pdf.range.to_numpy()
    g, l = pdf.before.to_numpy(), -pdf.after.to_numpy()  # noqa: E741
    i, j = lower_hull(v, g), lower_hull(v, l)
    out = {"x": np.r_[v[i], v[j]], "y": np.r_[g[i], l[j]], "at": np.r_[at[i], at[j]]}
    return pd.DataFrame({"key": pdf.key.iloc[0], "side": ["g"] * len(i) + ["l"] * len(j), "block": int(at[0]) // FAN} | out | {"off": 0.0})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x", ignore_index=True)
    corner = lower_hull(pdf.x.to_numpy(), pdf.y.to_numpy())
    keep, off = thinned(pdf.x.to_numpy()[corner], pdf.y.to_numpy()[corner])
    of = {c: pdf[c].to_numpy()[corner][keep] for c in ("x", "y", "at")}
    return pd.DataFrame({"key": pdf.key.iloc[0], "side": pdf.side.iloc[0], "block": int(pdf.block.iloc[0]) // FAN} | of | {"off": pdf.off.max() + off})


def _narrowed(pdf: pd.DataFrame) -> pd.DataFrame:
    g, l = (pdf[pdf.side == s].sort_values("x") for s in "gl")  # noqa: E741
    height, low, high = narrowed(g.x.to_numpy(), g.y.to_numpy(), l.x.to_numpy(), -l.y.to_numpy())
    return pd.DataFrame({"key": [pdf.key.iloc[0]], "height": [height], "to_low": [low], "to_high": [high], "off": [pdf.off.max()]})


def _missed(values: pd.DataFrame, chords: pd.DataFrame) -> pd.DataFrame:
    if not len(values):
        return pd.DataFrame({"key": [chords.key.iloc[0]], "missed": [0.0]})
    line = {}
    for side in "gl":
        ends = chords[chords.side == side]
        x, first = np.unique(np.concatenate([ends.x, ends.to_x]), return_index=True)
        line[side] = (x, np.concatenate([ends.y, ends.to_y])[first] * (1 if side == "g" else -1))
    most = missed(*(values[c].to_numpy() for c in ("v", "before", "after")), line["g"], line["l"], values.to_low.iloc[0], values.to_high.iloc[0])
    return pd.DataFrame({"key": [values.key.iloc[0]], "missed": [most]})


def _round(values: DataFrame, state: DataFrame) -> DataFrame:
    """state (key, low, high, gap, off, live) after its intervals are narrowed once."""
    live = state.where("live").select("key", "low", "high")
    inside = values.join(live, "key").where("v between low and high").drop("low", "high")
    corners = inside.groupBy("key", "range").applyInPandas(_corners, CORNERS)
    blocks = 1 + (values.agg(F.max("range")).first()[0] or 0)  # one number
    while True:
        corners, blocks = corners.groupBy("key", "side", "block").applyInPandas(_merged, CORNERS), -(-blocks // FAN)
        if blocks <= 1:
            break
    corners = stored(corners, "corners")
    found = stored(corners.groupBy("key").applyInPandas(_narrowed, "key string, height double, to_low double, to_high double, off double"), "narrowed")
    # a chord is sent to each range that it spans; the last corner is a chord without length
    ends = F.sort_array(F.collect_list(F.struct("x", "y", "at")))  # at most MOST_CORNERS
    chords = corners.groupBy("key", "side").agg(ends.alias("p")).select("key", "side", F.explode(F.transform("p", lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get("p", i + 1), p).alias("b")))).alias("c"))
    chords = chords.select("key", "side", *[F.col(f"c.a.{x}").alias(x) for x in "xy"], *[F.col(f"c.b.{x}").alias(f"to_{x}") for x in "xy"], F.explode(F.sequence("c.a.at", "c.b.at")).alias("range"))
    measured = inside.join(found.select("key", "to_low", "to_high"), "key").groupBy("key", "range").cogroup(chords.groupBy("key", "range")).applyInPandas(_missed, "key string, missed double")
    both = state.where("live").drop("off", "live").join(found, "key").join(measured.groupBy("key").agg(F.max("missed").alias("missed")), "key", "left")
    done = F.col("height") <= F.col("gap") + SAME
    moved = (F.col("to_low") != F.col("low")) | (F.col("to_high") != F.col("high"))
    new = both.select("key", F.col("to_low").alias("low"), F.col("to_high").alias("high"), F.when(done, F.col("gap")).otherwise(F.greatest("gap", F.coalesce("missed", F.lit(0.0)))).alias("gap"), "off", (~done & moved).alias("live"))
    return stored(new.unionByName(state.where("not live")), "intervals")


def dip(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n (values), dip, thinned. Keys without a usable value are left out."""
    v = F.col(value).cast("double")
    of = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    usable = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # zeros of both signs are one value
    counts = usable.select(of.alias("of"), (v + F.lit(0.0)).alias("v")).groupBy("of", "v").agg(F.count("*").alias("n")).withColumn("key", F.to_json("of", {"ignoreNullFields": "false"}))
    ranked = stored(S._running(counts, ["key"], "v", ["n"]), "ranked")
    sizes = ranked.groupBy("key").agg(F.first("of").alias("of"), F.max("all_n").alias("all_n"), F.count("*").alias("values"))
    share = lambda c: (c.cast("double") / F.col("all_n"))
    values = ranked.select("key", "v", "range", share(F.col("before_n")).alias("before"), share(F.col("before_n") + F.col("n")).alias("after"))
    sizes = stored(sizes, "sizes")
    pick = lambda on: values.join(sizes.where(on).select("key"), "key")
    parts = [pick(F.col("values") <= S.RANGE_ROWS).groupBy("key").applyInPandas(_whole, "key string, dip double, thinned double")]
    large = F.col("values") > S.RANGE_ROWS
    if sizes.where(large).head(1):
        of_large = stored(pick(large), "large")
        state = of_large.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("*", F.lit(0.0).alias("gap"), F.lit(0.0).alias("off"), F.lit(True).alias("live"))
        while state.where("live").head(1):
            state = _round(of_large, state)
        parts.append(state.select("key", (F.col("gap") / 2).alias("dip"), F.col("off").alias("thinned")))
    got = reduce(DataFrame.union, parts).join(sizes, "key")
    return got.select(*[F.col("of").getField(k).alias(k) for k in keys], F.col("all_n").alias("n"), "dip", "thinned")
