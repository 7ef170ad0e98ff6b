"""Column expressions of the library: no Python workers, whole-stage where Spark can."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def clamp(v: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """v within bounds; null stays null, which least and greatest would not keep."""
    return F.when(v > high, high).when(v < low, low).otherwise(v)


def angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Angle between two vectors; null where one of them is zero."""
    lengths = norm(ux, uy) * norm(vx, vy)
    return F.acos(clamp((ux * vx + uy * vy) / F.when(lengths > 0, lengths)))


def entropy(p: Column) -> Column:
    """Of an array of shares, divided by the logarithm of its size: 1 for a uniform one."""
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    return total / F.when(F.size(p) > 1, F.ln(F.size(p)))


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def total_variation(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hellinger(a: Column, b: Column) -> Column:
    return F.sqrt(sum_of(F.zip_with(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))) / 2)


def kullback_leibler(a: Column, b: Column, smoothing: float = 1e-5) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: (x + smoothing) * F.ln((x + smoothing) / (y + smoothing))))


def cumulative(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: sum_of(F.slice(a, F.lit(1), i)))


def emd_1d(a: Column, b: Column) -> Column:
    """Transport cost of two histograms for the cost |i - j|: the sum of absolute differences of the cumulative shares."""
    return sum_of(F.zip_with(cumulative(a), cumulative(b), lambda x, y: F.abs(x - y)))


def rbf(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-sigma * sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def sigmoid(x: Column, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * x))


def kolmogorov_sf(z: Column, terms: int = 20) -> Column:
    """Survival of the Kolmogorov distribution, 1 below 0.2 where the series is not needed."""
    series = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * z * z) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function from 10 on, by Stirling's series (error under 1e-12)."""
    r = 1 / (x * x)
    return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def chi2_sf_even(x: Column, m: Column) -> Column:
    """Survival of chi-square with 2m degrees of freedom, for any m: the Poisson terms e^-h h^i / i! (h = x / 2) with i < m, as logarithms. Terms
    further than 40 standard deviations from the largest are nothing."""
    h, m = x / 2, m.cast("double")
    reach = 40 * F.sqrt(h) + 40
    low = F.floor(F.least(h, m - 1) - reach)
    low = F.when(low < 10, 0).otherwise(low).cast("int")
    high = F.least(m - 1, F.ceil(h + reach)).cast("int")
    start = F.when(low < 10, -h).otherwise(low * F.ln(h) - ln_gamma(low + 1.0) - h)
    add = lambda acc, i: F.struct((acc["s"] + F.exp(acc["t"])).alias("s"), (acc["t"] + F.ln(h) - F.ln(i + 1.0)).alias("t"))
    total = F.aggregate(F.sequence(low, high), F.struct(F.lit(0.0).alias("s"), start.alias("t")), add, lambda acc: acc["s"])
    return F.when(h <= 0, 1.0).otherwise(F.least(F.lit(1.0), total))


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution: the rational approximation 26.2.17 of Abramowitz and Stegun (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


NORMAL_SF_SQL = "case when {z} >= 0 then {tail} else 1 - {tail} end"


def normal_sf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return NORMAL_SF_SQL.format(z=z, tail=tail)


def kolmogorov_sf_sql(z: str, terms: int = 20) -> str:
    series = " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp(-{2.0 * k * k} * {z} * {z})" for k in range(1, terms + 1))
    return f"case when {z} < 0.2 then 1.0 else greatest(0.0, least(1.0, {series})) end"
