"""Two-sample tests, empirical p-values, false discovery rates and exact quantiles. What needs an order over all rows is counted by value,
summed by ranges of values, and cumulated in each range (small groups in one piece): no task sees all rows, and no pool of controls is repeated for its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.expressions import kolmogorov_sf, normal_sf
from platewise.sources import stored

#: Values of a range, each a task's work: more values are more ranges.
RANGE_ROWS = 1 << 16


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, a null key being equal to a null key; the keys are kept once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.select(*[F.col(k).alias(f"{k} right") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"{k} right"))
    return left.join(right, on, how).drop(*[f"{k} right" for k in keys])


def _running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """running(), with the number of each value's range ("range")."""
    counts = stored(counts, "counts")  # counted once: the number of rows, the ranges' bounds, the sums and the rows come from it
    rows, most = counts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    ranges = -(-rows // RANGE_ROWS)
    before = lambda at: F.sum(at).over(inside)
    if most <= RANGE_ROWS:  # no group is more than a task's work: many small ones would be in as many pieces as they have values
        inside, every = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
        return counts.withColumns({f"before_{x}": F.coalesce(before(x), F.lit(0)) for x in sums} | {f"all_{x}": F.sum(x).over(every) for x in sums} | {"range": F.lit(0)})
    ranged = stored(counts.repartitionByRange(ranges, value).withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "range").agg(*[F.sum(x).alias(f"t_{x}") for x in sums])
    # a row for each range and keys
    earlier, every = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    totals = totals.select(*keys, "range", *[F.coalesce(F.sum(f"t_{x}").over(earlier), F.lit(0)).alias(f"o_{x}") for x in sums], *[F.sum(f"t_{x}").over(every).alias(f"all_{x}") for x in sums])
    inside = W.partitionBy(*keys, "range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    rows = same_keys(ranged, totals, [*keys, "range"])
    return rows.withColumns({f"before_{x}": F.col(f"o_{x}") + F.coalesce(before(x), F.lit(0)) for x in sums}).drop(*[f"o_{x}" for x in sums])


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds before_x, the sum of x over the smaller values within keys, and all_x, the sum within keys, for each x of sums. counts has a
    row for each value and keys; null keys are a group like any other."""
    return _running(counts, keys, value, sums).drop("range")


def quantiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys, and a column for each of qs: the exact quantile, interpolated between the two values around it. A value that repeats is one row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v ")).agg(F.count("*").alias("n "))
    ranked = running(counts, keys, "v ", ["n "])
    at = lambda q: F.lit(q) * (F.col("all_n ") - 1)
    holds = lambda place: (F.col("before_n ") <= place) & (place < F.col("before_n ") + F.col("n "))
    ends = [F.max(F.when(holds(f(at(q))), F.col("v "))).alias(f"{name} {f.__name__}") for name, q in qs.items() for f in (F.floor, F.ceil)]
    found = ranked.groupBy(*keys).agg(*ends, F.max("all_n ").alias("all_n "))
    return found.select(*keys, *[(F.col(f"{n} floor") + (F.col(f"{n} ceil") - F.col(f"{n} floor")) * (at(q) - F.floor(at(q)))).alias(n) for n, q in qs.items()])


def against_pool(rows: DataFrame, pool: DataFrame, keys: list[str], value: str, within: list[str] | None = None) -> DataFrame:
    """keys, v, a (rows of the group with that value), before_a and all_a (of the group: under it, and all), below and t (of the pool: values
    under it, and equal ones), n2 (the pool's size), tie2 (the sum of t^3 - t over the pool's values): the pool is counted and cumulated
    once for all groups; once for each of the columns within (some of keys) where there are any. Groups are cumulated by ranges too."""
    within = within or []
    own = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("a"))
    own = running(own, keys, "v", ["a"])
    pooled = pool.where(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("t"))
    counts = own.select(*within, "v", F.lit(0).alias("t")).distinct().union(pooled).groupBy(*within, "v").agg(F.sum("t").alias("t"))
    cube = F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")
    ranked = running(counts.withColumn("c", cube), within, "v", ["t", "c"])
    return same_keys(own, ranked.select(*within, "v", "t", F.col("before_t").alias("below"), F.col("all_t").alias("n2"), F.col("all_c").alias("tie2")), [*within, "v"])


def kolmogorov_smirnov(both: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n1, n2, d, p of groups against the pool (see against_pool). The largest difference is at a group's value or just before it."""
    n1, n2 = F.col("all_a"), F.col("n2")
    at = F.abs((F.col("before_a") + F.col("a")) / n1 - (F.col("below") + F.col("t")) / n2)
    before = F.abs(F.col("before_a") / n1 - F.col("below") / n2)
    rows = both.where("n2 > 0").groupBy(*keys, n1.alias("n1"), "n2").agg(F.max(F.greatest(at, before)).alias("d"))
    ne = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return rows.withColumn("p", kolmogorov_sf((ne + 0.12 + 0.11 / ne) * F.col("d")))


def kolmogorov_smirnov_pairs(rows: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """keys, i, j, n1, n2, d of every two sides (i < j) of each group that both have. A value is one row of counts, a column for each side (few:
    their names reach the driver), which are cumulated once for all pairs; no row is repeated for the pairs that it is in."""
    v = F.col(value).cast("double")
    counts = stored(rows.where(F.col(side).isNotNull() & v.isNotNull()).groupBy(*keys, v.alias("v"), side).agg(F.count("*").alias("n")), "sides")
    sides = sorted(r[0] for r in counts.select(side).distinct().collect())
    names = [f"n{s}" for s in range(len(sides))]
    pairs = [(a, b) for a in range(len(sides)) for b in range(a + 1, len(sides))]
    if not pairs:
        none = [F.col(side).alias("i"), F.col(side).alias("j"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(0.0).alias("d")]
        return counts.select(*keys, *none).limit(0)
    wide = counts.groupBy(*keys, "v").agg(*[F.coalesce(F.sum(F.when(F.col(side) == s, F.col("n"))), F.lit(0)).alias(n) for s, n in zip(sides, names, strict=True)])
    ranked = running(wide, keys, "v", names)
    upto = lambda n: (F.col(f"before_{n}") + F.col(n)) / F.when(F.col(f"all_{n}") > 0, F.col(f"all_{n}"))
    largest = ranked.groupBy(*keys).agg(*[F.max(f"all_{n}").alias(f"all_{n}") for n in names], *[F.max(F.abs(upto(names[a]) - upto(names[b]))).alias(f"d{a}_{b}") for a, b in pairs])
    of = F.array(*[F.struct(F.lit(sides[a]).alias("i"), F.lit(sides[b]).alias("j"), F.col(f"all_{names[a]}").alias("n1"), F.col(f"all_{names[b]}").alias("n2"), F.col(f"d{a}_{b}").alias("d")) for a, b in pairs])
    return largest.select(*keys, F.explode(of).alias("x")).select(*keys, "x.*").where("n1 > 0 and n2 > 0")


def ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, value, name: the rank of each value within keys, ties at their mean rank."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n "))
    return running(counts, keys, value, ["n "]).select(*keys, value, (F.col("before_n ") + (F.col("n ") + 1) / 2).alias(name))


def mean_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value within keys, ties at their mean rank; rows without a value go."""
    return same_keys(rows.where(F.col(value).isNotNull()), ranks(rows, keys, value, name), [*keys, value])


def rank_sum(both: DataFrame, keys: list[str], ties: bool = False) -> DataFrame:
    """keys, n1, n2, z, p (two-sided) of the rank-sum test of groups against the pool (see against_pool); with ties, with the tie and the
    continuity correction of Mann-Whitney."""
    together = (F.col("a") + F.col("t")).cast("double")
    rank = F.col("before_a") + F.col("below") + (together + 1) / 2
    cube = lambda t: t * t * t - t
    rows = both.select(*keys, "a", "n2", "tie2", rank.alias("r"), (cube(together) - cube(F.col("t").cast("double"))).alias("more"))
    rows = rows.groupBy(*keys, "n2", "tie2").agg(F.sum("a").alias("n1"), F.sum(F.col("a") * F.col("r")).alias("rank_sum"), F.sum("more").alias("more")).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - ((F.col("tie2") + F.col("more")) / (n * (n - 1)) if ties else F.lit(0.0)))
    off = F.col("rank_sum") - n1 * (n + 1) / 2
    off = F.sign(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5) if ties else off
    z = off / F.sqrt(F.when(variance > 0, variance))
    return rows.select(*keys, "n1", "n2", z.alias("z")).withColumn("p", F.least(F.lit(1.0), 2 * normal_sf(F.abs("z"))))


def bh(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Adds Benjamini-Hochberg q-values (null p stays out). Equal p have one q: the smallest p * n / rank at or after them."""
    known = stored(rows.where(F.col(p).isNotNull()), "tested")
    ranked = _running(known.groupBy(F.col(p).alias("p ")).agg(F.count("*").alias("n ")), [], "p ", ["n "])
    ranked = ranked.withColumn("raw ", F.least(F.lit(1.0), F.col("p ") * F.col("all_n ") / (F.col("before_n ") + F.col("n "))))
    least = ranked.groupBy("range").agg(F.min("raw ").alias("least "))
    later = least.select("range", F.min("least ").over(W.orderBy("range").rowsBetween(1, W.unboundedFollowing)).alias("later "))  # a row for each range
    inside = W.partitionBy("range").orderBy("p ").rowsBetween(0, W.unboundedFollowing)
    got = ranked.join(later, "range").select("p ", F.least(F.min("raw ").over(inside), F.col("later ")).alias(q))
    return known.join(got, F.col(p) == F.col("p ")).drop("p ")


def row_numbers(rows: DataFrame, value: str, tie: str, name: str = "row", keys: list[str] | None = None) -> DataFrame:
    """Adds the number of each row in the order of value (without nulls) and tie, from 1, and all_rows, both within keys."""
    keys = keys or []
    ranked = running(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n ")), keys, value, ["n "])
    got = same_keys(rows, ranked.select(*keys, value, "before_n ", F.col("all_n ").alias("all_rows")), [*keys, value])
    return got.withColumn(name, F.col("before_n ") + F.row_number().over(W.partitionBy(*keys, value).orderBy(tie))).drop("before_n ")


def empirical_p(rows: DataFrame, null: DataFrame, value: str, null_value: str, upper: bool = True) -> DataFrame:
    """Adds p: (1 + the null values at least (upper) or at most as extreme) / (1 + n). Both sides are merged and counted by value: no pairs."""
    both = rows.select(F.col(value).cast("double").alias("v "), F.lit(0).alias("k ")).union(null.select(F.col(null_value).cast("double"), F.lit(1))).where(F.col("v ").isNotNull())
    ranked = running(both.groupBy("v ").agg(F.sum("k ").alias("k ")), [], "v ", ["k "])
    extreme = F.col("all_k ") - F.col("before_k ") if upper else F.col("before_k ") + F.col("k ")
    ranked = ranked.select("v ", ((extreme + 1) / (F.col("all_k ") + 1)).alias("p"))
    return rows.join(ranked, F.col(value).cast("double") == F.col("v "), "left").drop("v ")


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, rho: the correlation of mean ranks."""
    whole = stored(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("a "), F.col(b).alias("b ")), "pairs")
    ranked = same_keys(same_keys(whole, ranks(whole, keys, "a ", "rank of a"), [*keys, "a "]), ranks(whole, keys, "b ", "rank of b"), [*keys, "b "])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rank of a", "rank of b").alias("rho"))
