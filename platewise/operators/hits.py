"""Hit calling, replicate rules and rank products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.samples import order
from platewise.operators.statistics import quantiles, row_numbers, running, same_keys
from platewise.sources import stored


def two_level_hits(rows: DataFrame, lower: str, upper: str, hit: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """upper, n_lower, n_hit_lower, hit: a lower level (siRNA) is confirmed with enough hits and share; an upper one (gene) with one confirmed."""
    low = rows.groupBy(upper, lower).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"))
    low = low.withColumn("confirmed", (F.col("h") >= least) & (F.col("h") >= F.col("n") * share))
    return low.groupBy(upper).agg(F.count("*").alias("n_lower"), F.count_if("confirmed").alias("n_hit_lower"), F.max("confirmed").alias("hit"))


def tukey_low(rows: DataFrame, control: DataFrame, value: str, whisker: float = 1.5) -> DataFrame:
    """Adds low: value at most Q1 - whisker * IQR of the control's values."""
    q = quantiles(control, [], value, {"a": 0.25, "b": 0.75}).select((F.col("a") - whisker * (F.col("b") - F.col("a"))).alias("bound "))
    return rows.crossJoin(F.broadcast(q)).withColumn("low", F.col(value) <= F.col("bound ")).drop("bound ")


def rank_product(rows: DataFrame, condition: str, batch: str, value: str, missing: bool = True) -> DataFrame:
    """condition, k, rank_product: the ranks of value in each batch (ties by condition) multiplied over batches; with missing, a condition
    that a batch lacks has that batch's last rank."""
    per = stored(quantiles(rows, [batch, condition], value, {"v": 0.5}), "medians")
    ranked = row_numbers(per, "v", condition, "r", [batch])
    sizes = per.groupBy(batch).agg(F.count("*").alias("n"))
    if missing:
        grid = per.select(condition).distinct().crossJoin(F.broadcast(sizes))
        ranked = same_keys(grid, ranked.select(batch, condition, "r"), [batch, condition], "left").withColumn("r", F.coalesce(F.col("r"), F.col("n")))
    return ranked.groupBy(condition).agg(F.count("*").alias("k"), F.exp(F.sum(F.ln("r")) / F.count("*")).alias("rank_product"))


def extremal_difference(curves: DataFrame, control: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """keys, score: the signed difference from the control's curve where it is largest; earlier points win ties."""
    both = curves.join(control.withColumnRenamed("v", "c "), at).withColumn("d ", F.col("v") - F.col("c "))
    # rounded, so that a tie is a tie whatever the order of the sums
    both = both.withColumn("d ", F.round("d ", 9))
    return both.groupBy(*keys).agg(F.min_by("d ", F.struct(-F.abs("d "), *at)).alias("score"))


def permuted_rank_products(rows: DataFrame, condition: str, batch: str, runs: int, seed: int, missing: bool = False) -> DataFrame:
    """run, condition, rank_product of runs permutations: the conditions of a batch are ranked by a seeded order; with missing, one that a
    batch lacks has that batch's last rank."""
    per = rows.select(batch, condition).distinct().withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    per = stored(per.withColumn("place", order(F.concat_ws(":", "run", batch, condition), seed)), "permuted")
    ranked = row_numbers(per, "place", condition, "r", ["run", batch]).drop("place", "all_rows")
    if missing:
        sizes = per.groupBy("run", batch).agg(F.count("*").alias("n"))
        grid = per.select("run", condition).distinct().join(sizes, "run")
        ranked = same_keys(grid, ranked, ["run", batch, condition], "left").withColumn("r", F.coalesce("r", "n"))
    return ranked.groupBy("run", condition).agg(F.exp(F.sum(F.ln("r")) / F.count("*")).alias("rank_product"))


def rank_product_null(rows: DataFrame, condition: str, batch: str, value: str, runs: int, seed: int) -> DataFrame:
    """condition, rank_product, false_positives: how many null rank products in a run, on average, are as small. Real and null products are
    merged, counted by value and cumulated."""
    real = rank_product(rows, condition, batch, value, missing=False).select(condition, F.round("rank_product", 9).alias("rank_product"))
    null = permuted_rank_products(rows, condition, batch, runs, seed)
    both = real.select(F.col("rank_product").alias("v"), F.lit(0).alias("k")).union(null.select(F.round("rank_product", 9), F.lit(1))).groupBy("v").agg(F.sum("k").alias("k"))
    upto = running(both, [], "v", ["k"]).select("v", (F.col("before_k") + F.col("k")).alias("c"))
    return real.join(upto, F.col("rank_product") == F.col("v")).select(condition, "rank_product", (F.col("c") / runs).alias("false_positives"))
