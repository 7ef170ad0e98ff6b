"""Cleaning, predicates and per-frame aggregates of object tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.operators.statistics import same_keys


def without_frames(objects: DataFrame, skipped: DataFrame) -> DataFrame:
    """Drops the skipped frames and renumbers the later ones. The renumbering is computed on the distinct frames, not on the objects."""
    frames = objects.select("frame").distinct().join(skipped.withColumn("gone", F.lit(1)), "frame", "left")
    moved = frames.withColumn("to", F.col("frame") - F.sum(F.coalesce("gone", F.lit(0))).over(W.orderBy("frame").rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    kept = moved.where("gone is null").select("frame", "to")
    return objects.join(kept, "frame").withColumn("frame", F.col("to")).drop("to")


def union_right_wins(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null keys are keys like any other."""
    return right.unionByName(same_keys(left, right.select(*keys).distinct(), keys, "left_anti"))


def class_shares(objects: DataFrame, keys: list[str], classes: tuple[str, ...], cls: str = "cls") -> DataFrame:
    """Share of each listed class among all objects of keys."""
    return objects.groupBy(*keys).agg(*[F.round(F.count_if(F.col(cls) == c) / F.count("*"), 6).alias(c) for c in classes])


def molar(dose: Column) -> Column:
    """A dose such as `12,5 uM` in mol/l; 0 where the unit is none of uM, nM and pM."""
    unit = F.regexp_extract(dose, "([a-zA-Z]+)$", 1)
    number = F.replace(F.regexp_extract(dose, "^([0-9,]+)", 1), F.lit(","), F.lit(".")).cast("double")
    return number * F.when(unit == "uM", 1e-6).when(unit == "nM", 1e-9).when(unit == "pM", 1e-12).otherwise(0.0)


def long_features(features: DataFrame, keep: list[str]) -> DataFrame:
    """keep, i, v: one row for each element of f."""
    return features.select(*keep, F.posexplode("f").alias("i", "v"))


def z_scores(rows: DataFrame, keys: list[str], value: str, reference: Column) -> DataFrame:
    """Adds z by the mean and population deviation of the reference rows of keys."""
    stats = rows.where(reference).groupBy(*keys).agg(F.avg(value).alias("m "), F.stddev_pop(value).alias("s "))
    return same_keys(rows, stats, keys).withColumn("z", (F.col(value) - F.col("m ")) / F.when(F.col("s ") > 0, F.col("s "))).drop("m ", "s ")


def count_qc(objects: DataFrame, blurred: str, least_count: float, most_blurred: float, frames: int = 10) -> DataFrame:
    """plate, initial (mean count of the first frames), blurred (mean share in the last frames), failed."""
    c = objects.groupBy("plate", "frame").agg(F.count("*").alias("n"), (F.count_if(F.col("cls") == blurred) / F.count("*")).alias("share"))
    ends = W.partitionBy("plate")
    c = c.withColumns({"first": F.min("frame").over(ends), "last": F.max("frame").over(ends)})
    rows = c.groupBy("plate").agg(F.avg(F.when(F.col("frame") < F.col("first") + frames, F.col("n"))).alias("initial"), F.avg(F.when(F.col("frame") > F.col("last") - frames, F.col("share"))).alias("blurred"))
    return rows.withColumn("failed", (F.col("initial") < least_count) | (F.col("blurred") > most_blurred))
