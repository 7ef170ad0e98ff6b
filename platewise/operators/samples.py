"""Seeded samples: an order by the MD5 of seed and key, the same in every partitioning and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(key: str | Column, seed: int) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def order_sql(key: str, seed: int) -> str:
    return f"md5('{seed}:' || {key}::varchar)"


def first_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in random order; Spark keeps n of each partition and merges them."""
    return rows.orderBy(order(key, seed), key).limit(n)


def first_n_of(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each group in random order."""
    k = F.row_number().over(W.partitionBy(group).orderBy(order(key, seed), key))
    return rows.withColumn("k ", k).where(F.col("k ") <= n).drop("k ")


def thinned_first(rows: DataFrame, group: str, key: str, seed: int, most: Column) -> DataFrame:
    """Rows kept with probability 1/10; of these the first of each group by key, up to most; k is their place."""
    k = F.row_number().over(W.partitionBy(group).orderBy(key))
    return rows.where(order(key, seed) < "1999").withColumn("k", k).where(F.col("k") <= most)
