"""Plate layout: neighbourhoods on a grid of 32 rows of 12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.model import HEIGHT, WIDTH


def neighbours(positions: DataFrame, position: str = "position") -> DataFrame:
    """position, neighbour: the up to eight neighbours of each distinct position. Arithmetic on the grid: no join."""
    row, col = F.floor((F.col(position) - 1) / WIDTH), (F.col(position) - 1) % WIDTH
    around = F.array(*[F.struct((row + dr).alias("r"), (col + dc).alias("c")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)])
    inside = F.filter(around, lambda p: (p["r"] >= 0) & (p["r"] < HEIGHT) & (p["c"] >= 0) & (p["c"] < WIDTH))
    rows = positions.select(position).distinct().select(F.col(position), F.explode(inside).alias("p"))
    return rows.select(F.col(position), (F.col("p.r") * WIDTH + F.col("p.c") + 1).alias("neighbour"))


def isolated(hits: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """keys, position, has_neighbour: whether another hit of the same keys lies next to it."""
    around = hits.select(*keys, position).distinct()
    near = around.join(neighbours(around, position), position).select(*keys, F.col("neighbour").alias(position)).distinct().withColumn("has_neighbour", F.lit(True))
    return around.join(near, [*keys, position], "left").withColumn("has_neighbour", F.coalesce("has_neighbour", F.lit(False)))
