"""Streaming forms of the batch queries: windows with watermarks, and online track state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 day", plates: int = 5) -> DataFrame:
    """plate, start, n, total of each window; rows later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy((F.col("user_id") % plates).alias("plate"), F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select("plate", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n of each run of events with no longer gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def path_lengths(points: DataFrame) -> DataFrame:
    """track_id, n, length after each micro-batch: the state of a track is its last point and what it has run so far."""
    import pandas as pd

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, length, x, y = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("frame")
        for px, py in zip(rows.x, rows.y, strict=True):
            length += ((px - x) ** 2 + (py - y) ** 2) ** 0.5 if n else 0.0
            n, x, y = n + 1, float(px), float(py)
        state.update((n, float(length), x, y))
        yield pd.DataFrame({"track_id": [key[0]], "n": [n], "length": [round(float(length), 6)]})

    return points.groupBy("track_id").applyInPandasWithState(update, "track_id bigint, n bigint, length double", "n bigint, length double, x double, y double", "update", "NoTimeout")
