"""Generators: random walks from seeds, the same whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Walks of a task.
WALKS = 8192


def walks(tracks: DataFrame, frames: int, seed: int) -> DataFrame:
    """track_id, frame, x, y of a walk for each row (track_id, scale): each track has a generator of its own, from seed and track_id. Tracks are
    dealt out by their number, as the size of their files says nothing of the frames to come."""

    def run(batches):
        for batch in batches:
            ids, scale = (batch.column(c).to_numpy() for c in ("track_id", "scale"))
            angle, radius = np.empty((len(ids), frames)), np.empty((len(ids), frames))
            for i, track in enumerate(ids):
                rng = np.random.default_rng([seed, int(track)])
                angle[i], radius[i] = rng.uniform(0, 2 * np.pi, frames), rng.gamma(2.0, 2.0, frames)
            radius *= scale[:, None]
            x, y = (np.cumsum(radius * f(angle), axis=1).round(6).ravel() for f in (np.cos, np.sin))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, frames)), pa.array(np.tile(np.arange(frames, dtype=np.int32), len(ids))), pa.array(x), pa.array(y)], ["track_id", "frame", "x", "y"])

    tasks = max(1, -(-tracks.count() // WALKS))
    return tracks.select("track_id", "scale").repartition(tasks, "track_id").mapInArrow(run, "track_id bigint, frame int, x double, y double")


def switched(points: DataFrame, dwell: tuple[int, ...], phase: str) -> DataFrame:
    """Adds state: a machine that stays dwell[i] frames in state i and begins again after the last; phase is a column with its start."""
    at, state, left = F.pmod(F.col("frame") + F.col(phase), F.lit(sum(dwell))), F.lit(len(dwell) - 1), sum(dwell)
    for i in range(len(dwell) - 1, -1, -1):
        state = F.when(at < left, i).otherwise(state)
        left -= dwell[i]
    return points.withColumn("state", state)
