"""Simulated walks: the same for a track in any table, and dealt out by the number of tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from platewise.operators import simulate


def test_walks_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(simulate, "WALKS", 8, raising=False)
    tracks = spark.range(40, numPartitions=1).select(F.col("id").alias("track_id"), F.lit(2.0).alias("scale"))
    got = simulate.walks(tracks, 30, seed=17)
    assert got.rdd.getNumPartitions() == 5
    rows = {(r["track_id"], r["frame"]): (r["x"], r["y"]) for r in got.collect()}
    for track in range(40):
        rng = np.random.default_rng([17, track])
        angle, radius = rng.uniform(0, 2 * np.pi, 30), 2.0 * rng.gamma(2.0, 2.0, 30)
        want = np.cumsum(radius * np.cos(angle)), np.cumsum(radius * np.sin(angle))
        assert all(np.allclose(rows[track, i], (want[0][i], want[1][i]), rtol=0, atol=1.1e-6) for i in range(30))
    assert len(rows) == 1200


def test_walks_of_no_track(spark):
    assert simulate.walks(spark.range(0).select(F.col("id").alias("track_id"), F.lit(1.0).alias("scale")), 30, seed=17).count() == 0
