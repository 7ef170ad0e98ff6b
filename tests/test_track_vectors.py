"""Feature vectors of tracks: each track is made once, and tracks that never move, or have points without a place, keep their row."""

import math

import numpy as np

from __spark_entry__ import queries
from platewise.operators import tracks

POINTS = "plate bigint, track_id bigint, frame int, x double, y double"


def test_a_track_that_never_moves_keeps_its_row(spark):
    rows = [(0, t, i, float(i * t), 1.0) for t in (0, 1) for i in range(12)]
    got = {r["track_id"]: r for r in tracks.trajectory_vectors(spark.createDataFrame(rows, POINTS)).collect()}
    assert set(got) == {0, 1} and got[0]["movement_type"] is None and got[0]["total_length"] == 0 and got[0]["balls1"] == 1 / math.sqrt(12) and abs(got[1]["movement_type"] - 1) < 1e-9


def test_points_without_a_place_are_in_no_ball():
    x, nan = np.array([0.0, 0.5, np.nan, 0.5, 9.0]), float("nan")
    assert tracks.ball_cover(x, np.zeros(5), 1.0)[0] == 3 and tracks.ball_cover(np.array([nan, 7.0]), np.zeros(2), 1.0)[0] == 1


def test_single_balls_end_the_cover():
    x = np.array([0, 1, 2, 50, 100, 150.0])
    n, entropy = tracks.ball_cover(x, np.zeros(6), 1.0)
    p = np.array([3, 1, 1, 1]) / 6
    assert n == 4 and abs(entropy + (p * np.log(p)).sum() / np.log(6)) < 1e-12


def test_vectors_of_steps_need_no_python_and_one_shuffle_of_points(spark):
    plan = queries()["F03_trajectory_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "FlatMapGroups" not in plan
    shape = queries()["F03_shape_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in shape and shape.count("ArrowEvalPython") == 1
