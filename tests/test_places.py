"""Queries on pairs of objects, where places hold many objects: copies of sf0.001 with shifted keys, against the queries' SQL and in their shuffles."""

from __future__ import annotations

import duckdb
import pytest

from platewise.jobs import inference
from __spark_entry__ import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
EVENTS = "/root/testdata/sf0.001/events.parquet"
SHARED = [
    "N33_against_other_tracker",
    "N11_frame_pairs",
    "E04_highest_density",
    "N09_incidence",
    "N04_attached_markers",
    "N03_in_and_out_codes",
    "N02_candidates_with_truth",
    "N21_joint_features",
    "N27_predicted_by_batch",
    "N28_link_accuracy",
    "N29_event_types",
    "N06_move_hypotheses",
    "A25_scaled_candidates",
    "D18_nearest_in_other_segmentation",
    "N05_link_distances",
]


def copied(folder, copies, moved=False):
    """events several times over, with other keys: the places are the same, but for every third object of the last copy where some have moved."""
    value = f"case when i = {copies - 1} and event_id % 3 = 0 then value + 0.25 else value end" if moved else "value"
    con = duckdb.connect()
    con.execute(f"copy (select t.* replace (event_id + i * 1000 as event_id, user_id + i * 100 as user_id, {value} as value) from range({copies}) r(i), '{EVENTS}' t) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    new = tmp_path_factory.mktemp
    return copied(new("mixed"), 4, moved=True), copied(new("few"), 8), copied(new("many"), 64)


def rows(relation):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in relation)


def agrees(spark, name, folder):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(map(tuple, got.collect())) == rows(tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall())


def shuffled(spark, name, folder):
    """Records that the query's stages write to shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    none = sc._gateway.new_array(jvm.double, 0)

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for stage, n in total().items() if stage not in before)


@pytest.mark.parametrize("name", SHARED)
def test_objects_in_one_place(spark, folders, name):
    agrees(spark, name, folders[0])


@pytest.mark.parametrize("name", ["N05_link_distances", "D18_nearest_in_other_segmentation"])
def test_pairs_are_in_no_shuffle(spark, folders, name):
    few, many = (shuffled(spark, name, f) for f in folders[1:])
    assert many < 10 * few  # eight times the objects, 64 times the pairs


@pytest.mark.parametrize("reach", [(50,), (200, 900)])
def test_best_hypotheses_by_rounds_of_reach(spark, folders, monkeypatch, reach):
    monkeypatch.setattr(inference, "REACH", reach)
    agrees(spark, "N12_scored_hypotheses", folders[0])


@pytest.mark.parametrize("name", ["N08_hypothesis_features", "N01_doublets"])
def test_pairs_of_objects_share_what_places_have(spark, folders, name):
    """Differences are rounded for two places, under the generators of pairs, and not for each pair of their objects."""
    plan = QUERIES[name](spark, folders[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "round(" not in plan[: plan.index("Generate")]
    agrees(spark, name, folders[0])
