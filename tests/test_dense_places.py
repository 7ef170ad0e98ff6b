"""Queries on pairs of objects that lie in places of their own, the denser the more of them there are: against the queries' SQL, and what they meet."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest

from platewise.jobs import inference
from platewise.operators import assignment as A
from __spark_entry__ import queries
from tests.test_places import agrees

QUERIES = queries()
EVENTS = "/root/testdata/sf0.001/events.parquet"


def crowded(folder, copies, frames=30):
    """events several times over, with other keys and places of their own, in the first of the frames; labels rise with the time."""
    con = duckdb.connect()
    rows = f"""select i, event_id as e, ts - to_days((datediff('day', date '2024-01-01', ts::date) // {frames} * {frames})::int) as ts, user_id + i * 100 as user_id, event_type,
        hash(event_id * 64 + i) % 100003 as u, hash(event_id * 64 + i) // 100003 % 97 as v from range({copies}) r(i), '{EVENTS}'"""
    con.execute(
        f"""copy (select row_number() over (order by ts, e, i) as event_id, ts, user_id, event_type, round(-30 * ln(1 - u / 100004), 2) as value, '{{"k": ' || v || '}}' as props
        from ({rows})) to '{folder}/events.parquet' (format parquet)"""
    )
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    new = tmp_path_factory.mktemp
    return crowded(new("few"), 8, 3), crowded(new("many"), 64, 3), crowded(new("all"), 6, 10)


def met(monkeypatch, spark, name, folder):
    """The pairs that the query's radius joins meet."""
    pairs, meeting = [], A.meeting

    def counted(*args, **kwargs):
        rows = meeting(*args, **kwargs)
        pairs.append(rows.count())
        return rows

    with monkeypatch.context() as m:
        m.setattr(A, "meeting", counted)
        QUERIES[name](spark, folder).collect()
    return sum(pairs)


SEARCHES = ["N05_link_distances", "N13_mutual_links", "N03_in_and_out_codes", "N06_move_hypotheses", "D18_nearest_in_other_segmentation", "N04_attached_markers", "N13_event_hypotheses", "O04_density"]


@pytest.mark.parametrize("name", [*SEARCHES, "N02_candidates_with_truth", "N10_truth_vector", "N14_relaxation_bound", "N22_augmented_scores"])
def test_nearest_of_many(spark, folders, monkeypatch, name):
    monkeypatch.setattr(A, "CROWD", 2)
    agrees(spark, name, folders[2])


@pytest.mark.parametrize("reach", [(4_000,), (40, 200, 900)])
def test_best_hypotheses_of_many(spark, folders, monkeypatch, reach):
    monkeypatch.setattr(inference, "REACH", reach)
    agrees(spark, "N12_scored_hypotheses", folders[2])


def test_sources_far_from_the_labels_of_the_next_frame(spark, folders, monkeypatch):
    monkeypatch.setattr(inference, "REACH", (800, 8_000))
    every, searched = (met(monkeypatch, spark, name, folders[1]) for name in ("N11_frame_pairs", "N12_scored_hypotheses"))
    assert 2 * searched < every


@pytest.mark.parametrize("name", SEARCHES)
def test_pairs_grow_as_objects_do(spark, folders, monkeypatch, name):
    few, many = (met(monkeypatch, spark, name, f) for f in folders[:2])
    assert many < 40 * few  # eight times the objects, 64 times the pairs within the radius


def test_assignment_of_a_crowded_frame_takes_seconds():
    rng = np.random.default_rng(2)
    x, y = rng.exponential(50, (2, 1500)), rng.integers(0, 100, (2, 1500))
    d = np.hypot(x[0][:, None] - x[1], y[0][:, None] - y[1])
    began = time.process_time()
    pairs = A.best_assignment(np.where(d <= 8, 8 - d, 0))
    assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) > 1000
    assert time.process_time() - began < 20
