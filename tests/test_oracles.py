"""Every query that has an oracle equals it on the smallest tables; every other one returns rows and a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

from platewise.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame, columns):
    one = lambda v: "null" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return frame[columns].astype(object).map(one).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ("O01_tracks_from_links", "F21_sharp_movements")
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))


def test_oracles_are_for_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
