"""Empirical p-values where controls and experiments have equal means, whose sums come in other orders: copies of sf0.01 whose parts and lines do not match."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()
SF = "/root/testdata/sf0.01"
NAMES = ["J02_empirical_p_and_q", "J12_q_by_rank", "J14_fisher_combination", "J20_conservative_q", "M02_validated_genes", "M03_gene_scores", "M29_events_and_q", "R08_hits_against_truth", "L30_high_confidence_genes"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The lines of a part in one copy are those of its neighbour in the next, so that most controls have an experiment's lines."""
    to, con = str(tmp_path_factory.mktemp("ties")), duckdb.connect()
    n = con.execute(f"select max(p_partkey) + 1 from '{SF}/part.parquet'").fetchone()[0]
    con.execute(f"copy (select t.* replace (p_partkey + i * {n} as p_partkey) from range(3) r(i), '{SF}/part.parquet' t) to '{to}/part.parquet' (format parquet)")
    con.execute(f"copy (select t.* replace (l_partkey + i * ({n} + 1) as l_partkey) from range(3) r(i), '{SF}/lineitem.parquet' t order by md5(l_orderkey || ':' || l_linenumber || ':' || i)) to '{to}/lineitem.parquet' (format parquet)")
    return to


@pytest.mark.parametrize("name", NAMES)
def test_equal_means_are_ties(spark, folder, name):
    got, con = QUERIES[name](spark, folder), duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(got.collect()) == plain([r[names.index(c)] for c in got.columns] for r in want.fetchall())
