"""Many small groups are cumulated in one piece each, and a large one by ranges; both give the same sums."""

import pytest

from platewise.operators import statistics


@pytest.mark.parametrize("most, joined", [(8, False), (4, True)])
def test_small_groups_are_not_cut_by_ranges(spark, monkeypatch, most, joined):
    monkeypatch.setattr(statistics, "RANGE_ROWS", most)
    rows = [(k if k else None, float((v * 7 + k) % 5) + k / 100, v + 1) for k in range(20) for v in range(5)]
    got = statistics.running(spark.createDataFrame(rows, "k bigint, v double, n bigint"), ["k"], "v", ["n"])
    assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == joined
    want = {(k, v, sum(n for j, w, n in rows if j == k and w < v), 15) for k, v, _ in rows}
    assert {(r["k"], r["v"], r["before_n"], r["all_n"]) for r in got.collect()} == want
