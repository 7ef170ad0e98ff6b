"""Lloyd's rounds: each is made once, and no row is joined with its own label."""

import numpy as np

from platewise.operators import clusters


def test_rounds_are_not_made_anew_by_the_next(spark):
    f = np.random.default_rng(3).normal(size=(60, 3)).round(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "exp bigint, f array<double>")
    got = clusters.lloyd(rows, clusters.first_centres(rows, 3, 1), 3)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "posexplode" not in plan and "sortmergejoin" not in plan
    centres = np.stack([r["f"] for r in clusters.first_centres(rows, 3, 1).orderBy("label").collect()])
    near = lambda c: np.linalg.norm(f[:, None] - c, axis=2)
    for _ in range(3):
        label = near(centres).argmin(axis=1)
        centres = np.stack([f[label == k].mean(axis=0) for k in range(3)])
    want, d = near(centres).argmin(axis=1), near(centres).min(axis=1)
    assert all(r["label"] == want[r["exp"]] and abs(r["d"] - d[r["exp"]]) < 1e-9 for r in got.collect())
