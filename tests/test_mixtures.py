"""Labels of Gaussian mixtures."""

import numpy as np

from platewise.operators import clusters as L


def test_mixture_labels_part_blobs_by_size(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.5, (60, 2)), rng.normal(8, 0.5, (30, 2))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "exp bigint, f array<double>")
    got = L.mixture_labels(df, 2).toPandas().sort_values("exp")
    assert got.exp.tolist() == list(range(90))
    assert got.label.tolist() == [0] * 60 + [1] * 30
    assert got.p.min() > 0.99
    none = L.mixture_labels(df.where("false"), 2)
    assert none.columns == ["exp", "label", "p"] and none.count() == 0
