"""Kernel clustering (letter L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.model import features, q6, query, r6
from platewise.operators import kernels as K
from platewise.operators.fuzzy import usable
from platewise.operators.samples import order_sql

#: Rounds, numbers of clusters, and gamma. With linear and cosine kernels the landmarks span all dimensions, and SQL can follow.
ROUNDS, SWEEP, GAMMA = 3, (2, 3, 4), 0.1
PLAIN = [K.Kernel("cosine"), K.Kernel("linear")]
CURVED = [K.Kernel("poly", GAMMA), K.Kernel("rbf", GAMMA), K.Kernel("sigmoid", GAMMA)]
UNITS = "v as (select exp, generate_subscripts(f, 1) as k, unnest(f) as v from features), s as (select exp, sqrt(sum(v * v)) as s from v group by exp), u as materialized (select 'linear' as kernel, exp, k, v from v union all select 'cosine', exp, k, case when s > 0 then v / s else v end from v join s using (exp)), own as (select kernel, exp, sum(v * v) as own from u group by kernel, exp)"


def rounds_sql(name: str, k: int, seed: int = 1) -> str:
    """name (kernel, exp, label, d): clusters and squared distances after ROUNDS rounds from seeded clusters."""
    out = [f"{name}_0 as (select distinct kernel, exp, ('0x' || substr({order_sql('exp', seed)}, 1, 8))::bigint % {k} as label from u)"]
    for i in range(ROUNDS):
        out.append(f"{name}_c{i} as materialized (select kernel, label, k, avg(v) as c from u join {name}_{i} using (kernel, exp) group by kernel, label, k)")
        out.append(f"{name}_d{i} as materialized (select kernel, exp, label, sum((v - c) ** 2) as d from u join {name}_c{i} using (kernel, k) group by kernel, exp, label)")
        out.append(f"{name}_{i + 1} as materialized (select * from {name}_d{i} qualify row_number() over (partition by kernel, exp order by round(d, 9), label) = 1)")
    return ", ".join([*out, f"{name} as (select * from {name}_{ROUNDS})"])


def _fitted(spark, sf_dir, kernels):
    rows = usable(features(spark, sf_dir))
    return rows, K.kernel_means(rows, [K.Run(kernel, k) for kernel in kernels for k in SWEEP], steps=ROUNDS, tolerance=0.0)


def _sweep(spark, sf_dir, kernels):
    rows, model = _fitted(spark, sf_dir, kernels)
    got = [(r.kernel.name, r.k, c) for r, c in zip(model.runs, K.cohesions(rows, model), strict=True)] if model else []
    return spark.createDataFrame(got, "kernel string, k int, c double").select("kernel", "k", F.round("c", 12).alias("cohesion"))  # far under one: millionths matter


@query("L05_kernel_clusters", f"{UNITS}, " + ", ".join(rounds_sql(f"x{k}", k) for k in SWEEP) + " " + " union all ".join(f"select kernel, {k} as k, exp, label::int as label, {q6('d')} as d from x{k}" for k in SWEEP), "features")
def kernel_clusters(spark, sf_dir):
    """The cluster of each experiment, and its squared distance to the centre in the kernel's space."""
    rows, model = _fitted(spark, sf_dir, PLAIN)
    if model is None:
        return spark.createDataFrame([], "kernel string, k int, exp bigint, label int, d double")
    names = F.array(*[F.struct(F.lit(r.kernel.name).alias("kernel"), F.lit(r.k).alias("k")) for r in model.runs])[F.col("run")]
    return K.belonging(rows, model).select(names["kernel"].alias("kernel"), names["k"].alias("k"), "exp", "label", r6(F.col("d")).alias("d"))


TOTAL = "n as (select kernel, count(*) as n, sum(own) as own from own group by kernel), w as (select kernel, sum(s * s) as w from (select kernel, k, sum(v) as s from u group by kernel, k) group by kernel)"


@query("L04_kernel_sweep", f"{UNITS}, {TOTAL}, " + ", ".join(rounds_sql(f"x{k}", k) for k in SWEEP) + ", i as (" + " union all ".join(f"select kernel, {k} as k, sum((d - own) ** 2) as square from x{k} join own using (kernel, exp) group by kernel" for k in SWEEP) + f") select kernel, k, round(square / (n * own - w), 12) as cohesion from i join n using (kernel) join w using (kernel)", "features")
def kernel_sweep(spark, sf_dir):
    """The cohesion for each number of clusters, linear and cosine kernels."""
    return _sweep(spark, sf_dir, PLAIN)


@query("L04_curved_kernel_sweep")
def curved_kernel_sweep(spark, sf_dir):
    """The cohesion for each number of clusters, polynomial, Gaussian and sigmoid kernels."""
    return _sweep(spark, sf_dir, CURVED)
