"""Soft clustering (letter L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.model import features, q6, query, r6
from platewise.operators import fuzzy as Z
from platewise.operators.samples import order_sql

#: Rounds, numbers of clusters, seeds of restarts. M: with many dimensions, memberships of the usual exponent 2 are all but equal.
ROUNDS, SWEEP, RESTARTS, M = 3, (2, 3), (1, 2), 1.25
RUNS = [(k, seed) for k in SWEEP for seed in RESTARTS]
VALUES = "u as materialized (select exp, generate_subscripts(f, 1) as k, unnest(f) as v from features)"


def fuzzy_sql(name: str, k: int, seed: int) -> str:
    """name (exp, label, w, d): memberships and squared distances after ROUNDS rounds, and name_c (label, k, c)."""
    out = [f"{name}_s as (select exp, row_number() over (order by {order_sql('exp', seed)}, exp) - 1 as label from (select distinct exp from u)), {name}_0 as (select label, k, v as c from u join {name}_s using (exp) where label < {k})"]
    for i in range(ROUNDS + 1):
        out.append(f"{name}_d{i} as materialized (select exp, label, sum((v - c) ** 2) as d from u join {name}_{i} using (k) group by exp, label)")
        out.append(f"{name}_z{i} as (select *, min(d) over (partition by exp) = 0 as hit from {name}_d{i}), {name}_p{i} as (select exp, label, d, case when hit then (d = 0)::int else nullif(d, 0) ** {-1 / (M - 1)} end as p from {name}_z{i}), {name}_w{i} as materialized (select exp, label, d, p / sum(p) over (partition by exp) as w from {name}_p{i})")
        if i < ROUNDS:
            out.append(f"{name}_{i + 1} as materialized (select label, k, sum(w ** {M} * v) / sum(w ** {M}) as c from u join {name}_w{i} using (exp) group by label, k)")
    return ", ".join([*out, f"{name} as (select * from {name}_w{ROUNDS}), {name}_c as (select * from {name}_{ROUNDS})"])


def indices_sql(name: str, k: int) -> str:
    """One row: k and the three indices."""
    apart = f"(select min(s) from (select sum((a.c - b.c) ** 2) as s from {name}_c a join {name}_c b on a.k = b.k and a.label < b.label group by a.label, b.label))"
    away = f"(select label, sum((c - mean) ** 2) as away from {name}_c join (select k, avg(v) as mean from u group by k) using (k) group by label)"
    return f"select {k} as k, sum(w ** {M} * (d - away)) as fs, sum(w ** {M} * d) / (count(distinct exp) * {apart}) as xb, -sum(case when w > 0 then w * log2(w) else 0 end) / (count(distinct exp) * log2({k})) as pe from {name} join {away} using (label)"


def _rows(spark, sf_dir):
    return Z.usable(features(spark, sf_dir))


@query("L06_fuzzy_memberships", f"{VALUES}, {fuzzy_sql('x', 3, 1)} select exp, label::int as label, {q6('w')} as membership from x", "features")
def fuzzy_memberships(spark, sf_dir):
    """How much each experiment belongs to each of three clusters."""
    rows = _rows(spark, sf_dir)
    (centres,) = Z.fuzzy_means(rows, [(3, 1)], M, steps=ROUNDS, tolerance=0.0)
    return Z.belonging(rows, centres, M).select("exp", F.posexplode("u").alias("label", "u")).select("exp", "label", r6(F.col("u")).alias("membership"))


@query("L06_fuzzy_indices", f"{VALUES}, " + ", ".join(fuzzy_sql(f"x{k}{s}", k, s) for k, s in RUNS) + ", i as (" + " union all ".join(indices_sql(f"x{k}{s}", k) for k, s in RUNS) + f") select k, {q6('min(fs)')} as fukuyama_sugeno, {q6('min(xb)')} as xie_beni, {q6('min(pe)')} as entropy from i group by k", "features")
def fuzzy_indices(spark, sf_dir):
    """For each number of clusters, the smallest of each index over the restarts."""
    rows = _rows(spark, sf_dir)
    got = Z.indices(rows, Z.fuzzy_means(rows, RUNS, M, steps=ROUNDS, tolerance=0.0), M)
    per = spark.createDataFrame(got, "k int, fs double, xb double, pe double")
    return per.groupBy("k").agg(r6(F.min("fs")).alias("fukuyama_sugeno"), r6(F.min("xb")).alias("xie_beni"), r6(F.min("pe")).alias("entropy"))
