"""Further tests, distances, assignments, hits and nulls of the inventory (letters J to R), each a query of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.jobs.screens import EMPIRICAL, MEAN, NULL_RANKS, RANK_SQL, REPLICATES, RUNS, SEED, _empirical, _h, _means, _replicate_distances
from platewise.jobs.tracking import MUTUAL, NEXT, RADIUS, _links, _place_pairs
from platewise.model import features, objects, q6, query, r6, screen, table, track_points, wells
from platewise.operators import assignment as A
from platewise.operators import clean as C
from platewise.operators import clusters as L
from platewise.operators import distances as K
from platewise.operators import hits as M
from platewise.operators import layout as Q
from platewise.operators import samples
from platewise.operators import statistics as S
from platewise.operators import tracks as T
from platewise.sources import scratch, stored

SEEDED = samples.order_sql
UNNESTED = "u as (select exp, plate, condition, is_control, generate_subscripts(f, 1) as k, unnest(f) as v from features)"
CONDITIONS = f"{UNNESTED}, m as (select condition, k, avg(v) as v from u group by condition, k)"


def ks_sql(keys: str, union: str = "u") -> str:
    """n1, n2, d of mine = 1 against mine = 0 in a relation (keys, v, mine)."""
    return f"c as (select {keys}, v, sum(mine) as a, sum(1 - mine) as b from {union} group by {keys}, v), k as (select {keys}, sum(a) over w as ca, sum(b) over w as cb, sum(a) over z as n1, sum(b) over z as n2 from c window w as (partition by {keys} order by v rows unbounded preceding), z as (partition by {keys})), d as (select {keys}, n1::bigint as n1, n2::bigint as n2, max(abs(ca / n1 - cb / n2)) as d from k where n1 > 0 and n2 > 0 group by all)"


# ---- J: tests


BATCH_P = f"{MEAN}, c as (select measure as v from screen where is_control), b as (select batch, gene, sirna, avg(measure) as v from screen where not is_control group by batch, gene, sirna), p as (select batch, gene, sirna, (1 + (select count(*) from c where c.v >= b.v)) / (1 + (select count(*) from c)) as p from b)"


def _batch_p(spark, sf_dir):
    rows = screen(spark, sf_dir)
    b = rows.where(~F.col("is_control")).groupBy("batch", "gene", "sirna").agg(F.avg("measure").alias("v"))
    return S.empirical_p(b, rows.where("is_control"), "v", "measure")


@query("J04_statistics_by_parameter", f"{BATCH_P} select gene, batch, count(*) as n, {q6('sum(-2 * ln(p))')} as statistic from p group by gene, batch", "screen")
def statistics_by_parameter(spark, sf_dir):
    return _batch_p(spark, sf_dir).groupBy("gene", "batch").agg(F.count("*").alias("n"), r6(F.sum(-2 * F.ln("p"))).alias("statistic"))


@query("J05_stacked_iterations", f"{BATCH_P} select batch as iteration, sirna, {q6('p')} as p from p union all select 0, sirna, {q6('max(p)')} from p group by sirna", "screen")
def stacked_iterations(spark, sf_dir):
    """A row for each iteration, and iteration 0 for the largest of all."""
    p = _batch_p(spark, sf_dir)
    return p.select(F.col("batch").alias("iteration"), "sirna", r6(F.col("p")).alias("p")).union(p.groupBy("sirna").agg(r6(F.max("p")).alias("p")).select(F.lit(0), "sirna", "p"))


@query("J07_random_control_pool", f"g as (select distinct plate, sirna from screen where is_control), w as (select * from g qualify row_number() over (partition by plate order by {SEEDED('sirna', 2)}, sirna) <= 5) select plate, count(*) as n, {q6('avg(measure)')} as mean from screen join w using (plate, sirna) where is_control group by plate", "screen")
def random_control_pool(spark, sf_dir):
    """Each plate's pool: up to five of its control wells at random."""
    rows = screen(spark, sf_dir).where("is_control")
    chosen = samples.first_n_of(rows.select("plate", "sirna").distinct(), "plate", "sirna", 5, 2)
    return rows.join(chosen, ["plate", "sirna"], "left_semi").groupBy("plate").agg(F.count("*").alias("n"), r6(F.avg("measure")).alias("mean"))


@query("J08_plate_against_own_pool", f"u as (select plate, measure as v, case when sirna % 7 = 0 then 0 else 1 end as mine from screen), {ks_sql('plate')} select plate, n1, n2, {q6('d')} as d from d", "screen")
def plate_against_own_pool(spark, sf_dir):
    """The pool is every seventh well of the same plate."""
    rows = screen(spark, sf_dir)
    both = S.against_pool(rows.where("sirna % 7 <> 0"), rows.where("sirna % 7 = 0"), ["plate"], "measure", within=["plate"])
    return S.kolmogorov_smirnov(both, ["plate"]).select("plate", "n1", "n2", r6(F.col("d")).alias("d"))


@query("J09_movie_value_lists", "select plate, row_number() over (partition by plate order by round(x)::bigint, label) as place, round(x)::bigint as v from objects where cls = 'purchase' and x is not null", "objects")
def movie_value_lists(spark, sf_dir):
    """The sorted values of each movie, a row for each place in its list."""
    rows = objects(spark, sf_dir).where("cls = 'purchase'").select("plate", "label", F.round("x").cast("bigint").alias("v"))
    return S.row_numbers(rows, "v", "label", "place", ["plate"]).select("plate", "place", "v")


@query("J10_control_against_control", f"w as (select gene, sirna from (select distinct gene, sirna from screen where is_control) order by {SEEDED('sirna', 14)}, sirna limit 7), q as (select a.sirna as i, b.sirna as j from w a join w b on a.sirna < b.sirna), u as (select i, j, measure as v, case when sirna = i then 1 else 0 end as mine from q join screen on sirna in (i, j)), {ks_sql('i, j')} select i, j, n1, n2, {q6('d')} as d from d", "screen")
def control_against_control(spark, sf_dir):
    """The 21 pairs of seven random controls: the null of the tests of experiments."""
    rows = screen(spark, sf_dir).where("is_control").select("sirna", "measure")
    w = samples.first_n(rows.select("sirna").distinct(), "sirna", 7, 14)
    pairs = w.select(F.col("sirna").alias("i")).join(F.broadcast(w.select(F.col("sirna").alias("j"))), F.col("i") < F.col("j"))
    one = rows.join(F.broadcast(pairs), rows["sirna"] == pairs["i"]).select("i", "j", "measure")
    other = rows.join(F.broadcast(pairs), rows["sirna"] == pairs["j"]).select("i", "j", "measure")
    return S.kolmogorov_smirnov(S.against_pool(one, other, ["i", "j"], "measure", within=["i", "j"]), ["i", "j"]).select("i", "j", "n1", "n2", r6(F.col("d")).alias("d"))


@query("J12_q_by_rank", f"{EMPIRICAL} select sirna, {q6('p')} as p, {q6('p * count(*) over () / rank() over (order by p)')} as q from e", "screen")
def q_by_rank(spark, sf_dir):
    e = _empirical(spark, sf_dir)
    rank = S.running(e.groupBy(F.col("p").alias("at")).agg(F.count("*").alias("n")), [], "at", ["n"]).select("at", "before_n", "all_n")
    return e.join(rank, F.col("p") == F.col("at")).select("sirna", r6(F.col("p")).alias("p"), r6(F.col("p") * F.col("all_n") / (F.col("before_n") + 1)).alias("q"))


@query("J15_parameter_correlations", f"m as (select batch, gene, avg(measure) as v from screen group by batch, gene), p as (select a.batch as i, b.batch as j, a.v as x, b.v as y from m a join m b on a.gene = b.gene and a.batch < b.batch), r as (select i, j, rank() over (partition by i, j order by x) + (count(*) over (partition by i, j, x) - 1) / 2 as rx, rank() over (partition by i, j order by y) + (count(*) over (partition by i, j, y) - 1) / 2 as ry from p) select i, j, count(*) as n, {q6('corr(rx, ry)')} as rho from r group by i, j", "screen")
def parameter_correlations(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("batch", "gene").agg(F.avg("measure").alias("v"))
    pairs = K.pair_table(m, "batch", "v", lambda a, b: F.struct(a.alias("x"), b.alias("y")), ["gene"]).select("i", "j", "d.x", "d.y")
    return S.spearman(pairs, ["i", "j"], "x", "y").select("i", "j", "n", r6(F.col("rho")).alias("rho"))


@query("J23_plates_of_compound", f"p as (select distinct plate from screen), u as (select gene, a.plate as i, b.plate as j, measure as v, case when s.plate = a.plate then 1 else 0 end as mine from screen s join p a on true join p b on a.plate < b.plate and s.plate in (a.plate, b.plate)), {ks_sql('gene, i, j')} select gene, i, j, n1, n2, {q6('d')} as d from d", "screen")
def plates_of_compound(spark, sf_dir):
    """Each compound on each plate against the same on every other."""
    rows = screen(spark, sf_dir).select("gene", "plate", "measure").where("plate is not null and measure is not null")
    return S.kolmogorov_smirnov_pairs(rows, ["gene"], "plate", "measure").select("gene", "i", "j", "n1", "n2", r6(F.col("d")).alias("d"))


DRAWS = 6


@query("J24_repeated_draws", f"w as (select distinct sirna from screen where is_control), g as (select draw, sirna, md5(draw || ':' || sirna) < '8' as half from w, (select unnest(range(1, {DRAWS + 1})) as draw)), u as (select draw, measure as v, case when half then 1 else 0 end as mine from g join screen using (sirna) where is_control), {ks_sql('draw')} select draw::int as draw, n1, n2, {q6('d')} as d from d", "screen")
def repeated_draws(spark, sf_dir):
    """The controls in two random halves, again and again."""
    rows = screen(spark, sf_dir).where("is_control").select("sirna", "measure").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS))))
    half = F.md5(F.concat_ws(":", "draw", "sirna").cast("binary")) < "8"
    both = S.against_pool(rows.where(half), rows.where(~half), ["draw"], "measure", within=["draw"])
    return S.kolmogorov_smirnov(both, ["draw"]).select("draw", "n1", "n2", r6(F.col("d")).alias("d"))


ROLES = f"w as (select distinct plate, sirna from screen where is_control), g as (select plate, sirna, row_number() over (partition by plate order by {SEEDED('sirna', 11)}, sirna) <= 6 as reference from w), pool as (select plate, measure as v from screen join g using (plate, sirna) where reference and is_control)"
RANKED = "c as (select plate, sirna, v, sum(mine) as a, count(*) as t from u group by all), r as (select *, coalesce(sum(t) over (partition by plate, sirna order by v rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2 as r from c), s as (select plate, sirna, sum(a)::double as n1, sum(t)::double as n, sum(a * r) as w from r group by plate, sirna), z as (select plate, sirna, n1, n - n1 as n2, (w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1)) as z from s where n1 > 0 and n > n1)"


def _roles(spark, sf_dir):
    """Rows of the screen with reference: whether the well is one of its plate's six reference controls (null for other wells)."""
    k = F.row_number().over(W.partitionBy("plate").orderBy(samples.order("sirna", 11), "sirna"))
    rows = screen(spark, sf_dir)
    g = rows.where("is_control").select("plate", "sirna").distinct().select("plate", "sirna", (k <= 6).alias("reference"))
    return rows.join(g, ["plate", "sirna"], "left")


@query("J26_remaining_controls", f"{ROLES}, e as (select plate, sirna, measure as v from screen join g using (plate, sirna) where not reference and is_control), u as (select plate, sirna, v, 1 as mine from e union all select q.plate, q.sirna, pool.v, 0 from (select distinct plate, sirna from e) q join pool using (plate)), {RANKED} select plate, sirna, n1::bigint as n1, n2::bigint as n2, {q6('z')} as z from z", "screen")
def remaining_controls(spark, sf_dir):
    """Each control that is no reference against its plate's six references."""
    rows = _roles(spark, sf_dir).where("is_control")
    both = S.against_pool(rows.where("not reference"), rows.where("reference"), ["plate", "sirna"], "measure", within=["plate"])
    return S.rank_sum(both, ["plate", "sirna"]).select("plate", "sirna", "n1", "n2", r6(F.col("z")).alias("z"))


@query("J27_wells_against_references", f"{ROLES}, e as (select plate, gene, sirna, measure as v from screen where not is_control), u as (select plate, sirna, v, 1 as mine from e union all select q.plate, q.sirna, pool.v, 0 from (select distinct plate, sirna from e) q join pool using (plate)), {RANKED} select plate, count(*) as n, {q6('max(z)')} as high, {q6('min(z)')} as low, count(case when abs(z) > 1.959964 then 1 end) as hits from z group by plate", "screen")
def wells_against_references(spark, sf_dir):
    """All wells against the references of their plate, and what stands out."""
    rows = _roles(spark, sf_dir)
    both = S.against_pool(rows.where("not is_control"), rows.where("is_control and reference"), ["plate", "sirna"], "measure", within=["plate"])
    z = S.rank_sum(both, ["plate", "sirna"])
    return z.groupBy("plate").agg(F.count("*").alias("n"), r6(F.max("z")).alias("high"), r6(F.min("z")).alias("low"), F.count_if(F.abs("z") > 1.959964).alias("hits"))


@query("J31_reference_pairs", f"d as (select gene, median(measure) as d from screen where is_control group by gene) select sirna, {q6('d')} as reference, {q6('sum(measure)')} as v from screen join d using (gene) where not is_control group by sirna, d", "screen")
def reference_pairs(spark, sf_dir):
    rows = screen(spark, sf_dir)
    d = S.quantiles(rows.where("is_control"), ["gene"], "measure", {"reference": 0.5})
    return rows.where(~F.col("is_control")).groupBy("sirna", "gene").agg(r6(F.sum("measure")).alias("v")).join(d, "gene").select("sirna", r6(F.col("reference")).alias("reference"), "v")


@query("J32_profile_correlations", f"{REPLICATES}, p as (select x.ci, x.pi, y.pi as pj, x.d as a, y.d as b from d x join d y on x.ci = y.ci and x.pi < y.pi and x.cj = y.cj and x.pj = y.pj where x.cj <> x.ci), r as (select ci, pi, pj, corr(a, b) as r from p group by ci, pi, pj) select ci as condition, count(*) as pairs, {q6('avg(r)')} as r from r group by ci", "features")
def profile_correlations(spark, sf_dir):
    """Mean correlation of the distance profiles of a condition's replicates."""
    d = _replicate_distances(spark, sf_dir).where("ci <> cj")
    other = d.select("ci", F.col("pi").alias("other"), "cj", "pj", F.col("d").alias("b"))
    r = d.join(other, ["ci", "cj", "pj"]).where("pi < other").groupBy("ci", "pi", "other").agg(F.corr("d", "b").alias("r"))
    return r.groupBy(F.col("ci").alias("condition")).agg(F.count("*").alias("pairs"), r6(F.avg("r")).alias("r"))


DISTANCES = {"euclidean": ("sqrt(sum((a.v - b.v) ** 2))", X.euclidean), "total_variation": ("sum(abs(a.v - b.v))", X.total_variation)}


@query("J34_ratios_of_distances", f"{CONDITIONS}, d as (select a.condition as i, b.condition as j, " + ", ".join(f"{s} as {n}" for n, (s, _) in DISTANCES.items()) + " from m a join m b on a.k = b.k and a.condition <> b.condition group by 1, 2), " + ", ".join(f"x{n} as (select '{n}' as distance, i as condition, {q6(f'min({n}) / avg({n})')} as ratio from d group by i)" for n in DISTANCES) + " " + " union all ".join(f"select * from x{n}" for n in DISTANCES), "features")
def ratios_of_distances(spark, sf_dir):
    """The nearest condition over the mean of all, for several distances."""
    means = L.mean_vectors(features(spark, sf_dir), ["condition"])
    each = K.symmetric(K.pair_table(means, "condition", "f", lambda a, b: F.struct(*[f(a, b).alias(n) for n, (_, f) in DISTANCES.items()])))
    long = each.select("i", F.explode(F.array(*[F.struct(F.lit(n).alias("distance"), F.col(f"d.{n}").alias("v")) for n in DISTANCES])).alias("x"))
    return long.groupBy("x.distance", F.col("i").alias("condition")).agg(r6(F.min("x.v") / F.avg("x.v")).alias("ratio"))


@query("J37_truth_and_prediction", f"t as (select sirna, gene, max(measure) as truth, avg(measure) as predicted from screen group by sirna, gene) select gene, count(*) as n, {q6('corr(truth, predicted)')} as r, {q6('avg((truth - predicted) ** 2) / 1e6')} as mse from t group by gene", "screen")
def truth_and_prediction(spark, sf_dir):
    t = screen(spark, sf_dir).groupBy("sirna", "gene").agg(F.max("measure").alias("truth"), F.avg("measure").alias("predicted"))
    gap = F.col("truth") - F.col("predicted")
    return t.groupBy("gene").agg(F.count("*").alias("n"), r6(F.corr("truth", "predicted")).alias("r"), r6(F.avg(gap * gap) / 1e6).alias("mse"))


@query("J39_matrix_correlation", f"{CONDITIONS}, d as (select a.condition as i, b.condition as j, " + ", ".join(f"{s} as {n}" for n, (s, _) in DISTANCES.items()) + f" from m a join m b on a.k = b.k and a.condition < b.condition group by 1, 2) select count(*) as n, {q6('corr(euclidean, total_variation)')} as r, {q6('avg(abs(euclidean - total_variation) / total_variation)')} as difference from d", "features")
def matrix_correlation(spark, sf_dir):
    means = L.mean_vectors(features(spark, sf_dir), ["condition"])
    d = K.pair_table(means, "condition", "f", lambda a, b: F.struct(*[f(a, b).alias(n) for n, (_, f) in DISTANCES.items()])).select("d.*")
    return d.agg(F.count("*").alias("n"), r6(F.corr("euclidean", "total_variation")).alias("r"), r6(F.avg(F.abs(F.col("euclidean") - F.col("total_variation")) / F.col("total_variation"))).alias("difference"))


CONTINGENCY = f"""o as (select plate, condition, count(*) as n from features group by all), x as (select 0 as run, plate, condition, n from o)
, s as (select r.run, f.exp, f.condition, row_number() over (partition by r.run order by md5('7:' || r.run || ':' || f.exp), f.exp) as k from features f, (select unnest(range(1, 21)) as run) r), t as (select exp, plate, row_number() over (order by exp) as k from features)
, y as (select run, plate, condition, count(*) as n from s join t using (k) group by all), z as (select * from x union all select * from y)
, e as (select a.run, a.plate, a.condition, a.n as o, b.n as c from z a join z b on a.run = b.run and b.plate = 0 and a.condition = b.condition where a.plate <> 0), w as (select *, sum(o) over (partition by run, plate) as so, sum(c) over (partition by run, plate) as sc from e)
, chi as (select run, plate, sum((o * sqrt(sc / so) - c * sqrt(so / sc)) ** 2 / (o + c)) as chi2 from w group by run, plate)"""
PERMUTATIONS = 20


def _contingency(spark, sf_dir):
    """run, plate, chi2: of the cluster counts of a plate against the control plate's; run 0 is observed, the others have their labels permuted."""
    rows = features(spark, sf_dir).select("exp", "plate", "condition")
    runs = F.explode(F.sequence(F.lit(1), F.lit(PERMUTATIONS)))
    place = S.row_numbers(rows, "exp", "plate", "k").select("k", "plate")
    drawn = stored(rows.select("exp", "condition", runs.alias("run")).withColumn("order", samples.order(F.concat_ws(":", "run", "exp"), 7)), "drawn")
    null = S.row_numbers(drawn, "order", "exp", "k", ["run"]).join(place, "k").select("run", "plate", "condition")
    n = rows.select(F.lit(0).alias("run"), "plate", "condition").union(null).groupBy("run", "plate", "condition").agg(F.count("*").alias("o"))
    t = n.where("plate <> 0").join(n.where("plate = 0").select("run", "condition", F.col("o").alias("c")), ["run", "condition"])
    group = W.partitionBy("run", "plate")
    t = t.withColumns({"so": F.sum("o").over(group), "sc": F.sum("c").over(group)})
    off = F.col("o") * F.sqrt(F.col("sc") / F.col("so")) - F.col("c") * F.sqrt(F.col("so") / F.col("sc"))
    return t.groupBy("run", "plate").agg(F.sum(off * off / (F.col("o") + F.col("c"))).alias("chi2"))


@query("J18_cluster_contingency", f"{CONTINGENCY} select plate, {q6('chi2')} as chi2 from chi where run = 0", "features")
def cluster_contingency(spark, sf_dir):
    return _contingency(spark, sf_dir).where("run = 0").select("plate", r6(F.col("chi2")).alias("chi2"))


@query("J19_permuted_labels", f"{CONTINGENCY} select o.plate, {q6('(1 + count(case when round(n.chi2, 9) >= round(o.chi2, 9) then 1 end)) / (1 + count(*))')} as p from chi o join chi n on n.plate = o.plate and n.run > 0 where o.run = 0 group by o.plate", "features")
def permuted_labels(spark, sf_dir):
    """The share of label permutations whose statistic is as large."""
    chi = _contingency(spark, sf_dir).withColumn("chi2", F.round("chi2", 9))
    seen = chi.where("run = 0").select("plate", F.col("chi2").alias("seen"))
    return chi.where("run > 0").join(F.broadcast(seen), "plate").groupBy("plate").agg(r6((1 + F.count_if(F.col("chi2") >= F.col("seen"))) / (1 + F.count("*"))).alias("p"))


@query("J22_repeated_permutations", f"{CONTINGENCY} select run::int as run, count(*) as plates, {q6('max(chi2)')} as largest from chi where run > 0 group by run", "features")
def repeated_permutations(spark, sf_dir):
    return _contingency(spark, sf_dir).where("run > 0").groupBy("run").agg(F.count("*").alias("plates"), r6(F.max("chi2")).alias("largest"))


@query("J40_mahalanobis_hits", f"m as (select sirna, gene, bool_or(is_control) as is_control, avg(measure) as a, max(measure) as b from screen group by sirna, gene), c as (select avg(a) as ma, avg(b) as mb, var_samp(a) as sa, var_samp(b) as sb, covar_samp(a, b) as sab from m where is_control), d as (select sirna, sign(a - ma) * sqrt(((a - ma) ** 2 * sb - 2 * (a - ma) * (b - mb) * sab + (b - mb) ** 2 * sa) / (sa * sb - sab ** 2)) as d from m, c where not is_control) select sirna, {q6('d')} as d, abs(d) > 3 as hit from d", "screen")
def mahalanobis_hits(spark, sf_dir):
    """Signed distance from the controls by their covariance."""
    m = screen(spark, sf_dir).groupBy("sirna", "gene").agg(F.bool_or("is_control").alias("is_control"), F.avg("measure").alias("a"), F.max("measure").alias("b"))
    c = m.where("is_control").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("sa"), F.var_samp("b").alias("sb"), F.covar_samp("a", "b").alias("sab"))
    x, y = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    d = F.sign(x) * F.sqrt((x * x * F.col("sb") - 2 * x * y * F.col("sab") + y * y * F.col("sa")) / (F.col("sa") * F.col("sb") - F.col("sab") * F.col("sab")))
    return m.where(~F.col("is_control")).crossJoin(F.broadcast(c)).select("sirna", r6(d).alias("d"), (F.abs(d) > 3).alias("hit"))


# ---- K: distances


@query("K04_edges_of_sample", f"s as (select condition from (select distinct condition from features) order by {SEEDED('condition', 3)}, condition limit 4), v as (select condition, f[1] as v from features join s using (condition)) select condition, count(*) as n, {q6('min(v)')} as low, {q6('quantile_cont(v, 0.5)')} as middle, {q6('max(v)')} as high from v group by condition", "features")
def edges_of_sample(spark, sf_dir):
    rows = features(spark, sf_dir).select("condition", F.get("f", F.lit(0)).alias("v"))
    chosen = samples.first_n(rows.select("condition").distinct(), "condition", 4, 3)
    kept = rows.join(F.broadcast(chosen), "condition", "left_semi")
    edges = S.quantiles(kept, ["condition"], "v", {"low": 0.0, "middle": 0.5, "high": 1.0})
    return kept.groupBy("condition").agg(F.count("*").alias("n")).join(edges, "condition").select("condition", "n", *[r6(F.col(c)).alias(c) for c in ("low", "middle", "high")])


@query("K06_grid_costs", f"b as (select distinct size % 16 as i from wells) select a.i, b.i as j, {q6('sqrt((a.i // 4 - b.i // 4) ** 2 + (a.i % 4 - b.i % 4) ** 2)')} as cost from b a, b b", "wells")
def grid_costs(spark, sf_dir):
    b = wells(spark, sf_dir).select((F.col("size") % 16).alias("i")).distinct()
    pairs = b.crossJoin(F.broadcast(b.withColumnRenamed("i", "j")))  # sixteen cells at most
    return pairs.select("i", "j", r6(X.norm(F.floor(F.col("i") / 4) - F.floor(F.col("j") / 4), F.col("i") % 4 - F.col("j") % 4)).alias("cost"))


@query("K07_costs_by_kind", "b as (select distinct size % 8 as i from wells), p as (select a.i, b.i as j, abs(a.i - b.i) as d from b a, b b) select 'linear' as kind, i, j, d::int as cost from p union all select 'squared', i, j, (d * d)::int from p", "wells")
def costs_by_kind(spark, sf_dir):
    b = wells(spark, sf_dir).select((F.col("size") % 8).alias("i")).distinct()
    p = b.crossJoin(F.broadcast(b.withColumnRenamed("i", "j"))).withColumn("d", F.abs(F.col("i") - F.col("j")))
    return p.select(F.lit("linear").alias("kind"), "i", "j", F.col("d").alias("cost")).union(p.select(F.lit("squared"), "i", "j", F.col("d") * F.col("d")))


def shares_sql(keys: str, bins: int = 10) -> str:
    """h (keys, bin, v): shares of equal-width bins of x over all objects."""
    return f"t as (select min(x) as lo, max(x) as hi from objects), n as (select {keys}, least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1})::int as bin, count(*) as n from objects, t group by all), h as (select g.{keys}, b.bin, coalesce(n.n, 0) / sum(coalesce(n.n, 0)) over (partition by g.{keys}) as v from (select distinct {keys} from n) g cross join (select unnest(range({bins}))::int as bin) b left join n on n.{keys} = g.{keys} and n.bin = b.bin)"


@query("K08_transport_between_classes", f"{shares_sql('cls')}, c as (select cls, bin, sum(v) over (partition by cls order by bin rows unbounded preceding) as c from h) select a.cls as i, b.cls as j, {q6('sum(abs(a.c - b.c))')} as cost from c a join c b on a.bin = b.bin and a.cls < b.cls group by 1, 2", "objects")
def transport_between_classes(spark, sf_dir):
    return K.pair_table(K.histograms(objects(spark, sf_dir), ["cls"], "x", 10), "cls", "h", X.emd_1d).select("i", "j", r6(F.col("d")).alias("cost"))


@query("K09_transport_to_centres", f"{shares_sql('plate')}, c as (select plate, bin, sum(v) over (partition by plate order by bin rows unbounded preceding) as c from h), g as (select bin, avg(c) as c from c group by bin) select plate, {q6('sum(abs(c.c - g.c))')} as cost from c join g using (bin) group by plate", "objects")
def transport_to_centres(spark, sf_dir):
    """Every plate against the mean histogram of all."""
    h = _h(spark, sf_dir)
    centre = L.mean_vectors(h.withColumnRenamed("h", "f").withColumn("one", F.lit(1)), ["one"]).select(F.col("f").alias("centre"))
    return h.crossJoin(F.broadcast(centre)).select("plate", r6(X.emd_1d(F.col("h"), F.col("centre"))).alias("cost"))


@query("K20_mixed_distances", f"{shares_sql('plate')}, m as (select plate, avg(y) as y from objects group by plate) select a.plate as i, b.plate as j, {q6('0.7 * abs(max(x.y) - max(z.y)) + 0.3 * sqrt(sum((sqrt(a.v) - sqrt(b.v)) ** 2) / 2)')} as d from h a join h b on a.bin = b.bin and a.plate < b.plate join m x on x.plate = a.plate join m z on z.plate = b.plate group by 1, 2", "objects")
def mixed_distances(spark, sf_dir):
    """A numeric part and a histogram part, weighted."""
    rows = objects(spark, sf_dir)
    both = _h(spark, sf_dir).join(rows.groupBy("plate").agg(F.avg("y").alias("y")), "plate").select("plate", F.struct("y", "h").alias("v"))
    return K.pair_table(both, "plate", "v", lambda a, b: 0.7 * F.abs(a["y"] - b["y"]) + 0.3 * X.hellinger(a["h"], b["h"])).select("i", "j", r6(F.col("d")).alias("d"))


@query("K21_inertia", f"{CONDITIONS} select condition, {q6('sum((u.v - m.v) ** 2)')} as inertia from u join m using (condition, k) group by condition", "features")
def inertia(spark, sf_dir):
    """The sum of squared distances to the centre: from the elements' variances, in one pass."""
    rows = C.long_features(features(spark, sf_dir), ["condition"]).groupBy("condition", "i").agg((F.var_pop("v") * F.count("*")).alias("s"))
    return rows.groupBy("condition").agg(r6(F.sum("s")).alias("inertia"))


@query("K23_largest_of_sirna", f"m as (select gene, avg(measure) as m from screen group by gene) select sirna, count(*) as n, {q6('max(abs(measure - m))')} as largest from screen join m using (gene) group by sirna", "screen")
def largest_of_sirna(spark, sf_dir):
    rows = screen(spark, sf_dir)
    m = rows.groupBy("gene").agg(F.avg("measure").alias("m"))
    return rows.join(F.broadcast(m), "gene").groupBy("sirna").agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("measure") - F.col("m")))).alias("largest"))


@query("K24_scaled_distances", f"{UNNESTED}, s as (select k, avg(v) as m, stddev_pop(v) as s from u where is_control group by k), z as (select condition, k, avg((v - m) / nullif(s, 0)) as v from u join s using (k) group by condition, k), d as (select a.condition as i, b.condition as j, sqrt(sum((a.v - b.v) ** 2)) as d from z a join z b on a.k = b.k and a.condition <> b.condition group by 1, 2) select i, j, {q6('(d - avg(d) over (partition by j)) / nullif(stddev_pop(d) over (partition by j), 0)')} as z from d", "features")
def scaled_distances(spark, sf_dir):
    """z-scores by the controls, distances of all conditions, and z-scores of each column of these."""
    z = C.z_scores(C.long_features(features(spark, sf_dir), ["exp", "condition", "is_control"]), ["i"], "v", F.col("is_control"))
    means = z.groupBy("condition", "i").agg(F.avg("z").alias("v")).groupBy("condition").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("f"))
    d = K.symmetric(K.pair_table(means, "condition", "f", X.euclidean))
    column = W.partitionBy("j")
    spread = F.stddev_pop("d").over(column)
    return d.select("i", "j", r6((F.col("d") - F.avg("d").over(column)) / F.when(spread > 0, spread)).alias("z"))


@query("K27_row_normalised", f"select plate, cls, {q6('count(*) / sum(count(*)) over (partition by plate)')} as share from objects group by plate, cls", "objects")
def row_normalised(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "cls").agg(F.count("*").alias("n"))
    return n.select("plate", "cls", r6(F.col("n") / F.sum("n").over(W.partitionBy("plate"))).alias("share"))


@query("K29_full_matrix", f"{CONDITIONS} select a.condition as i, b.condition as j, {q6('sqrt(sum((a.v - b.v) ** 2))')} as d from m a join m b using (k) group by 1, 2", "features")
def full_matrix(spark, sf_dir):
    """The upper triangle, its mirror, and the diagonal."""
    means = L.mean_vectors(features(spark, sf_dir), ["condition"])
    d = K.symmetric(K.pair_table(means, "condition", "f", X.euclidean)).select("i", "j", r6(F.col("d")).alias("d"))
    return d.union(means.select(F.col("condition").alias("i"), F.col("condition").alias("j"), F.lit(0.0)))


@query("K31_full_frame_matrix", "c as (select plate, frame, count(*) as n from objects group by plate, frame) select a.plate as i, b.plate as j, sum(abs(a.n - b.n))::bigint as d from c a join c b on a.frame = b.frame and a.plate <> b.plate group by 1, 2", "objects")
def full_frame_matrix(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.count("*").alias("n"))
    return K.symmetric(K.pair_table(c, "plate", "n", lambda a, b: F.abs(a - b), ["frame"]).groupBy("i", "j").agg(F.sum("d").alias("d")))


# ---- L: clusters


@query("L03_silhouette", f"{UNNESTED}, p as (select a.exp as i, b.exp as j, any_value(a.condition) as ci, any_value(b.condition) as cj, sum((a.v - b.v) ** 2) as d from u a join u b on a.k = b.k and a.exp <> b.exp group by 1, 2), g as (select i, ci, cj, avg(d) as d from p group by i, ci, cj), s as (select i, min(case when ci = cj then d end) as a, min(case when ci <> cj then d end) as b from g group by i) select {q6('avg(case when a is null then 0 else (b - a) / greatest(a, b) end)')} as silhouette from s", "features")
def silhouette(spark, sf_dir):
    """Of the conditions as clusters, on squared distances, from sums alone: no pairs."""
    rows = features(spark, sf_dir).select(array_to_vector("f").alias("features"), F.col("condition").cast("double").alias("prediction"))
    return spark.createDataFrame([(round(ClusteringEvaluator().evaluate(rows), 6),)], "silhouette double")


CENTRES = f"{UNNESTED}, m as (select condition as label, k, avg(v) as c from u where plate < 2 group by condition, k), d as (select exp, plate, condition, label, sqrt(sum((v - c) ** 2)) as d from u join m using (k) group by exp, plate, condition, label), a as (select exp, plate, condition, label, d from d qualify row_number() over (partition by exp order by round(d, 9), label) = 1)"


def _assigned(spark, sf_dir):
    """exp, plate, condition, label, d: every experiment and the nearest centre of those stored from the first two plates."""
    rows = features(spark, sf_dir)
    centres = L.mean_vectors(rows.where("plate < 2"), ["condition"]).withColumnRenamed("condition", "label")
    return L.nearest(rows, centres, keep=["plate", "condition"])


@query("L22_farthest_points", f"{CENTRES} select label, exp, {q6('d')} as d from a qualify row_number() over (partition by label order by round(d, 9) desc, exp) = 1", "features")
def farthest_points(spark, sf_dir):
    """Of each cluster the point farthest from its centre: what an empty cluster would be given."""
    a = _assigned(spark, sf_dir)
    k = F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.round("d", 9)), "exp"))
    return a.withColumn("k", k).where("k = 1").select("label", "exp", r6(F.col("d")).alias("d"))


@query("L24_centres_by_kind", f"{UNNESTED} select condition, (k - 1)::int as i, {q6('avg(v)')} as mean, {q6('quantile_cont(v, 0.5)')} as median from u group by condition, k", "features")
def centres_by_kind(spark, sf_dir):
    """Centres for the Euclidean distance (means) and for total variation (medians)."""
    rows = C.long_features(features(spark, sf_dir), ["condition"])
    return rows.groupBy("condition", "i").agg(r6(F.avg("v")).alias("mean")).join(S.quantiles(rows, ["condition", "i"], "v", {"median": 0.5}), ["condition", "i"]).select("condition", "i", "mean", r6(F.col("median")).alias("median"))


@query("L29_assigned_to_stored_centres", f"{CENTRES} select exp, label, {q6('d')} as d from a where plate >= 2", "features")
def assigned_to_stored_centres(spark, sf_dir):
    return _assigned(spark, sf_dir).where("plate >= 2").select("exp", "label", r6(F.col("d")).alias("d"))


HITS = f"{EMPIRICAL}, r as (select *, least(1, p * count(*) over () / row_number() over (order by p, sirna)) as raw from e), q as (select sirna, gene, p, min(raw) over (order by p, sirna rows between current row and unbounded following) as q from r)"


@query("L30_high_confidence_genes", f"{HITS} select gene, count(*) as n, count(case when p < 0.4 and q < 0.95 then 1 end) as hits from q group by gene having count(case when p < 0.4 and q < 0.95 then 1 end) > 0.3 * count(*)", "screen")
def high_confidence_genes(spark, sf_dir):
    q = S.bh(_empirical(spark, sf_dir))
    return q.groupBy("gene").agg(F.count("*").alias("n"), F.count_if((F.col("p") < 0.4) & (F.col("q") < 0.95)).alias("hits")).where("hits > 0.3 * n")


@query("L32_histogram_matrix", f"{shares_sql('cls', 6)} select cls, bin, {q6('v')} as share from h", "objects")
def histogram_matrix(spark, sf_dir):
    return K.histograms(objects(spark, sf_dir), ["cls"], "x", 6).select("cls", F.posexplode("h").alias("bin", "v")).select("cls", "bin", r6(F.col("v")).alias("share"))


@query("L33_percents_of_clusters", f"{CENTRES} select plate, label, {q6('100 * count(*) / sum(count(*)) over (partition by plate)')} as percent from a group by plate, label", "features")
def percents_of_clusters(spark, sf_dir):
    n = _assigned(spark, sf_dir).groupBy("plate", "label").agg(F.count("*").alias("n"))
    return n.select("plate", "label", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy("plate"))).alias("percent"))


@query("L34_counts_of_clusters", f"{CENTRES} select label, count(*) as n from a group by label", "features")
def counts_of_clusters(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("L36_hit_frequency", "t as (select batch, quantile_cont(measure, 0.95) as t from screen where is_control group by batch), h as (select s.batch, gene, bool_or(measure > t) as hit from screen s join t using (batch) where not is_control group by s.batch, gene) select gene, count(*) as runs, count(case when hit then 1 end) as hits from h group by gene", "screen")
def hit_frequency(spark, sf_dir):
    """In how many of the runs a gene is a hit."""
    rows = screen(spark, sf_dir)
    t = S.quantiles(rows.where("is_control"), ["batch"], "measure", {"t": 0.95})
    h = rows.where(~F.col("is_control")).join(F.broadcast(t), "batch").groupBy("batch", "gene").agg(F.bool_or(F.col("measure") > F.col("t")).alias("hit"))
    return h.groupBy("gene").agg(F.count("*").alias("runs"), F.count_if("hit").alias("hits"))


@query("L43_listed_features", f"i as (select plate, count(*) as initial from objects where frame = 0 group by plate) select o.label, {q6('o.x')} as x, {q6('o.y')} as y, i.initial from objects o join i using (plate) where o.cls = 'purchase' and o.x is not null and o.y is not null", "objects")
def listed_features(spark, sf_dir):
    """The features of the objects of one class, without those that miss one, and the initial count of their plate."""
    rows = objects(spark, sf_dir)
    initial = rows.where("frame = 0").groupBy("plate").agg(F.count("*").alias("initial"))
    return rows.where("cls = 'purchase'").dropna(subset=["x", "y"]).join(F.broadcast(initial), "plate").select("label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "initial")


@query("L45_recall_and_precision", f"{CENTRES}, n as (select label, condition, count(*) as n from a group by all) select condition, {q6('max(case when label = condition then n end) / sum(n)')} as recall, {q6('max(case when label = condition then n end) / max(case when label = condition then t end)')} as precision from (select *, sum(n) over (partition by label) as t from n) group by condition", "features")
def recall_and_precision(spark, sf_dir):
    n = _assigned(spark, sf_dir).groupBy("label", "condition").agg(F.count("*").alias("n"))
    n = n.withColumn("t", F.sum("n").over(W.partitionBy("label")))
    own = F.max(F.when(F.col("label") == F.col("condition"), F.col("n")))
    return n.groupBy("condition").agg(r6(own / F.sum("n")).alias("recall"), r6(own / F.max(F.when(F.col("label") == F.col("condition"), F.col("t")))).alias("precision"))


@query("L46_second_screen", f"{CENTRES} select label, count(*) as n, {q6('avg(d)')} as mean, {q6('max(d)')} as largest from a where plate >= 3 group by label", "features")
def second_screen(spark, sf_dir):
    return _assigned(spark, sf_dir).where("plate >= 3").groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"), r6(F.max("d")).alias("largest"))


# ---- M: hits


@query("M02_validated_genes", f"{HITS}, s as (select gene, sirna, p < 0.4 and q < 0.95 as hit from q), g as (select gene, count(*) as n, count(case when hit then 1 end) as h from s group by gene) select gene, n, h as hits, h >= 0.5 * n as validated from g", "screen")
def validated_genes(spark, sf_dir):
    s = S.bh(_empirical(spark, sf_dir)).withColumn("hit", (F.col("p") < 0.4) & (F.col("q") < 0.95))
    return s.groupBy("gene").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("validated", F.col("hits") >= 0.5 * F.col("n"))


THIRDS = f"c as (select sirna, measure, ('0x' || substr({SEEDED('sirna', 15)}, 1, 6))::int % 3 as part from screen where is_control), g as (select p.part, avg(case when c.part <> p.part then measure end) as m from c, (select unnest([0, 1, 2]) as part) p group by p.part), s as (select e.gene, g.part::int as part, avg(e.measure) - any_value(g.m) as score from screen e, g where not e.is_control group by e.gene, g.part)"


def _thirds(spark, sf_dir):
    """gene, part, score: against the controls without one third, three times."""
    rows = screen(spark, sf_dir)
    part = F.conv(F.substring(samples.order("sirna", 15), 1, 6), 16, 10).cast("int") % 3
    c = rows.where("is_control").select("measure", part.alias("own")).groupBy("own").agg(F.sum("measure").alias("s"), F.count("*").alias("n"))
    left_out = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("part")
    g = c.select("own", "s", "n", left_out).where("own <> part").groupBy("part").agg((F.sum("s") / F.sum("n")).alias("m"))
    e = rows.where(~F.col("is_control")).groupBy("gene").agg(F.avg("measure").alias("e"))
    return e.crossJoin(F.broadcast(g)).select("gene", "part", (F.col("e") - F.col("m")).alias("score"))


@query("M07_three_scores", f"{THIRDS} select gene, part, {q6('score')} as score from s", "screen")
def three_scores(spark, sf_dir):
    return _thirds(spark, sf_dir).select("gene", "part", r6(F.col("score")).alias("score"))


@query("M08_stacked_scores", f"{THIRDS} select 'experiment' as kind, gene as name, {q6('median(score)')} as score from s group by gene union all select 'control', part::varchar, {q6('m')} from g", "screen")
def stacked_scores(spark, sf_dir):
    rows = screen(spark, sf_dir)
    part = F.conv(F.substring(samples.order("sirna", 15), 1, 6), 16, 10).cast("int") % 3
    c = rows.where("is_control").select("measure", part.alias("own")).groupBy("own").agg(F.sum("measure").alias("s"), F.count("*").alias("n"))
    g = c.select("s", "n", "own", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("part")).where("own <> part").groupBy("part").agg((F.sum("s") / F.sum("n")).alias("m"))
    e = _thirds(spark, sf_dir).groupBy("gene").agg(F.percentile("score", 0.5).alias("score"))
    return e.select(F.lit("experiment").alias("kind"), F.col("gene").alias("name"), r6(F.col("score")).alias("score")).union(g.select(F.lit("control"), F.col("part").cast("string"), r6(F.col("m"))))


ALIASES = {"shape_1": ("click", "view"), "shape_3": ("purchase",), "other": ("signup", "error")}


@query("M09_wide_scores", "select plate, " + ", ".join(f"{q6('count(case when cls in (' + ', '.join(map(repr, c)) + ') then 1 end) / count(*)')} as {n}" for n, c in ALIASES.items()) + " from objects group by plate", "objects")
def wide_scores(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate").agg(*[r6(F.count_if(F.col("cls").isin(*c)) / F.count("*")).alias(n) for n, c in ALIASES.items()])


@query("M10_ratios_by_control", f"c as (select sirna, is_control, batch, avg(measure) as v from screen group by all), r as (select sirna, bool_or(is_control) as is_control, arg_max(v, batch) / arg_min(v, batch) as r from c group by sirna) select is_control, count(*) as n, {q6('avg(r)')} as ratio from r group by is_control", "screen")
def ratios_by_control(spark, sf_dir):
    c = screen(spark, sf_dir).groupBy("sirna", "is_control", "batch").agg(F.avg("measure").alias("v"))
    r = c.groupBy("sirna").agg(F.bool_or("is_control").alias("is_control"), (F.max_by("v", "batch") / F.min_by("v", "batch")).alias("r"))
    return r.groupBy("is_control").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("ratio"))


@query("M12_sampled_curves", f"w as (select draw, label_, row_number() over (partition by draw order by md5(draw || ':' || label_), label_) as k from (select distinct label % 24 as label_ from objects), (select unnest(range(1, 6)) as draw)) select draw::int as draw, frame, {q6('count(case when cls = ' + repr('purchase') + ' then 1 end) / count(*)')} as fraction from objects join w on label % 24 = label_ where k <= 6 group by draw, frame", "objects")
def sampled_curves(spark, sf_dir):
    """Five draws of six wells: the fraction of a class in each frame, over all objects of the draw."""
    rows = objects(spark, sf_dir).withColumn("well", F.col("label") % 24)
    k = F.row_number().over(W.partitionBy("draw").orderBy(F.md5(F.concat_ws(":", "draw", "well").cast("binary")), "well"))
    drawn = rows.select("well").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("k", k).where("k <= 6")
    return rows.join(F.broadcast(drawn), "well").groupBy("draw", "frame").agg(r6(F.count_if(F.col("cls") == "purchase") / F.count("*")).alias("fraction"))


@query("M13_difference_of_controls", f"c as (select plate, frame, cls, count(*) / sum(count(*)) over (partition by plate, frame) as v from objects group by plate, frame, cls), d as (select a.cls, a.frame, round(a.v - b.v, 9) as d from c a join c b on a.frame = b.frame and a.cls = b.cls where a.plate = 1 and b.plate = 0) select cls, {q6('d')} as score from d qualify row_number() over (partition by cls order by abs(d) desc, frame) = 1", "objects")
def difference_of_controls(spark, sf_dir):
    n = objects(spark, sf_dir).where("plate < 2").groupBy("plate", "frame", "cls").agg(F.count("*").alias("n"))
    c = n.withColumn("v", F.col("n") / F.sum("n").over(W.partitionBy("plate", "frame"))).drop("n")
    return M.extremal_difference(c.where("plate = 1"), c.where("plate = 0").drop("plate"), ["cls"], ["frame", "cls"]).select("cls", r6(F.col("score")).alias("score"))


@query("M14_compound_and_dose", f"c as (select avg(measure) as c from screen where is_control), d as (select s.gene, w.size % 10 as dose, abs(s.measure - c) as d from screen s join wells w using (sirna), c where not s.is_control) select gene, dose, count(*) as n, {q6('avg(d)')} as difference from d group by gene, dose", "screen wells")
def compound_and_dose(spark, sf_dir):
    rows = screen(spark, sf_dir)
    c = rows.where("is_control").agg(F.avg("measure").alias("c"))
    doses = wells(spark, sf_dir).select("sirna", (F.col("size") % 10).alias("dose"))
    d = rows.where(~F.col("is_control")).join(doses, "sirna").crossJoin(F.broadcast(c))
    return d.groupBy("gene", "dose").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("measure") - F.col("c")))).alias("difference"))


@query("M16_scaled_rank_product", f"p as (select batch, sirna, max(measure) as v from screen group by batch, sirna), r as (select batch, sirna, 5.0 * row_number() over (partition by batch order by v, sirna) / count(*) over (partition by batch) as r from p) select sirna, count(*) as k, {q6('exp(sum(ln(r)))')} as product from r group by sirna", "screen")
def scaled_rank_product(spark, sf_dir):
    """Ranks of the largest replicate in each batch, over the batch's size, times five, multiplied over batches."""
    p = screen(spark, sf_dir).groupBy("batch", "sirna").agg(F.max("measure").alias("v"))
    batch = W.partitionBy("batch")
    r = p.withColumn("r", F.lit(5.0) * F.row_number().over(batch.orderBy("v", "sirna")) / F.count("*").over(batch))
    return r.groupBy("sirna").agg(F.count("*").alias("k"), r6(F.exp(F.sum(F.ln("r")))).alias("product"))


@query("M19_permutation_null", f"{NULL_RANKS} select run::int as run, count(*) as n, {q6('min(rp)')} as low, {q6('max(rp)')} as high from n group by run", "screen")
def permutation_null(spark, sf_dir):
    null = M.permuted_rank_products(screen(spark, sf_dir), "gene", "batch", RUNS, SEED)
    return null.groupBy("run").agg(F.count("*").alias("n"), r6(F.min("rank_product")).alias("low"), r6(F.max("rank_product")).alias("high"))


@query("M20_permutation_null_with_missing", f"""p as (select distinct batch, gene || '/' || sirna % 40 as gene from screen), q as (select run, batch, gene, row_number() over (partition by run, batch order by md5('{SEED}:' || run || ':' || batch || ':' || gene), gene) as r from p, (select unnest(range(1, 6)) as run)), z as (select run, batch, count(*) as n from q group by all),
g as (select s.run, s.gene, coalesce(q.r, z.n) as r from (select distinct run, gene from q) s join z on z.run = s.run left join q on q.run = s.run and q.batch = z.batch and q.gene = s.gene), n as (select run, gene, exp(sum(ln(r)) / count(*)) as rp from g group by run, gene) select run::int as run, count(*) as n, {q6('min(rp)')} as low, {q6('avg(rp)')} as mean from n group by run""", "screen")
def permutation_null_with_missing(spark, sf_dir):
    """A condition that a batch lacks has that batch's last rank."""
    rows = screen(spark, sf_dir).select("batch", F.concat_ws("/", "gene", F.col("sirna") % 40).alias("gene"))
    null = M.permuted_rank_products(rows, "gene", "batch", 5, SEED, missing=True)
    return null.groupBy("run").agg(F.count("*").alias("n"), r6(F.min("rank_product")).alias("low"), r6(F.avg("rank_product")).alias("mean"))


@query("M24_rank_product_of_distances", f"m as (select batch, avg(measure) as m from screen where is_control group by batch), d as (select s.batch, s.gene, avg(abs(s.measure - m)) as d from screen s join m using (batch) where not is_control group by s.batch, s.gene), r as (select gene, row_number() over (partition by batch order by d, gene) as r from d) select gene, {q6('exp(sum(ln(r)) / count(*))')} as rank_product from r group by gene", "screen")
def rank_product_of_distances(spark, sf_dir):
    """Ranks of the distance from the controls in each replicate."""
    rows = screen(spark, sf_dir)
    m = rows.where("is_control").groupBy("batch").agg(F.avg("measure").alias("m"))
    d = rows.where(~F.col("is_control")).join(F.broadcast(m), "batch").groupBy("batch", "gene").agg(F.avg(F.abs(F.col("measure") - F.col("m"))).alias("d"))
    return M.rank_product(d, "gene", "batch", "d", missing=False).select("gene", r6(F.col("rank_product")).alias("rank_product"))


@query("M25_rank_product_of_clusters", f"p as (select batch, sirna % 20 as cluster, median(measure) as v from screen group by all), r as (select cluster, row_number() over (partition by batch order by v, cluster) as r from p) select cluster, count(*) as k, {q6('exp(sum(ln(r)) / count(*))')} as rank_product from r group by cluster", "screen")
def rank_product_of_clusters(spark, sf_dir):
    rows = screen(spark, sf_dir).withColumn("cluster", F.col("sirna") % 20)
    return M.rank_product(rows, "cluster", "batch", "measure", missing=False).select("cluster", "k", r6(F.col("rank_product")).alias("rank_product"))


@query("M28_ranks_for_distances", "m as (select gene, median(measure) as a, avg(measure) as b from screen group by gene) select 'median' as distance, gene, row_number() over (order by a desc, gene)::int as rank from m union all select 'mean', gene, row_number() over (order by b desc, gene)::int from m", "screen")
def ranks_for_distances(spark, sf_dir):
    rows = screen(spark, sf_dir)
    m = S.quantiles(rows, ["gene"], "measure", {"a": 0.5}).select(F.lit("median").alias("distance"), "gene", "a").union(rows.groupBy("gene").agg(F.avg("measure").alias("a")).select(F.lit("mean"), "gene", "a"))
    return m.select("distance", "gene", F.row_number().over(W.partitionBy("distance").orderBy(F.desc("a"), "gene")).alias("rank"))


@query("M29_events_and_q", f"{HITS}, f as (select sirna, count(case when measure > 60000 then 1 end) / count(*) as fraction from screen group by sirna) select q.gene, count(*) as n, {q6('avg(fraction)')} as fraction, count(case when q.q < 0.95 and f.fraction >= 0.1 then 1 end) as hits from q join f using (sirna) group by q.gene", "screen")
def events_and_q(spark, sf_dir):
    q = S.bh(_empirical(spark, sf_dir))
    f = screen(spark, sf_dir).groupBy("sirna").agg((F.count_if(F.col("measure") > 60000) / F.count("*")).alias("fraction"))
    return q.join(f, "sirna").groupBy("gene").agg(F.count("*").alias("n"), r6(F.avg("fraction")).alias("fraction"), F.count_if((F.col("q") < 0.95) & (F.col("fraction") >= 0.1)).alias("hits"))


# ---- N, O: hypotheses, links, accuracy

HYPOTHESES = f"{NEXT}, e as (select 'move' as event, plate, frame, label, to_label from c union all select 'disappear', plate, frame, label, null from objects union all select 'appear', plate, frame - 1, null, label from objects)"


@query("N07_hypotheses_of_pair", f"{HYPOTHESES} select plate, frame, event, count(*) as n from e group by plate, frame, event", "objects")
def hypotheses_of_pair(spark, sf_dir):
    rows = objects(spark, sf_dir)
    moves = _place_pairs(spark, sf_dir).groupBy("plate", "frame", F.lit("move").alias("event")).agg(F.sum(F.col("n") * F.col("to_n")).alias("n"))
    alone = lambda frame, event: rows.groupBy("plate", frame.alias("frame"), F.lit(event).alias("event")).agg(F.count("*").alias("n"))
    return moves.union(alone(F.col("frame"), "disappear")).union(alone(F.col("frame") - 1, "appear"))


@query("N09_incidence", f"{HYPOTHESES}, i as (select label as object, 'source' as side from e where label is not null union all select to_label, 'target' from e where to_label is not null) select object, side, count(*) as hypotheses from i group by object, side", "objects")
def incidence(spark, sf_dir):
    """A row of the constraint matrix for each object and side: in how many hypotheses it is (its candidates, and that it appears or disappears)."""
    rows = objects(spark, sf_dir).select("plate", "frame", "x", "y", "label").where("label is not null")
    pairs = _place_pairs(spark, sf_dir)
    out = pairs.groupBy("plate", "frame", "x", "y").agg(F.sum("to_n").alias("source"))
    into = pairs.groupBy("plate", (F.col("frame") + 1).alias("frame"), F.col("to_x").alias("x"), F.col("to_y").alias("y")).agg(F.sum("n").alias("target"))
    rows = rows.join(out, ["plate", "frame", "x", "y"], "left").join(into, ["plate", "frame", "x", "y"], "left")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.coalesce(s, F.lit(0)) + 1).alias("n")) for s in ("source", "target")])
    return rows.select(F.col("label").alias("object"), F.explode(sides).alias("s")).groupBy("object", "s.side").agg(F.sum("s.n").alias("hypotheses"))


@query("N10_truth_vector", f"{MUTUAL} select c.label, c.to_label, (case when l.label is not null then 1 else 0 end)::int as truth from c left join l using (label, to_label)", "objects")
def truth_vector(spark, sf_dir):
    return _linked(spark, sf_dir).select("label", "to_label", F.coalesce((F.col("link") == F.col("to_label")).cast("int"), F.lit(0)).alias("truth"))


@query("N11_frame_pairs", f"{NEXT} select plate, frame, (frame + 1)::int as next_frame, count(*) as candidates, count(distinct label) as sources from c group by plate, frame", "objects")
def frame_pairs(spark, sf_dir):
    spots = _place_pairs(spark, sf_dir).groupBy("plate", "frame", "x", "y").agg(F.sum("to_n").alias("to_n"), F.first("n").alias("n"))
    return spots.groupBy("plate", "frame", (F.col("frame") + 1).alias("next_frame")).agg(F.sum(F.col("n") * F.col("to_n")).alias("candidates"), F.sum("n").alias("sources"))


WEIGHTS = (-1.0, -0.5, 2.0)
SCORED = f"o as (select label, cls from objects), {NEXT}, f as (select c.*, a.cls = b.cls as same, round({WEIGHTS[0]} * d + {WEIGHTS[1]} * abs(c.to_label - c.label) / 1000 + {WEIGHTS[2]} * (case when a.cls = b.cls then 1 else 0 end), 9) as score from c join o a using (label) join o b on b.label = c.to_label), n as (select *, row_number() over (partition by plate, frame, label order by score desc, to_label) as k from f)"


#: Labels that the rounds of _predicted reach to; a last round reaches to all.
REACH = (8_000, 16_000, 64_000, 512_000)


def _predicted(spark, sf_dir):
    """The best hypothesis of every source by weights times features. A round meets the targets whose labels are in reach of the source's, or of the
    end of the frame's labels that is next to it, and as near as to lose no more by their distance; what lies beyond scores so little for one of both that a better
    one in reach is the best of all. The few sources without one go to the next round."""
    rows = stored(objects(spark, sf_dir).select("plate", "frame", "label", "x", "y", "cls"), "objects")
    targets, out = A.next_frame(rows, ["plate"]), []
    ends = stored(targets.groupBy("plate", "frame").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "ends")
    targets = targets.join(ends, ["plate", "frame"])
    at = F.when(F.col("label").isNotNull(), F.least(F.greatest("label", "lo"), "hi"))
    left = rows.join(ends, ["plate", "frame"]).withColumn("at", at).withColumn("off", F.abs(F.col("label") - F.col("at")))
    after = lambda v: F.col(v) - F.col("lo") - 1  # noqa: E731  a band ends where a frame's labels begin
    for reach in (*REACH, None):
        band = F.floor(after("at") / (2 * reach)) if reach else F.lit(0).cast("bigint")
        near = A.reached(after("label"), reach, 2 * reach) if reach else F.array(band)
        radius = min(RADIUS, WEIGHTS[1] * reach / 1000 / WEIGHTS[0]) if reach else RADIUS
        to = targets.select("plate", "frame", F.explode(near).alias("band"), "x", "y", F.col("label").alias("to_label"), F.col("cls").alias("to_cls"))
        pairs = A.meeting(left.withColumn("band", band), to, ["plate", "frame", "band"], radius, ["label", "cls", "off"], ["to_label", "to_cls"])
        values = (F.col("d"), F.abs(F.col("to_label") - F.col("label")) / 1000, (F.col("cls") == F.col("to_cls")).cast("int"))
        score = F.round(sum(w * v for w, v in zip(WEIGHTS, values, strict=True)), 9)
        if reach:  # what scores less has rivals out of reach
            pairs = pairs.where(score > WEIGHTS[2] + WEIGHTS[1] * (reach + F.col("off")) / 1000 + 1e-6)
        best = F.max(F.struct(score.alias("score"), (-F.col("to_label")).alias("less"), "to_cls", "d")).alias("best")
        # a source's pairs lie together already, so that this needs no further shuffle
        got = pairs.groupBy("plate", "frame", "band", "cx", "cy", "x", "y", "label", "cls").agg(best)
        got = got.select("plate", "frame", "label", "x", "y", "cls", (-F.col("best.less")).alias("to_label"), "best.to_cls", "best.d", "best.score").withColumn("same", F.col("cls") == F.col("to_cls"))
        if reach:
            got = stored(got, "predicted")
            left = left.join(got.select("plate", "frame", "label"), ["plate", "frame", "label"], "left_anti")
        out.append(got)
    return reduce(DataFrame.unionByName, out)


@query("N12_scored_hypotheses", f"{SCORED} select label, to_label, {q6('score')} as score from n where k = 1", "objects")
def scored_hypotheses(spark, sf_dir):
    return _predicted(spark, sf_dir).select("label", "to_label", r6(F.col("score")).alias("score"))


ACCURACY = f"{SCORED}, m as (select *, row_number() over (partition by plate, frame, label order by d, to_label) as ka, row_number() over (partition by plate, frame, to_label order by d, label) as kb from c), l as (select label, to_label from m where ka = 1 and kb = 1), t as (select f.plate, f.frame, f.same, case when l.label is null then 0 else 1 end as y, case when n.k = 1 then 1 else 0 end as z from f left join l using (label, to_label) join n using (plate, frame, label, to_label))"


def _linked(spark, sf_dir):
    """Candidates, with the target of the source's link: it is looked up for objects, not for their pairs."""
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y")
    links = _links(spark, sf_dir).select("plate", "frame", "label", F.col("to_label").alias("link"))
    return A.within_radius(rows.join(links, ["plate", "frame", "label"], "left"), A.next_frame(rows, ["plate"]), ["plate", "frame"], RADIUS, own=["link"])


def _judged(spark, sf_dir):
    """plate, frame, same, and how many candidates there are, how many are true, predicted, and both (correct). Candidates are counted by pairs of
    places and classes; true and predicted ones are at most one for each object."""
    at = ["plate", "frame", "same"]
    same = F.col("cls") == F.col("to_cls")
    every = _place_pairs(spark, sf_dir, ["cls"]).groupBy("plate", "frame", same.alias("same")).agg(F.sum(F.col("n") * F.col("to_n")).alias("candidates"))
    truth = _links(spark, sf_dir).select("plate", "frame", "label", "to_label", same.alias("same"), F.lit(1).alias("y"), F.lit(0).alias("z"))
    best = _predicted(spark, sf_dir).select("plate", "frame", "label", "to_label", "same", F.lit(0).alias("y"), F.lit(1).alias("z"))
    marks = truth.union(best).groupBy(*at, "label", "to_label").agg(F.max("y").alias("y"), F.max("z").alias("z"))
    marks = marks.groupBy(*at).agg(F.sum("y").alias("truth"), F.sum("z").alias("predicted"), F.sum(F.col("y") * F.col("z")).alias("correct"))
    marks = marks.withColumn("candidates", F.lit(0).cast("bigint"))
    none = [F.lit(0).cast("bigint").alias(c) for c in ("truth", "predicted", "correct")]
    return every.select(*at, "candidates", *none).unionByName(marks).groupBy(*at).agg(*[F.sum(c).alias(c) for c in ("candidates", "truth", "predicted", "correct")])


@query("N17_correct_by_event", f"{ACCURACY} select same, sum(y * z)::bigint as correct from t group by same", "objects")
def correct_by_event(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("same").agg(F.sum("correct").alias("correct"))


@query("N18_truth_by_event", f"{ACCURACY} select same, sum(y)::bigint as truth from t group by same", "objects")
def truth_by_event(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("same").agg(F.sum("truth").alias("truth"))


@query("N19_percent_by_event", f"{ACCURACY} select coalesce(same::varchar, 'all') as event, {q6('100 * sum(y * z) / nullif(sum(y), 0)')} as percent from t group by rollup (same)", "objects")
def percent_by_event(spark, sf_dir):
    return _judged(spark, sf_dir).rollup("same").agg(r6(100 * F.sum("correct") / F.nullif(F.sum("truth"), F.lit(0))).alias("percent")).select(F.coalesce(F.col("same").cast("string"), F.lit("all")).alias("event"), "percent")


@query("N20_training_loss", f"{ACCURACY} select plate, {q6('1 - sum(y * z) / nullif(sum(y), 0)')} as loss from t group by plate", "objects")
def training_loss(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("plate").agg(r6(1 - F.sum("correct") / F.nullif(F.sum("truth"), F.lit(0))).alias("loss"))


@query("N24_inner_folds", "f as (select distinct frame, frame % 5 as outer_fold from objects) select outer_fold::int as outer_fold, frame, (row_number() over (partition by outer_fold order by frame) % 3)::int as inner_fold from f", "objects")
def inner_folds(spark, sf_dir):
    f = objects(spark, sf_dir).select("frame").distinct().withColumn("outer_fold", F.col("frame") % 5)
    return f.select("outer_fold", "frame", (F.row_number().over(W.partitionBy("outer_fold").orderBy("frame")) % 3).alias("inner_fold"))


@query("N26_predicted_frames", f"{SCORED}, g as (select distinct plate, frame from objects) select g.plate, g.frame, count(n.label) as links, count(n.label) = 0 as failed from g left join n on n.plate = g.plate and n.frame = g.frame and n.k = 1 group by 1, 2", "objects")
def predicted_frames(spark, sf_dir):
    """Every frame with its links; frames for which nothing is predicted are marked."""
    n = _predicted(spark, sf_dir).groupBy("plate", "frame").agg(F.count("*").alias("links"))
    every = objects(spark, sf_dir).select("plate", "frame").distinct()
    return every.join(n, ["plate", "frame"], "left").select("plate", "frame", F.coalesce("links", F.lit(0)).alias("links"), F.col("links").isNull().alias("failed"))


@query("N27_predicted_by_batch", f"{SCORED} select plate, (frame // 10)::bigint as batch, count(*) as links from n where k = 1 group by 1, 2", "objects")
def predicted_by_batch(spark, sf_dir):
    return _predicted(spark, sf_dir).groupBy("plate", F.floor(F.col("frame") / 10).alias("batch")).agg(F.count("*").alias("links"))


@query("N30_source_and_target_lists", f"{MUTUAL} select plate, frame, string_agg(label::varchar, ',' order by label) as sources, string_agg(to_label::varchar, ',' order by label) as targets from l group by plate, frame", "objects")
def source_and_target_lists(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("label", "to_label")))
    joined = lambda c: F.array_join(F.transform(ordered, lambda s: s[c].cast("string")), ",")
    return _links(spark, sf_dir).groupBy("plate", "frame").agg(joined("label").alias("sources"), joined("to_label").alias("targets"))


@query("N31_recall_and_precision", f"{ACCURACY} select coalesce(same::varchar, 'all') as event, {q6('sum(y * z) / nullif(sum(y), 0)')} as recall, {q6('sum(y * z) / nullif(sum(z), 0)')} as precision from t group by rollup (same)", "objects")
def link_recall_and_precision(spark, sf_dir):
    both = F.sum("correct")
    rows = _judged(spark, sf_dir).rollup("same").agg(r6(both / F.nullif(F.sum("truth"), F.lit(0))).alias("recall"), r6(both / F.nullif(F.sum("predicted"), F.lit(0))).alias("precision"))
    return rows.select(F.coalesce(F.col("same").cast("string"), F.lit("all")).alias("event"), "recall", "precision")


@query("N33_against_other_tracker", f"{ACCURACY} select y::int as mutual, z::int as scored, count(*) as n from t group by y, z", "objects")
def against_other_tracker(spark, sf_dir):
    c = {c: F.sum(c) for c in ("candidates", "truth", "predicted", "correct")}
    cells = {(1, 1): c["correct"], (1, 0): c["truth"] - c["correct"], (0, 1): c["predicted"] - c["correct"], (0, 0): c["candidates"] - c["truth"] - c["predicted"] + c["correct"]}
    table = F.array(*[F.struct(F.lit(y).alias("mutual"), F.lit(z).alias("scored"), n.alias("n")) for (y, z), n in cells.items()])
    return _judged(spark, sf_dir).agg(table.alias("cells")).select(F.inline("cells")).where("n > 0")


@query("N03_in_and_out_codes", f"{MUTUAL} select o.label, (case when a.label is null then 0 else 1 end)::int as outgoing, (case when b.to_label is null then 0 else 1 end)::int as incoming from objects o left join l a on a.label = o.label left join l b on b.to_label = o.label", "objects")
def in_and_out_codes(spark, sf_dir):
    """0 none, 1 move: what an object's link to the next frame is, and that from the frame before."""
    links = _links(spark, sf_dir).select("label", "to_label")
    out, into = links.select("label", F.lit(1).alias("outgoing")), links.select(F.col("to_label").alias("label"), F.lit(1).alias("incoming"))
    return objects(spark, sf_dir).select("label").join(out, "label", "left").join(into, "label", "left").fillna(0, ["outgoing", "incoming"])


@query("O03_collected_tracks", f"{MUTUAL}, t as (select label, label as track, 0 as position from l where label not in (select to_label from l) union all select l.to_label, t.track, t.position + 1 from t join l on l.label = t.label) select track, count(*) as n, max(label) as last from t group by track", "objects")
def collected_tracks(spark, sf_dir):
    return A.chains(_links(spark, sf_dir), scratch(spark)).groupBy("track").agg(F.count("*").alias("n"), F.max_by("label", "position").alias("last"))


@query("O05_source_and_target_tuples", "a as (select plate, track_id, frame, lead(frame) over (partition by track_id order by frame) as next_frame from track_points) select plate, frame, count(*) as sources, count(next_frame) as targets, string_agg(track_id::varchar, ',' order by track_id) as ids from a group by plate, frame", "track_points")
def source_and_target_tuples(spark, sf_dir):
    a = track_points(spark, sf_dir).select("plate", "track_id", "frame", F.lead("frame").over(W.partitionBy("track_id").orderBy("frame")).alias("next_frame"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("track_id")), lambda v: v.cast("string")), ",")
    return a.groupBy("plate", "frame").agg(F.count("*").alias("sources"), F.count("next_frame").alias("targets"), ids.alias("ids"))


@query("P02_objective_by_channel", f"select cls, {q6('case when cls = ' + repr('view') + ' then avg(x) when cls = ' + repr('click') + ' then max(y) else min(x) end')} as v from objects group by cls", "objects")
def objective_by_channel(spark, sf_dir):
    objective = F.when(F.col("cls") == "view", F.avg("x")).when(F.col("cls") == "click", F.max("y")).otherwise(F.min("x"))
    return objects(spark, sf_dir).groupBy("cls").agg(r6(objective).alias("v"))


# ---- Q, R: layout and simulation

NEAR = "abs((a.position - 1) // 12 - (b.position - 1) // 12) <= 1 and abs((a.position - 1) % 12 - (b.position - 1) % 12) <= 1 and a.position <> b.position"


@query("Q02_union_of_neighbourhoods", f"b as (select unnest(range(1, 385)) as position) select distinct b.position from b, wells a where a.size > 46 and {NEAR}", "wells")
def union_of_neighbourhoods(spark, sf_dir):
    return Q.neighbours(wells(spark, sf_dir).where("size > 46")).select(F.col("neighbour").alias("position")).distinct()


@query("Q04_random_hits_isolated", f"h as (select position from (select distinct position from wells) order by {SEEDED('position', 19)}, position limit 30) select a.position, exists (select 1 from h b where {NEAR}) as has_neighbour from h a", "wells")
def random_hits_isolated(spark, sf_dir):
    return Q.isolated(samples.first_n(wells(spark, sf_dir).select("position").distinct(), "position", 30, 19), [])


@query("Q08_isolated_references", f"h as (select distinct position from wells where size < 4) select a.position, exists (select 1 from h b where {NEAR}) as has_neighbour from h a", "wells")
def isolated_references(spark, sf_dir):
    return Q.isolated(wells(spark, sf_dir).where("size < 4"), [])


@query("Q09_manual_and_automatic", "a as (select distinct sirna from screen where measure > 80000), m as (select sirna from wells where size > 30) select coalesce(a.sirna, m.sirna) as sirna, case when a.sirna is null then 'manual' when m.sirna is null then 'automatic' else 'both' end as kind from a full join m using (sirna)", "screen wells")
def manual_and_automatic(spark, sf_dir):
    a = screen(spark, sf_dir).where("measure > 80000").select("sirna").distinct().withColumn("a", F.lit(1))
    m = wells(spark, sf_dir).where("size > 30").select("sirna").withColumn("m", F.lit(1))
    return a.join(m, "sirna", "full").select("sirna", F.when(F.col("a").isNull(), "manual").when(F.col("m").isNull(), "automatic").otherwise("both").alias("kind"))


@query("R01_simulated_screen", f"select sirna, r as replicate, ({'sirna'} * 3 + r) % 132 as plate, md5('41:' || sirna) < '2' as is_hit from wells, (select unnest([1, 2, 3]) as r)", "wells")
def simulated_screen(spark, sf_dir):
    """132 plates: the library in three replicates, an eighth of it hits in all of them."""
    rows = wells(spark, sf_dir).select("sirna", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("replicate"))
    return rows.select("sirna", "replicate", ((F.col("sirna") * 3 + F.col("replicate")) % 132).alias("plate"), (samples.order("sirna", 41) < "2").alias("is_hit"))


@query("R02_layout_with_controls", "select layout, position, r as replicate, position in (15, 26, 63, 99, 200) as is_control from (select distinct sirna // 384 as layout from wells), (select unnest(range(1, 385)) as position), (select unnest([1, 2, 3]) as r)", "wells")
def layout_with_controls(spark, sf_dir):
    rows = wells(spark, sf_dir).select(F.floor(F.col("sirna") / 384).alias("layout")).distinct()
    rows = rows.withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(384).cast("bigint")))).withColumn("replicate", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.withColumn("is_control", F.col("position").isin(15, 26, 63, 99, 200))


MOVEMENTS = (("switch", "33"), ("ballistic", "66"), ("confined", "99"), ("fast", "cc"), ("normal", "g"))


@query("R03_movement_types", "select track_id, case " + " ".join(f"when md5('43:' || track_id) < '{edge}' then '{kind}'" for kind, edge in MOVEMENTS) + " end as kind from (select distinct track_id from track_points)", "track_points")
def movement_types(spark, sf_dir):
    """A movement type for each track, drawn from fixed shares."""
    kind = F.lit(None).cast("string")
    for name, edge in reversed(MOVEMENTS):
        kind = F.when(samples.order("track_id", 43) < edge, name).otherwise(kind)
    return track_points(spark, sf_dir).select("track_id").distinct().select("track_id", kind.alias("kind"))


@query("R08_hits_against_truth", f"{EMPIRICAL} select md5('41:' || sirna) < '2' as truth, p < 0.05 as called, count(*) as n from e group by 1, 2", "screen")
def hits_against_truth(spark, sf_dir):
    return _empirical(spark, sf_dir).groupBy((samples.order("sirna", 41) < "2").alias("truth"), (F.col("p") < 0.05).alias("called")).agg(F.count("*").alias("n"))
