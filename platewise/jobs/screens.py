"""Screen queries: lookups, rankings, sets, statistics, distances, clusters, hits, layout (letters D, G, H, J, K, L, M, Q and R)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.model import features, objects, q6, query, r6, screen, table, wells
from platewise.operators import clusters as L
from platewise.operators import distances as K
from platewise.operators import hits as M
from platewise.operators import layout as Q
from platewise.operators import samples
from platewise.operators import smoothing
from platewise.operators import statistics as S

# ---- D: lookups


@query("D01_sirna_of_experiment", "select sirna, count(*) as n, min(plate) as first_plate from screen where batch >= 1994 group by sirna", "screen")
def sirna_of_experiment(spark, sf_dir):
    return screen(spark, sf_dir).where("batch >= 1994").groupBy("sirna").agg(F.count("*").alias("n"), F.min("plate").alias("first_plate"))


@query("D03_last_write_wins", "select gene, arg_max(sirna, sirna) as sirna from wells group by gene", "wells")
def last_write_wins(spark, sf_dir):
    return wells(spark, sf_dir).groupBy("gene").agg(F.max_by("sirna", "sirna").alias("sirna"))


@query("D04_three_hop_lookup", "select n_name as nation, p_brand as gene, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by n_name, p_brand")
def three_hop_lookup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # counted by the small keys first, then named: the fact table is shuffled once, as partial counts
    n = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    rows = n.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("p_brand").alias("gene")).agg(F.sum("n").alias("n"))


@query("D08_without_raw_data", "select p_partkey as sirna from part where p_partkey not in (select l_partkey from lineitem where year(l_shipdate) = 1995)")
def without_raw_data(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == 1995).select(F.col("l_partkey").alias("sirna"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sirna")).join(raw, "sirna", "left_anti")


@query("D17_tracks_alive_per_day", "t as (select user_id, min(ts::date) as a, max(ts::date) as z from events group by user_id), e as (select unnest(generate_series(0, date_diff('day', a, z) - 1)) + date_diff('day', date '2024-01-01', a) as day from t) select day::int as day, count(*) as alive from e group by day")
def tracks_alive_per_day(spark, sf_dir):
    """Counted from the starts and the ends: no row for every track and day."""
    day = F.datediff("ts", F.lit("2024-01-01"))
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(day).alias("a"), F.max(day).alias("z")).where("z > a")
    change = t.select(F.col("a").alias("day"), F.lit(1).alias("c")).union(t.select("z", F.lit(-1))).groupBy("day").agg(F.sum("c").alias("c"))
    alive = change.select("day", F.sum("c").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("alive"), F.lead("day").over(W.orderBy("day")).alias("next"))
    return alive.where("next is not null and alive > 0").select(F.explode(F.sequence("day", F.col("next") - 1)).alias("day"), "alive")


@query("D21_prefix_lookup", "select p_partkey as sirna, b.gene from part join (select distinct p_brand as gene from part) b on starts_with(p_brand, substr(b.gene, 1, 7)) and p_brand <= b.gene")
def prefix_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sirna"), F.col("p_brand").alias("own"), F.substring("p_brand", 1, 7).alias("prefix"))
    genes = parts.select(F.col("own").alias("gene"), "prefix").distinct()
    return parts.join(genes, "prefix").where("own <= gene").select("sirna", "gene")


@query("D25_grid_with_missing", "g as (select unnest(range(1, 385)) as position), v as (select position, count(*) as n, sum(size)::bigint as s from wells where size > 25 group by position) select position, coalesce(n, -1) as n, coalesce(s, -2) as s from g left join v using (position)", "wells")
def grid_with_missing(spark, sf_dir):
    v = wells(spark, sf_dir).where("size > 25").groupBy("position").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    return spark.range(1, 385).withColumnRenamed("id", "position").join(v, "position", "left").select("position", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("s", F.lit(-2)).alias("s"))


@query("D27_best_sirna_of_gene", f"m as (select gene, sirna, median(measure) as d, count(*) as n from screen group by gene, sirna having count(*) >= 2) select gene, sirna, {q6('d')} as score from m qualify row_number() over (partition by gene order by d, sirna) = 1", "screen")
def best_sirna_of_gene(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("gene", "sirna").agg(F.percentile("measure", 0.5).alias("d"), F.count("*").alias("n")).where("n >= 2")
    best = m.groupBy("gene").agg(F.min(F.struct("d", "sirna")).alias("b"))
    return best.select("gene", "b.sirna", r6(F.col("b.d")).alias("score"))


@query("D28_phenotypes_of_gene", "select p_brand as gene, string_agg(distinct p_type, ',' order by p_type) as types, count(distinct p_type) as n from part group by p_brand")
def phenotypes_of_gene(spark, sf_dir):
    types = F.array_sort(F.collect_set("p_type"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.array_join(types, ",").alias("types"), F.size(types).cast("bigint").alias("n"))


# ---- G, H: rankings and sets


@query("G01_extreme_in_both", "m as (select sirna, avg(measure) as a, max(measure) as b from screen group by sirna), t as (select quantile_cont(a, 0.9) as ta, quantile_cont(b, 0.9) as tb from m) select sirna from m, t where a >= ta intersect select sirna from m, t where b >= tb", "screen")
def extreme_in_both(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("sirna").agg(F.avg("measure").alias("a"), F.max("measure").alias("b"))
    ta, tb = (S.quantiles(m, [], c, {f"t{c}": 0.9}) for c in "ab")
    return m.crossJoin(F.broadcast(ta)).crossJoin(F.broadcast(tb)).where("a >= ta and b >= tb").select("sirna")


@query("G05_ambiguous_phenotypes", "select p_brand as gene, case when count(distinct p_type) > 3 then 'NO' else min(p_type) end as phenotype from part group by p_brand")
def ambiguous_phenotypes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.count_distinct("p_type").alias("k"), F.min("p_type").alias("t"))
    return rows.select("gene", F.when(F.col("k") > 3, "NO").otherwise(F.col("t")).alias("phenotype"))


@query("H04_distinct_positions", "select distinct position from wells where sirna % 5 <> 2", "wells")
def distinct_positions(spark, sf_dir):
    return wells(spark, sf_dir).where("sirna % 5 <> 2").select("position").distinct()


@query("H05_positions_of_gene", "select gene, count(distinct position) as n, string_agg(distinct position::varchar, ',' order by position::varchar) as positions from wells group by gene", "wells")
def positions_of_gene(spark, sf_dir):
    p = F.array_sort(F.collect_set(F.col("position").cast("string")))
    return wells(spark, sf_dir).groupBy("gene").agg(F.size(p).cast("bigint").alias("n"), F.array_join(p, ",").alias("positions"))


@query("H07_agreement_ratio", f"c as (select cls, plate, count(*) as n from objects group by cls, plate), m as (select cls, max(n) as m, sum(n) as s from c group by cls) select {q6('sum(m) / sum(s)')} as agreement from m", "objects")
def agreement_ratio(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("cls", "plate").agg(F.count("*").alias("n")).groupBy("cls").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return c.agg(r6(F.sum("m") / F.sum("s")).alias("agreement"))


@query("H09_in_both_stores", "select doc_id from documents intersect select doc_id from labels")
def in_both_stores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


# ---- J: statistics

KS_SQL = """c as (select gene, v, sum(mine) as a, sum(1 - mine) as b from u group by gene, v), k as (select gene, sum(a) over w as ca, sum(b) over w as cb, sum(a) over z as n1, sum(b) over z as n2 from c window w as (partition by gene order by v rows unbounded preceding), z as (partition by gene)),
t as (select gene, n1::double as n1, n2::double as n2, max(abs(ca / n1 - cb / n2)) as d from k where n1 > 0 and n2 > 0 group by gene, n1, n2)"""
UNION_SQL = "pool as (select measure as v from screen where is_control), u as (select gene, measure as v, 1 as mine from screen where not is_control union all select g.gene, v, 0 from (select distinct gene from screen where not is_control) g, pool)"


def _both(spark, sf_dir):
    rows = screen(spark, sf_dir)
    return S.against_pool(rows.where(~F.col("is_control")), rows.where("is_control"), ["gene"], "measure")


@query("J01_ks_by_gene", f"{UNION_SQL}, {KS_SQL}, p as (select *, {X.kolmogorov_sf_sql('((sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d)')} as p from t) select gene, n1::bigint as n1, n2::bigint as n2, {q6('d')} as d, {q6('p')} as p from p", "screen")
def ks_by_gene(spark, sf_dir):
    return S.kolmogorov_smirnov(_both(spark, sf_dir), ["gene"]).select("gene", "n1", "n2", r6(F.col("d")).alias("d"), r6(F.col("p")).alias("p"))


RANK_SQL = f"""{UNION_SQL}, c as (select gene, v, sum(mine) as a, count(*) as t from u group by gene, v), r as (select *, coalesce(sum(t) over (partition by gene order by v rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2 as r from c),
s as (select gene, sum(a)::double as n1, sum(t)::double as n, sum(a * r) as w, sum(t::double ** 3 - t) as tie from r group by gene)"""


@query("J25_rank_sum_by_gene", f"{RANK_SQL}, z as (select gene, n1, n - n1 as n2, (w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1)) as z from s) select gene, n1::bigint as n1, n2::bigint as n2, {q6('z')} as z, {q6('least(1, 2 * (' + X.normal_sf_sql('abs(z)') + '))')} as p from z", "screen")
def rank_sum_by_gene(spark, sf_dir):
    return S.rank_sum(_both(spark, sf_dir), ["gene"]).select("gene", "n1", "n2", r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


@query("J01_mann_whitney_by_gene", f"{RANK_SQL}, o as (select *, n - n1 as n2, w - n1 * (n + 1) / 2 as d from s), z as (select gene, sign(d) * greatest(0, abs(d) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))) as z from o) select gene, {q6('z')} as z, {q6('least(1, 2 * (' + X.normal_sf_sql('abs(z)') + '))')} as p from z", "screen")
def mann_whitney_by_gene(spark, sf_dir):
    return S.rank_sum(_both(spark, sf_dir), ["gene"], ties=True).select("gene", r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


MEAN = "m as (select sirna, gene, bool_or(is_control) as is_control, avg(measure) as v from screen group by sirna, gene)"
#: Means that are compared with one another are sums of whole millionths over their number: means of equal measures are equal in any order of summation.
EXACT = MEAN.replace("avg(measure) as v", "sum(round(measure * 1e6)::bigint)::double / (1e6 * count(measure)) as v")
EMPIRICAL = f"{EXACT}, c as (select v from m where is_control), e as (select sirna, gene, v, (1 + (select count(*) from c where c.v >= m.v)) / (1 + (select count(*) from c)) as p from m where not is_control)"


def _means(spark, sf_dir):
    return screen(spark, sf_dir).groupBy("sirna", "gene").agg(F.bool_or("is_control").alias("is_control"), F.avg("measure").alias("v"))


def _empirical(spark, sf_dir):
    """p of each siRNA: the share of controls whose mean is as large. Means are exact to the millionth, so that equal ones are ties."""
    mean = F.sum(F.round(F.col("measure") * 1e6).cast("long")).cast("double") / (F.count("measure") * 1e6)
    m = screen(spark, sf_dir).groupBy("sirna", "gene").agg(F.bool_or("is_control").alias("is_control"), mean.alias("v"))
    return S.empirical_p(m.where(~F.col("is_control")), m.where("is_control"), "v", "v")


@query("J02_empirical_p_and_q", f"{EMPIRICAL}, r as (select *, least(1, p * count(*) over () / row_number() over (order by p, sirna)) as raw from e) select sirna, {q6('p')} as p, {q6('min(raw) over (order by p, sirna rows between current row and unbounded following)')} as q from r", "screen")
def empirical_p_and_q(spark, sf_dir):
    return S.bh(_empirical(spark, sf_dir)).select("sirna", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


@query("J14_fisher_combination", f"{EMPIRICAL}, s as (select gene, count(*) as m, sum(-2 * ln(p)) as x from e group by gene) select gene, m, {q6('x')} as statistic, {q6('list_sum(list_transform(range(0, m), lambda i: exp(i * ln(x / 2) - lgamma(i + 1) - x / 2)))')} as p from s", "screen")
def fisher_combination(spark, sf_dir):
    s = _empirical(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("m"), F.sum(-2 * F.ln("p")).alias("x"))
    return s.select("gene", "m", r6(F.col("x")).alias("statistic"), r6(X.chi2_sf_even(F.col("x"), F.col("m"))).alias("p"))


@query("J20_conservative_q", f"{EMPIRICAL} select sirna, {q6('p * count(*) over () / row_number() over (order by p, sirna)')} as q from e", "screen")
def conservative_q(spark, sf_dir):
    e = S.row_numbers(_empirical(spark, sf_dir), "p", "sirna")
    return e.select("sirna", r6(F.col("p") * F.col("all_rows") / F.col("row")).alias("q"))


@query("J06_spearman_by_plate", f"m as (select plate, sirna, avg(measure) as a, stddev_pop(measure) as b from screen group by plate, sirna), r as (select plate, rank() over (partition by plate order by a) + (count(*) over (partition by plate, a) - 1) / 2 as ra, rank() over (partition by plate order by b) + (count(*) over (partition by plate, b) - 1) / 2 as rb from m) select plate, count(*) as n, {q6('corr(ra, rb)')} as rho from r group by plate", "screen")
def spearman_by_plate(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("plate", "sirna").agg(F.avg("measure").alias("a"), F.stddev_pop("measure").alias("b"))
    return S.spearman(m, ["plate"], "a", "b").select("plate", "n", r6(F.col("rho")).alias("rho"))


@query("J28_z_factor", f"select plate, {q6('1 - 3 * (stddev_pop(measure) filter (is_control) + stddev_pop(measure) filter (not is_control)) / nullif(abs(avg(measure) filter (is_control) - avg(measure) filter (not is_control)), 0)')} as z_factor from screen group by plate", "screen")
def z_factor(spark, sf_dir):
    c, e = F.when(F.col("is_control"), F.col("measure")), F.when(~F.col("is_control"), F.col("measure"))
    a = screen(spark, sf_dir).groupBy("plate").agg(F.stddev_pop(c).alias("sc"), F.stddev_pop(e).alias("se"), F.avg(c).alias("mc"), F.avg(e).alias("me"))
    gap = F.abs(F.col("mc") - F.col("me"))
    return a.select("plate", r6(1 - 3 * (F.col("sc") + F.col("se")) / F.when(gap > 0, gap)).alias("z_factor"))


@query("J30_replicability_iqr", f"d as (select sirna, median(measure) as d from screen group by sirna) select gene, {q6('quantile_cont(measure / d, 0.75) - quantile_cont(measure / d, 0.25)')} as iqr from screen join d using (sirna) group by gene", "screen")
def replicability_iqr(spark, sf_dir):
    rows = screen(spark, sf_dir)
    d = rows.groupBy("sirna").agg(F.percentile("measure", 0.5).alias("d"))
    ratio = F.col("measure") / F.when(F.col("d") != 0, F.col("d"))
    q = S.quantiles(rows.join(d, "sirna").select("gene", ratio.alias("ratio")), ["gene"], "ratio", {"a": 0.25, "b": 0.75})
    return q.select("gene", r6(F.col("b") - F.col("a")).alias("iqr"))


@query("J35_feature_correlations", f"u as (select exp, generate_subscripts(f, 1) - 1 as i, unnest(f) as v from features) select a.i::int as i, b.i::int as j, {q6('corr(a.v, b.v)')} as r from u a join u b using (exp) where a.i < b.i group by a.i, b.i", "features")
def feature_correlations(spark, sf_dir):
    """One pass over the wide rows: the sums of products of all elements, not joined pairs. The matrix has as many rows as a vector elements."""
    matrix = Correlation.corr(features(spark, sf_dir).select(array_to_vector("f").alias("v")), "v").first()[0].toArray()
    n = len(matrix)
    return spark.createDataFrame([(i, j, round(float(matrix[i, j]), 6) + 0.0) for i in range(n) for j in range(i + 1, n)], "i int, j int, r double")


@query("J38_density_histogram", f"t as (select min(measure) as lo, max(measure) as hi from screen) select least(floor((measure - lo) / ((hi - lo) / 50)), 49)::int as bin, count(*) as n, {q6('count(*) / sum(count(*)) over () / any_value((hi - lo) / 50) * 1000')} as density from screen, t group by bin", "screen")
def density_histogram(spark, sf_dir):
    rows = screen(spark, sf_dir)
    t = rows.agg(F.min("measure").alias("lo"), F.max("measure").alias("hi"))
    n = rows.crossJoin(F.broadcast(t)).groupBy(K.bin_of(F.col("measure"), F.col("lo"), F.col("hi"), 50).alias("bin")).agg(F.count("*").alias("n"), F.first((F.col("hi") - F.col("lo")) / 50).alias("w"))
    return n.select("bin", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))) / F.col("w") * 1000).alias("density"))


@query("J41_robust_deviation", f"d as (select plate, median(measure) as d from screen group by plate) select plate, {q6('median(abs(measure - d)) / 0.6745')} as mad from screen join d using (plate) group by plate", "screen")
def robust_deviation(spark, sf_dir):
    rows = screen(spark, sf_dir)
    d = S.quantiles(rows, ["plate"], "measure", {"d": 0.5})
    off = rows.join(F.broadcast(d), "plate").select("plate", F.abs(F.col("measure") - F.col("d")).alias("off"))
    return S.quantiles(off, ["plate"], "off", {"mad": 0.5}).select("plate", r6(F.col("mad") / 0.6745).alias("mad"))


# ---- K: distances

H_SQL = "t as (select min(x) as lo, max(x) as hi from objects), n as (select plate, least(floor((x - lo) / ((hi - lo) / 10)), 9)::int as b, count(*) as n from objects, t group by plate, b), h as (select p.plate, list(coalesce(n.n, 0) / s.s order by i.b) as h from (select distinct plate from n) p cross join (select unnest(range(10)) as b) i left join n on n.plate = p.plate and n.b = i.b join (select plate, sum(n) as s from n group by plate) s on s.plate = p.plate group by p.plate)"


def _h(spark, sf_dir):
    return K.histograms(objects(spark, sf_dir), ["plate"], "x", 10)


@query("K01_histograms", f"{H_SQL}, u as (select plate, generate_subscripts(h, 1) - 1 as bin, unnest(h) as v from h) select plate, bin::int as bin, {q6('v')} as share from u", "objects")
def histograms(spark, sf_dir):
    return _h(spark, sf_dir).select("plate", F.posexplode("h").alias("bin", "v")).select("plate", "bin", r6(F.col("v")).alias("share"))


PAIR_SQL = f"{H_SQL}, u as (select plate, generate_subscripts(h, 1) as k, unnest(h) as v from h), c as (select plate, k, v, sum(v) over (partition by plate order by k rows unbounded preceding) as c from u), p as (select a.plate as i, b.plate as j, a.k, a.v as x, b.v as y, a.c as cx, b.c as cy from c a join c b on a.k = b.k and a.plate < b.plate)"


@query("K19_divergences", f"{PAIR_SQL} select i, j, {q6('sum(abs(x - y))')} as total_variation, {q6('sqrt(sum((sqrt(x) - sqrt(y)) ** 2) / 2)')} as hellinger, {q6('sum((x + 1e-5) * ln((x + 1e-5) / (y + 1e-5)))')} as kl, {q6('sum(abs(cx - cy))')} as emd from p group by i, j", "objects")
def divergences(spark, sf_dir):
    pairs = K.pair_table(_h(spark, sf_dir), "plate", "h", lambda a, b: F.struct(*[r6(f(a, b)).alias(n) for n, f in (("total_variation", X.total_variation), ("hellinger", X.hellinger), ("kl", X.kullback_leibler), ("emd", X.emd_1d))]))
    return pairs.select("i", "j", "d.*")


@query("K11_sinkhorn")
def sinkhorn(spark, sf_dir):
    pairs = K.pair_table(_h(spark, sf_dir), "plate", "h", lambda a, b: F.struct(K.sinkhorn_distance(a, b).alias("sinkhorn"), X.emd_1d(a, b).alias("emd")))
    return pairs.select("i", "j", r6(F.col("d.sinkhorn")).alias("sinkhorn"), r6(F.col("d.emd") / 9).alias("emd"))


@query("K02_joint_histogram", f"t as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from objects) select least(floor((x - x0) / ((x1 - x0) / 8)), 7)::int as bx, least(floor((y - y0) / ((y1 - y0) / 8)), 7)::int as y_bin, {q6('count(*) / sum(count(*)) over ()')} as share from objects, t group by bx, y_bin", "objects")
def joint_histogram(spark, sf_dir):
    rows = objects(spark, sf_dir)
    t = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    b = lambda v: K.bin_of(F.col(v), F.col(f"{v}0"), F.col(f"{v}1"), 8)
    n = rows.crossJoin(F.broadcast(t)).groupBy(b("x").alias("bx"), b("y").alias("y_bin")).agg(F.count("*").alias("n"))
    return n.select("bx", "y_bin", r6(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("share"))


@query("K03_quantile_edges", ", ".join(["select plate"] + [f"{q6(f'quantile_cont(x, {k / 10})')} as e{k}" for k in range(11)]) + " from objects group by plate", "objects")
def quantile_edges(spark, sf_dir):
    q = S.quantiles(objects(spark, sf_dir), ["plate"], "x", {f"e{k}": k / 10 for k in range(11)})
    return q.select("plate", *[r6(F.col(f"e{k}")).alias(f"e{k}") for k in range(11)])


@query("K22_condition_distances", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k) select a.condition as i, b.condition as j, {q6('sqrt(sum((a.v - b.v) ** 2))')} as d from m a join m b on a.k = b.k and a.condition < b.condition group by 1, 2", "features")
def condition_distances(spark, sf_dir):
    return K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", X.euclidean).select("i", "j", r6(F.col("d")).alias("d"))


# ---- L: clusters

CENTRE_SQL = "u as (select exp, condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition as label, k, avg(v) as c from u group by condition, k), d as (select exp, label, any_value(condition) as condition, sqrt(sum((v - c) ** 2)) as d from u join m using (k) group by exp, label), a as (select exp, condition, label, d from d qualify row_number() over (partition by exp order by round(d, 9), label) = 1)"


@query("L21_nearest_centre", f"{CENTRE_SQL} select exp, label, {q6('d')} as d from a", "features")
def nearest_centre(spark, sf_dir):
    rows = features(spark, sf_dir)
    return L.nearest(rows, L.mean_vectors(rows, ["condition"]).withColumnRenamed("condition", "label")).select("exp", "label", r6(F.col("d")).alias("d"))


@query("G02_representatives", f"{CENTRE_SQL} select label, exp, row_number() over (partition by label order by round(d, 9), exp)::int as k from a qualify k <= 10", "features")
def representatives(spark, sf_dir):
    rows = features(spark, sf_dir)
    a = L.nearest(rows, L.mean_vectors(rows, ["condition"]).withColumnRenamed("condition", "label"))
    return a.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.round("d", 9), "exp"))).where("k <= 10").select("label", "exp", "k")


@query("E22_relabelling", f"{CENTRE_SQL}, n as (select label, condition, count(*) as n from a group by label, condition) select label, condition, n from n qualify row_number() over (partition by label order by n desc, condition) = 1", "features")
def relabelling(spark, sf_dir):
    rows = features(spark, sf_dir)
    a = L.nearest(rows, L.mean_vectors(rows, ["condition"]).withColumnRenamed("condition", "label"), keep=["condition"])
    n = a.groupBy("label", "condition").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(F.max_by("condition", F.struct(F.col("n"), -F.col("condition"))).alias("condition"), F.max("n").alias("n"))


@query("L37_recall_purity_entropy", f"{CENTRE_SQL}, n as (select label, condition, count(*) as n from a group by label, condition), p as (select *, n / sum(n) over (partition by condition) as r, n / sum(n) over (partition by label) as q from n) select condition, {q6('max(r)')} as recall, {q6('sum(-r * ln(r))')} as entropy, {q6('max(q)')} as purity from p group by condition", "features")
def recall_purity_entropy(spark, sf_dir):
    rows = features(spark, sf_dir)
    a = L.nearest(rows, L.mean_vectors(rows, ["condition"]).withColumnRenamed("condition", "label"), keep=["condition"])
    n = a.groupBy("label", "condition").agg(F.count("*").alias("n"))
    p = n.select("condition", (F.col("n") / F.sum("n").over(W.partitionBy("condition"))).alias("r"), (F.col("n") / F.sum("n").over(W.partitionBy("label"))).alias("q"))
    return p.groupBy("condition").agg(r6(F.max("r")).alias("recall"), r6(F.sum(-F.col("r") * F.ln("r"))).alias("entropy"), r6(F.max("q")).alias("purity"))


@query("L02_kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return L.kmeans_sweep(features(spark, sf_dir), range(2, 6))


@query("L07_gaussian_mixture_bic")
def gaussian_mixture_bic(spark, sf_dir):
    return L.mixture_sweep(features(spark, sf_dir), range(2, 4))


@query("L35_mixture_labels")
def mixture_labels(spark, sf_dir):
    """The component of each experiment in a mixture of three, and its probability."""
    return L.mixture_labels(features(spark, sf_dir), 3).select("exp", "label", r6(F.col("p")).alias("probability"))


@query("L26_control_pca")
def control_pca(spark, sf_dir):
    return L.control_pca(features(spark, sf_dir), 3)


@query("L10_graph_laplacian", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k), w as (select a.condition as i, b.condition as j, exp(-0.1 * sum((a.v - b.v) ** 2)) as w from m a join m b on a.k = b.k and a.condition <> b.condition group by 1, 2), g as (select i, sum(w) as g from w group by i) select i, j, {q6('-w / nullif(g, 0)')} as l from w join g using (i)", "features")
def graph_laplacian(spark, sf_dir):
    means = L.mean_vectors(features(spark, sf_dir), ["condition"])
    w = K.symmetric(K.pair_table(means, "condition", "f", lambda a, b: X.rbf(a, b, 0.1)))
    g = w.groupBy("i").agg(F.sum("d").alias("g"))
    return w.join(g, "i").select("i", "j", r6(-F.col("d") / F.when(F.col("g") > 0, F.col("g"))).alias("l"))


# ---- M: hits


@query("M01_confirmed_genes", f"{MEAN}, t as (select quantile_cont(measure, 0.9) as t from screen where is_control), e as (select gene, sirna, measure > t as hit from screen, t where not is_control), l as (select gene, sirna, count(*) as n, count(case when hit then 1 end) as h from e group by gene, sirna) select gene, count(*) as n_lower, count(case when h >= 2 and h >= n * 0.2 then 1 end) as n_hit_lower, bool_or(h >= 2 and h >= n * 0.2) as hit from l group by gene", "screen")
def confirmed_genes(spark, sf_dir):
    rows = screen(spark, sf_dir)
    t = S.quantiles(rows.where("is_control"), [], "measure", {"t": 0.9})
    return M.two_level_hits(rows.where(~F.col("is_control")).crossJoin(F.broadcast(t)).withColumn("hit", F.col("measure") > F.col("t")), "sirna", "gene", "hit", share=0.2)


@query("M03_gene_scores", f"{EMPIRICAL} select gene, {q6('p')} as score, sirna from e qualify row_number() over (partition by gene order by p, sirna) = 1", "screen")
def gene_scores(spark, sf_dir):
    return _empirical(spark, sf_dir).groupBy("gene").agg(r6(F.min("p")).alias("score"), F.min_by("sirna", F.struct("p", "sirna")).alias("sirna"))


@query("M04_tukey_hits", f"{MEAN}, q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from m where is_control) select sirna, v <= a - 1.5 * (b - a) as low from m, q where not is_control", "screen")
def tukey_hits(spark, sf_dir):
    m = _means(spark, sf_dir)
    return M.tukey_low(m.where(~F.col("is_control")), m.where("is_control"), "v").select("sirna", "low")


@query("M06_phenotypic_score", f"c as (select plate, frame, cls, count(*) / sum(count(*)) over (partition by plate, frame) as v from objects group by plate, frame, cls), d as (select a.plate, a.cls, a.frame, round(a.v - b.v, 9) as d from c a join c b on b.plate = 0 and a.frame = b.frame and a.cls = b.cls where a.plate <> 0) select plate, cls, {q6('d')} as score from d qualify row_number() over (partition by plate, cls order by abs(d) desc, frame) = 1", "objects")
def phenotypic_score(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "frame", "cls").agg(F.count("*").alias("n"))
    c = n.withColumn("v", F.col("n") / F.sum("n").over(W.partitionBy("plate", "frame"))).drop("n")
    return M.extremal_difference(c.where("plate <> 0"), c.where("plate = 0").drop("plate"), ["plate", "cls"], ["cls", "frame"]).select("plate", "cls", r6(F.col("score")).alias("score"))


@query("M17_rank_product", f"p as (select batch, sirna, median(measure) as v from screen group by batch, sirna), r as (select batch, sirna, row_number() over (partition by batch order by v, sirna) as r from p), n as (select batch, count(*) as n from p group by batch), g as (select s.sirna, coalesce(r.r, n.n) as r from (select distinct sirna from p) s cross join n left join r on r.sirna = s.sirna and r.batch = n.batch) select sirna, count(*) as k, {q6('exp(sum(ln(r)) / count(*))')} as rank_product from g group by sirna", "screen")
def rank_product(spark, sf_dir):
    return M.rank_product(screen(spark, sf_dir), "sirna", "batch", "measure").select("sirna", "k", r6(F.col("rank_product")).alias("rank_product"))


@query("M21_rank_product_present", f"p as (select batch, gene, median(measure) as v from screen group by batch, gene), r as (select gene, row_number() over (partition by batch order by v, gene) as r from p) select gene, count(*) as k, {q6('exp(sum(ln(r)) / count(*))')} as rank_product from r group by gene", "screen")
def rank_product_present(spark, sf_dir):
    return M.rank_product(screen(spark, sf_dir), "gene", "batch", "measure", missing=False).select("gene", "k", r6(F.col("rank_product")).alias("rank_product"))


# ---- Q: layout


@query("Q01_neighbours", "p as (select unnest(range(1, 385)) as position), c as (select position, (position - 1) // 12 as r, (position - 1) % 12 as c from p) select a.position, b.position as neighbour from c a join c b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and a.position <> b.position where a.position in (select position from wells)", "wells")
def neighbours(spark, sf_dir):
    return Q.neighbours(wells(spark, sf_dir))


@query("Q03_isolated_hits", "h as (select distinct gene, position, (position - 1) // 12 as r, (position - 1) % 12 as c from wells where size > 40) select gene, position, exists (select 1 from h b where b.gene = h.gene and abs(h.r - b.r) <= 1 and abs(h.c - b.c) <= 1 and h.position <> b.position) as has_neighbour from h", "wells")
def isolated_hits(spark, sf_dir):
    return Q.isolated(wells(spark, sf_dir).where("size > 40"), ["gene"])


@query("Q10_plate_configuration", "select case when sirna % 5 < 2 then 'druggable' else 'genome' end as config, row, count(*) as n from wells group by 1, 2", "wells")
def plate_configuration(spark, sf_dir):
    return wells(spark, sf_dir).groupBy(F.when(F.col("sirna") % 5 < 2, "druggable").otherwise("genome").alias("config"), "row").agg(F.count("*").alias("n"))


# ---- further lookups, statistics, distances and hits


@query("D02_unique_targets", "select min(p_partkey) as sirna, p_brand || '/' || p_type || '/' || p_size as gene from part group by 2 having count(*) = 1")
def unique_targets(spark, sf_dir):
    """Targets that one siRNA alone has."""
    gene = F.concat_ws("/", "p_brand", "p_type", "p_size")
    rows = table(spark, sf_dir, "part").groupBy(gene.alias("gene")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("sirna"))
    return rows.where("n = 1").select("sirna", "gene")


@query("D06_control_expansion", "p as (select distinct plate from screen), c as (select unnest([15, 26, 63]) as well, true as old union all select unnest([1, 49, 97, 145]), false) select plate, well from p join c on old = (plate < 2)", "screen")
def control_expansion(spark, sf_dir):
    wells_of = F.when(F.col("plate") < 2, F.array(*map(F.lit, (15, 26, 63)))).otherwise(F.array(*map(F.lit, (1, 49, 97, 145))))
    return screen(spark, sf_dir).select("plate").distinct().select("plate", F.explode(wells_of).alias("well"))


@query("D15_aligned_vectors", f"a as (select sirna, max(measure) as v from screen where plate = 0 group by sirna), b as (select sirna, max(measure) as v from screen where plate = 1 group by sirna) select sirna, {q6('a.v - b.v')} as difference from a join b using (sirna)", "screen")
def aligned_vectors(spark, sf_dir):
    top = lambda p, n: screen(spark, sf_dir).where(F.col("plate") == p).groupBy("sirna").agg(F.max("measure").alias(n))
    return top(0, "a").join(top(1, "b"), "sirna").select("sirna", r6(F.col("a") - F.col("b")).alias("difference"))


@query("D23_first_controls", "c as (select gene, sirna, dense_rank() over (order by sirna) as k from (select distinct gene, sirna from screen where is_control)) select gene, sirna from c where k <= 20", "screen")
def first_controls(spark, sf_dir):
    return screen(spark, sf_dir).where("is_control").select("gene", "sirna").distinct().orderBy("sirna", "gene").limit(20)


@query("E12_median_distance", f"m as (select gene, batch, avg(measure) as v from screen group by gene, batch), d as (select a.gene as i, b.gene as j, abs(a.v - b.v) as d from m a join m b on a.batch = b.batch and a.gene < b.gene) select i, j, {q6('median(d)')} as d from d group by i, j", "screen")
def median_distance(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("gene", "batch").agg(F.avg("measure").alias("v"))
    return K.pair_table(m, "gene", "v", lambda a, b: F.abs(a - b), ["batch"]).groupBy("i", "j").agg(r6(F.percentile("d", 0.5)).alias("d"))


@query("E40_usable_batches", "select sirna, count(*) as n, string_agg(distinct batch::varchar, ',' order by batch::varchar) as batches from screen where measure > 0 group by sirna", "screen")
def usable_batches(spark, sf_dir):
    return screen(spark, sf_dir).where("measure > 0").groupBy("sirna").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("batch").cast("string"))), ",").alias("batches"))


@query("G06_high_degree_conditions", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k), d as (select a.condition as i, b.condition as j, round(sqrt(sum((a.v - b.v) ** 2)), 9) as d from m a join m b on a.k = b.k and a.condition <> b.condition group by 1, 2), t as (select quantile_cont(d, 0.4) as t from d), g as (select i, count(*) as degree from d, t where d <= t group by i) select i as condition, degree from g", "features")
def high_degree_conditions(spark, sf_dir):
    d = K.symmetric(K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", X.euclidean)).withColumn("d", F.round("d", 9))
    t = d.agg(F.percentile("d", 0.4).alias("t"))
    return d.crossJoin(F.broadcast(t)).where("d <= t").groupBy(F.col("i").alias("condition")).agg(F.count("*").alias("degree"))


@query("J03_fisher_by_batch", f"{MEAN}, c as (select measure as v from screen where is_control), b as (select batch, sirna, avg(measure) as v from screen where not is_control group by batch, sirna), p as (select batch, sirna, (1 + (select count(*) from c where c.v >= b.v)) / (1 + (select count(*) from c)) as p from b), s as (select sirna, batch, -2 * ln(p) as x from p) select sirna, count(*) as n, {q6('min(x)')} as low, {q6('median(x)')} as middle, {q6('max(x)')} as high from s group by sirna", "screen")
def fisher_by_batch(spark, sf_dir):
    rows = screen(spark, sf_dir)
    b = rows.where(~F.col("is_control")).groupBy("batch", "sirna").agg(F.avg("measure").alias("v"))
    x = -2 * F.ln("p")
    return S.empirical_p(b, rows.where("is_control"), "v", "measure").groupBy("sirna").agg(F.count("*").alias("n"), r6(F.min(x)).alias("low"), r6(F.percentile(x, 0.5)).alias("middle"), r6(F.max(x)).alias("high"))


@query("J13_percentile_thresholds", f"select batch, {q6('quantile_cont(measure, 0.05)')} as low, {q6('quantile_cont(measure, 0.95)')} as high from screen where is_control group by batch", "screen")
def percentile_thresholds(spark, sf_dir):
    q = S.quantiles(screen(spark, sf_dir).where("is_control"), ["batch"], "measure", {"low": 0.05, "high": 0.95})
    return q.select("batch", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("J16_thresholded_hits", "t as (select batch, quantile_cont(measure, 0.95) as t from screen where is_control group by batch) select sirna, count(*) as n, count(case when measure > t then 1 end) as n_hits from screen join t using (batch) where not is_control group by sirna", "screen")
def thresholded_hits(spark, sf_dir):
    rows = screen(spark, sf_dir)
    t = S.quantiles(rows.where("is_control"), ["batch"], "measure", {"t": 0.95})
    return rows.where(~F.col("is_control")).join(F.broadcast(t), "batch").groupBy("sirna").agg(F.count("*").alias("n"), F.count_if(F.col("measure") > F.col("t")).alias("n_hits"))


@query("J17_clustering_stability", f"{CENTRE_SQL}, n as (select label, condition, count(*) as n from a group by label, condition), s as (select sum(n * n) as both_ from n), x as (select sum(k * k) as v from (select sum(n) as k from n group by label)), y as (select sum(k * k) as v from (select sum(n) as k from n group by condition)) select {q6('both_ / sqrt(x.v * y.v)')} as stability from s, x, y", "features")
def clustering_stability(spark, sf_dir):
    """Cosine of the co-membership matrices, from the contingency table: pairs are never listed."""
    rows = features(spark, sf_dir)
    n = L.nearest(rows, L.mean_vectors(rows, ["condition"]).withColumnRenamed("condition", "label"), keep=["condition"]).groupBy("label", "condition").agg(F.count("*").alias("n"))
    squares = lambda keys: n.groupBy(*keys).agg(F.sum("n").alias("k")).agg(F.sum((F.col("k") * F.col("k")).cast("double")).alias("s"))
    a, b, c = squares(["label", "condition"]).toDF("both"), squares(["label"]).toDF("x"), squares(["condition"]).toDF("y")
    return a.crossJoin(b).crossJoin(c).select(r6(F.col("both") / F.sqrt(F.col("x") * F.col("y"))).alias("stability"))


@query("J29_plate_correlations", f"m as (select plate, gene, median(measure) as v from screen group by plate, gene), p as (select a.plate as i, b.plate as j, a.v as x, b.v as y from m a join m b on a.gene = b.gene and a.plate < b.plate), r as (select i, j, rank() over (partition by i, j order by x) + (count(*) over (partition by i, j, x) - 1) / 2 as rx, rank() over (partition by i, j order by y) + (count(*) over (partition by i, j, y) - 1) / 2 as ry from p) select i, j, count(*) as n, {q6('corr(rx, ry)')} as rho from r group by i, j", "screen")
def plate_correlations(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("plate", "gene").agg(F.percentile("measure", 0.5).alias("v"))
    pairs = K.pair_table(m, "plate", "v", lambda a, b: F.struct(a.alias("x"), b.alias("y")), ["gene"]).select("i", "j", "d.x", "d.y")
    return S.spearman(pairs, ["i", "j"], "x", "y").select("i", "j", "n", r6(F.col("rho")).alias("rho"))


REPLICATES = "u as (select condition, plate, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, plate, k, avg(v) as v from u group by condition, plate, k), d as (select a.condition as ci, a.plate as pi, b.condition as cj, b.plate as pj, sqrt(sum((a.v - b.v) ** 2)) as d from m a join m b on a.k = b.k and (a.condition, a.plate) <> (b.condition, b.plate) group by 1, 2, 3, 4), n as (select condition, count(distinct plate) as n_rep from features group by condition)"


def _replicate_distances(spark, sf_dir):
    """ci, pi, cj, pj, d: all pairs of replicates, one mean vector for each condition and plate."""
    rows = L.mean_vectors(features(spark, sf_dir), ["condition", "plate"]).withColumn("key", F.struct("condition", "plate"))
    return K.symmetric(K.pair_table(rows, "key", "f", X.euclidean)).select(F.col("i.condition").alias("ci"), F.col("i.plate").alias("pi"), F.col("j.condition").alias("cj"), F.col("j.plate").alias("pj"), "d")


@query("J33_replicates_against_the_rest", f"{REPLICATES} select ci as condition, {q6('sum(case when ci = cj then d end) / (sum(case when ci <> cj then d end) / any_value(n_rep))')} as ratio from d join n on n.condition = ci group by ci", "features")
def replicates_against_the_rest(spark, sf_dir):
    """The distances between a condition's replicates over those to all others' replicates, the latter for one replicate."""
    n = features(spark, sf_dir).groupBy(F.col("condition").alias("ci")).agg(F.count_distinct("plate").alias("n_rep"))
    same = F.col("ci") == F.col("cj")
    d = _replicate_distances(spark, sf_dir).groupBy("ci").agg(F.sum(F.when(same, F.col("d"))).alias("within"), F.sum(F.when(~same, F.col("d"))).alias("others"))
    return d.join(n, "ci").select(F.col("ci").alias("condition"), r6(F.col("within") / (F.col("others") / F.col("n_rep"))).alias("ratio"))


@query("J44_accuracy_of_hits", f"t as (select sirna, max(measure) > 100000 as truth, avg(measure) > 38000 as called from screen group by sirna) select {q6('count(case when truth and called then 1 end) / nullif(count(case when truth then 1 end), 0)')} as accuracy, {q6('count(case when truth and called then 1 end) / nullif(count(case when called then 1 end), 0)')} as precision from t", "screen")
def accuracy_of_hits(spark, sf_dir):
    t = screen(spark, sf_dir).groupBy("sirna").agg((F.max("measure") > 100000).alias("truth"), (F.avg("measure") > 38000).alias("called"))
    both, truth, called = F.count_if(F.col("truth") & F.col("called")), F.count_if("truth"), F.count_if("called")
    return t.agg(both.alias("b"), truth.alias("t"), called.alias("c")).select(r6(F.col("b") / F.when(F.col("t") > 0, F.col("t"))).alias("accuracy"), r6(F.col("b") / F.when(F.col("c") > 0, F.col("c"))).alias("precision"))


@query("K05_ground_costs", f"b as (select distinct size % 10 as i from wells) select a.i, b.i as j, abs(a.i - b.i)::int as cost, {q6('sqrt((a.i // 4 - b.i // 4) ** 2 + (a.i % 4 - b.i % 4) ** 2)')} as cost_2d from b a, b b", "wells")
def ground_costs(spark, sf_dir):
    b = wells(spark, sf_dir).select((F.col("size") % 10).alias("i")).distinct()
    pairs = b.crossJoin(F.broadcast(b.withColumnRenamed("i", "j")))  # ten bins at most
    return pairs.select("i", "j", F.abs(F.col("i") - F.col("j")).alias("cost"), r6(X.norm(F.floor(F.col("i") / 4) - F.floor(F.col("j") / 4), F.col("i") % 4 - F.col("j") % 4)).alias("cost_2d"))


@query("K30_distances_over_time", f"c as (select plate, frame, count(*) as n from objects group by plate, frame), d as (select a.plate as i, b.plate as j, abs(a.n - b.n) as d from c a join c b on a.frame = b.frame and a.plate <> b.plate) select i, j, max(d) as largest, sum(d)::bigint as total from d group by i, j", "objects")
def distances_over_time(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.count("*").alias("n"))
    d = K.pair_table(c, "plate", "n", lambda a, b: F.abs(a - b), ["frame"]).groupBy("i", "j").agg(F.max("d").alias("largest"), F.sum("d").alias("total"))
    return d.union(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "largest", "total"))


@query("L11_grid_density", "select floor(x / 25)::bigint as gx, floor(y / 25)::bigint as gy, count(case when plate = 0 then 1 end) as control, count(case when plate <> 0 then 1 end) as experiment from objects group by 1, 2", "objects")
def grid_density(spark, sf_dir):
    g = lambda v: F.floor(F.col(v) / 25)
    return objects(spark, sf_dir).groupBy(g("x").alias("gx"), g("y").alias("gy")).agg(F.count_if(F.col("plate") == 0).alias("control"), F.count_if(F.col("plate") != 0).alias("experiment"))


@query("L39_parameter_grid", "select a.plate, b.cls, k from (select distinct plate from objects) a, (select distinct cls from objects) b, (select unnest([2, 3, 4]) as k)", "objects")
def parameter_grid(spark, sf_dir):
    rows = objects(spark, sf_dir)
    grid = rows.select("plate").distinct().crossJoin(F.broadcast(rows.select("cls").distinct()))  # parameters, not rows: a few of each
    return grid.withColumn("k", F.explode(F.array(*map(F.lit, (2, 3, 4)))))


@query("M05_slow_growth", f"{MEAN}, q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b, median(v) as m from m where is_control), l as (select sirna from m, q where not is_control and v <= a - 1.5 * (b - a)) select sirna, v <= m as slow from m, q where not is_control and sirna not in (select sirna from l)", "screen")
def slow_growth(spark, sf_dir):
    m = _means(spark, sf_dir)
    low = M.tukey_low(m.where(~F.col("is_control")), m.where("is_control"), "v")
    middle = S.quantiles(m.where("is_control"), [], "v", {"m": 0.5})
    return low.where(~F.col("low")).crossJoin(F.broadcast(middle)).select("sirna", (F.col("v") <= F.col("m")).alias("slow"))


@query("M11_mean_absolute_difference", f"c as (select plate, frame, cls, count(*) / sum(count(*)) over (partition by plate, frame) as v from objects group by plate, frame, cls) select a.plate, a.cls, {q6('avg(abs(a.v - b.v))')} as difference from c a join c b on b.plate = 0 and a.frame = b.frame and a.cls = b.cls where a.plate <> 0 group by 1, 2", "objects")
def mean_absolute_difference(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "frame", "cls").agg(F.count("*").alias("n"))
    c = n.withColumn("v", F.col("n") / F.sum("n").over(W.partitionBy("plate", "frame")))
    control = c.where("plate = 0").select("frame", "cls", F.col("v").alias("c"))
    return c.where("plate <> 0").join(control, ["frame", "cls"]).groupBy("plate", "cls").agg(r6(F.avg(F.abs(F.col("v") - F.col("c")))).alias("difference"))


@query("M27_rank_of_targets", "m as (select gene, median(measure) as v from screen group by gene), r as (select gene, row_number() over (order by v desc, gene)::int as rank from m) select gene, rank from r where gene in (select gene from wells where sirna < 6)", "screen wells")
def rank_of_targets(spark, sf_dir):
    m = screen(spark, sf_dir).groupBy("gene").agg(F.percentile("measure", 0.5).alias("v"))
    ranked = m.select("gene", F.row_number().over(W.orderBy(F.desc("v"), "gene")).alias("rank"))
    return ranked.join(wells(spark, sf_dir).where("sirna < 6").select("gene").distinct(), "gene", "left_semi")


@query("Q07_confirmed_neighbour_isolated", "t as (select distinct position from wells where size > 45), r as (select distinct position from wells where size < 3), n as (select t.position, max(case when r.position = t.position then 2 when abs((t.position - 1) // 12 - (r.position - 1) // 12) <= 1 and abs((t.position - 1) % 12 - (r.position - 1) % 12) <= 1 then 1 else 0 end) as k from t, r group by t.position) select position, case k when 2 then 'confirmed' when 1 then 'neighbour' else 'isolated' end as kind from n", "wells")
def confirmed_neighbour_isolated(spark, sf_dir):
    t, r = (wells(spark, sf_dir).where(c).select("position").distinct() for c in ("size > 45", "size < 3"))
    near = Q.neighbours(r).select(F.col("neighbour").alias("position")).distinct().withColumn("near", F.lit(True))
    rows = t.join(r.withColumn("same", F.lit(True)), "position", "left").join(near, "position", "left")
    return rows.select("position", F.when(F.col("same"), "confirmed").when(F.col("near"), "neighbour").otherwise("isolated").alias("kind"))


@query("Q11_plate_grid", "select row, max(case when col <= 4 then size else 0 end) as a, max(case when col between 5 and 8 then size else 0 end) as b, max(case when col >= 9 then size else 0 end) as c from wells group by row", "wells")
def plate_grid(spark, sf_dir):
    col, size = F.col("col"), F.col("size")
    return wells(spark, sf_dir).groupBy("row").agg(F.max(F.when(col <= 4, size).otherwise(0)).alias("a"), F.max(F.when(col.between(5, 8), size).otherwise(0)).alias("b"), F.max(F.when(col >= 9, size).otherwise(0)).alias("c"))


# ---- tests against a model, contingency, permutation nulls, curves

NORMAL = "d as (select plate, median(measure) as m from screen group by plate), s as (select plate, any_value(m) as m, median(abs(measure - m)) / 0.6745 as s from screen join d using (plate) group by plate), c as (select plate, measure as v, count(*) as t from screen group by plate, measure), k as (select plate, v, t, sum(t) over (partition by plate order by v rows unbounded preceding) as c, sum(t) over (partition by plate) as n from c), z as (select plate, n, c, t, (v - m) / s as z from k join s using (plate))"


@query("J43_ks_against_normal", f"{NORMAL}, f as (select plate, n, c, t, 1 - ({X.normal_sf_sql('z')}) as f from z) select plate, max(n)::bigint as n, {q6('max(greatest(abs(c / n - f), abs(f - (c - t) / n)))')} as d from f group by plate", "screen")
def ks_against_normal(spark, sf_dir):
    """Each plate's measures against the normal distribution with the plate's median and robust deviation."""
    rows = screen(spark, sf_dir)
    d = S.quantiles(rows, ["plate"], "measure", {"m": 0.5})
    off = rows.join(F.broadcast(d), "plate").select("plate", F.abs(F.col("measure") - F.col("m")).alias("off"))
    s = S.quantiles(off, ["plate"], "off", {"s": 0.5}).join(d, "plate").withColumn("s", F.col("s") / 0.6745)
    c = S.running(rows.groupBy("plate", F.col("measure").alias("v")).agg(F.count("*").alias("t")), ["plate"], "v", ["t"])
    k = c.select("plate", "v", "t", (F.col("before_t") + F.col("t")).alias("c"), F.col("all_t").alias("n")).join(F.broadcast(s), "plate")
    f = 1 - X.normal_sf((F.col("v") - F.col("m")) / F.col("s"))
    off = F.greatest(F.abs(F.col("c") / F.col("n") - f), F.abs(f - (F.col("c") - F.col("t")) / F.col("n")))
    return k.groupBy("plate").agg(F.max("n").alias("n"), r6(F.max(off)).alias("d"))


@query("J11_contingency_statistic", f"n as (select plate, cls, count(*) as n from objects group by plate, cls), e as (select a.plate, a.cls, a.n as o, b.n as c from n a join n b on b.plate = 0 and a.cls = b.cls where a.plate <> 0), t as (select *, sum(o) over (partition by plate) as so, sum(c) over (partition by plate) as sc from e) select plate, count(*) as classes, {q6('sum((o * sqrt(sc / so) - c * sqrt(so / sc)) ** 2 / (o + c))')} as chi2 from t group by plate", "objects")
def contingency_statistic(spark, sf_dir):
    """Chi-square of the class counts of a plate against the control plate's."""
    n = objects(spark, sf_dir).groupBy("plate", "cls").agg(F.count("*").alias("o"))
    t = n.where("plate <> 0").join(n.where("plate = 0").select("cls", F.col("o").alias("c")), "cls")
    plate = W.partitionBy("plate")
    t = t.withColumns({"so": F.sum("o").over(plate), "sc": F.sum("c").over(plate)})
    off = F.col("o") * F.sqrt(F.col("sc") / F.col("so")) - F.col("c") * F.sqrt(F.col("so") / F.col("sc"))
    return t.groupBy("plate").agg(F.count("*").alias("classes"), r6(F.sum(off * off / (F.col("o") + F.col("c")))).alias("chi2"))


RUNS, SEED = 50, 23
NULL_RANKS = f"""p as (select batch, gene, median(measure) as v from screen group by batch, gene), r as (select batch, gene, row_number() over (partition by batch order by v, gene) as r from p), o as (select gene, round(exp(sum(ln(r)) / count(*)), 9) as rp from r group by gene),
q as (select run, batch, gene, row_number() over (partition by run, batch order by md5('{SEED}:' || run || ':' || batch || ':' || gene), gene) as r from p, (select unnest(range(1, {RUNS + 1})) as run)), n as (select run, gene, round(exp(sum(ln(r)) / count(*)), 9) as rp from q group by run, gene)"""


@query("M18_rank_product_null", f"{NULL_RANKS} select gene, {q6('rp')} as rank_product, {q6(f'(select count(*) from n where n.rp <= o.rp) / {RUNS}')} as false_positives from o", "screen")
def rank_product_null(spark, sf_dir):
    rows = M.rank_product_null(screen(spark, sf_dir), "gene", "batch", "measure", RUNS, SEED)
    return rows.select("gene", r6(F.col("rank_product")).alias("rank_product"), r6(F.col("false_positives")).alias("false_positives"))


@query("J50_lowess")
def lowess(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "frame", "cls").agg(F.count("*").alias("n"))
    share = (F.col("n") / F.sum("n").over(W.partitionBy("plate", "frame"))).alias("v")
    return smoothing.smoothed(n.select("plate", "cls", "frame", share), ["plate", "cls"])


@query("K26_two_segment_paths")
def two_segment_paths(spark, sf_dir):
    classes = [F.count_if(F.col("cls") == c) / F.count("*") for c in ("click", "purchase", "view")]
    return smoothing.two_segment_paths(objects(spark, sf_dir).groupBy("plate", "frame").agg(F.array(*classes).alias("p")), "plate")


PLACEMENTS = """w as (select distinct position from wells), h as (select distinct position from wells where size > 40), k as (select run, position, row_number() over (partition by run order by md5('31:' || run || ':' || position), position) as k from w, (select unnest(range(0, 21)) as run)),
s as (select -1 as run, position from h union all select run, position from k where k <= (select count(*) from h)), c as (select run, position, (position - 1) // 12 as r, (position - 1) % 12 as c from s),
n as (select a.run, a.position, max(case when abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and a.position <> b.position then 1 else 0 end) as has from c a join c b using (run) group by 1, 2), g as (select run, sum(has) as with_neighbour, count(*) as hits from n group by run)"""


def _placements(spark, sf_dir):
    """run, position: the hits (run -1), and as many positions drawn by a seeded order in each of 21 runs."""
    rows = wells(spark, sf_dir)
    real = rows.where("size > 40").select(F.lit(-1).alias("run"), "position").distinct()
    n = real.agg(F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy("run").orderBy(samples.order(F.concat_ws(":", "run", "position"), 31), "position"))
    runs = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("run")
    null = rows.select("position").distinct().select("position", runs).withColumn("k", order).crossJoin(F.broadcast(n)).where("k <= n").select("run", "position")
    return Q.isolated(real.union(null), ["run"]).groupBy("run").agg(F.count_if("has_neighbour").alias("with_neighbour"), F.count("*").alias("hits"))


@query("Q05_random_placement_null", f"{PLACEMENTS} select run < 0 as observed, {q6('avg(with_neighbour)')} as with_neighbour, {q6('avg(hits)')} as hits from g group by 1", "wells")
def random_placement_null(spark, sf_dir):
    """Hits with a neighbour, and how many there are on average when as many hits are placed at random."""
    return _placements(spark, sf_dir).groupBy((F.col("run") < 0).alias("observed")).agg(r6(F.avg("with_neighbour")).alias("with_neighbour"), r6(F.avg("hits")).alias("hits"))


@query("Q06_repeated_placements", f"{PLACEMENTS} select run::int as run, with_neighbour::bigint as with_neighbour, hits from g where run >= 0", "wells")
def repeated_placements(spark, sf_dir):
    return _placements(spark, sf_dir).where("run >= 0")
