"""Local regression, transport barycentres and duals, Lloyd and Ward clustering, optimal links (letters J, K, L, M and N)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.jobs.inference import ACCURACY, CONDITIONS, UNNESTED, _judged, _linked, shares_sql
from platewise.jobs.screens import _h
from platewise.jobs.tracking import MUTUAL, RADIUS, _candidates
from platewise.model import features, objects, q6, query, r6, screen
from platewise.operators import assignment as A
from platewise.operators import clean as C
from platewise.operators import clusters as L
from platewise.operators import distances as K
from platewise.operators import hits as M
from platewise.operators import samples
from platewise.operators import smoothing
from platewise.operators import statistics as S
from platewise.sources import scratch, stored

SEEDED = samples.order_sql

# ---- J: local regression of phenotype curves

CURVES = "n as (select plate, cls, frame, count(*) as n from objects group by all), curve as (select plate, cls, frame, n / sum(n) over (partition by plate, frame) as v from n)"
GRID = ((0.3, 0), (0.3, 1), (0.6, 0), (0.6, 1))
GRID_SQL = "grid as (select * from (values " + ", ".join(f"({s}::double, {d})" for s, d in GRID) + ") g(share, degree)), curves as (select c.*, share, degree from curve c, grid)"
GRID_KEYS = "plate, cls, share, degree"
ERRORS = f"{CURVES}, {GRID_SQL}, f as ({smoothing.local_fits_sql('curves', GRID_KEYS, 'share', 'degree', held_out=True)}), e as (select {GRID_KEYS}, sum((v - fit) ** 2) / nullif(var_pop(v) * count(*), 0) as error from f group by all)"


def _curves(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "cls", "frame").agg(F.count("*").alias("n"))
    return n.select("plate", "cls", "frame", (F.col("n") / F.sum("n").over(W.partitionBy("plate", "frame"))).alias("v"))


def _gridded(spark, sf_dir):
    """The curves once for each pair of share and degree."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(d).alias("degree")) for s, d in GRID]))
    return _curves(spark, sf_dir).withColumn("g", grid).select("plate", "cls", "frame", "v", "g.share", "g.degree")


def _errors(spark, sf_dir):
    fits = smoothing.local_fits(_gridded(spark, sf_dir), GRID_KEYS.split(", "), "share", "degree", held_out=True)
    off, spread = F.col("v") - F.col("fit"), F.var_pop("v") * F.count("*")
    return fits.groupBy(*GRID_KEYS.split(", ")).agg((F.sum(off * off) / F.when(spread != 0, spread)).alias("error"))


@query("J45_local_regression", f"{CURVES}, p as (select *, 0.5::double as share, 1 as degree from curve), f as ({smoothing.local_fits_sql('p', 'plate, cls', 'share', 'degree')}) select plate, cls, frame, {q6('fit')} as fit from f", "objects")
def local_regression(spark, sf_dir):
    return smoothing.local_fits(_curves(spark, sf_dir), ["plate", "cls"], 0.5, 1).select("plate", "cls", "frame", r6(F.col("fit")).alias("fit"))


@query("J46_held_out_error", f"{ERRORS} select plate, cls, {q6('error')} as error from e where share = 0.6 and degree = 1", "objects")
def held_out_error(spark, sf_dir):
    """Relative squared error of points that are left out of their own fit."""
    return _errors(spark, sf_dir).where("share = 0.6 and degree = 1").select("plate", "cls", r6(F.col("error")).alias("error"))


@query("J47_error_by_parameters", f"{ERRORS} select share, degree, count(*) as n, {q6('avg(error)')} as error from e group by share, degree", "objects")
def error_by_parameters(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("share", "degree").agg(F.count("*").alias("n"), r6(F.avg("error")).alias("error"))


@query("J48_agreement_of_parameters", f"{CURVES}, {GRID_SQL}, f as ({smoothing.local_fits_sql('curves', GRID_KEYS, 'share', 'degree')}), m as (select {GRID_KEYS}, round(max(fit), 9) as v from f group by all), k as (select *, (share * 10)::int * 10 + degree as setting from m), p as (select a.setting as i, b.setting as j, a.v as x, b.v as y from k a join k b on a.plate = b.plate and a.cls = b.cls and a.setting < b.setting), r as (select i, j, x, y, rank() over (partition by i, j order by x) + (count(*) over (partition by i, j, x) - 1) / 2 as rx, rank() over (partition by i, j order by y) + (count(*) over (partition by i, j, y) - 1) / 2 as ry from p) select i, j, count(*) as n, {q6('corr(rx, ry)')} as rho, {q6('stddev_pop(x - y)')} as dispersion from r group by i, j", "objects")
def agreement_of_parameters(spark, sf_dir):
    """Rank correlation of the curves' largest smoothed values between settings, and the dispersion of their differences."""
    keys = GRID_KEYS.split(", ")
    m = smoothing.local_fits(_gridded(spark, sf_dir), keys, "share", "degree").groupBy(*keys).agg(F.round(F.max("fit"), 9).alias("v"))
    m = m.withColumn("setting", (F.col("share") * 10).cast("int") * 10 + F.col("degree"))
    p = K.pair_table(m, "setting", "v", lambda a, b: F.struct(a.alias("x"), b.alias("y")), ["plate", "cls"]).select("i", "j", "d.x", "d.y")
    spread = p.groupBy("i", "j").agg(r6(F.stddev_pop(F.col("x") - F.col("y"))).alias("dispersion"))
    return S.spearman(p, ["i", "j"], "x", "y").select("i", "j", "n", r6(F.col("rho")).alias("rho")).join(spread, ["i", "j"])


@query("J49_parameters_on_sampled_wells", f"{ERRORS}, w as (select plate from (select distinct plate from curve) order by {SEEDED('plate', 2)}, plate limit 3) select share, degree, {q6('avg(error)')} as error from e join w using (plate) group by share, degree", "objects")
def parameters_on_sampled_wells(spark, sf_dir):
    e = _errors(spark, sf_dir)
    chosen = samples.first_n(objects(spark, sf_dir).select("plate").distinct(), "plate", 3, 2)
    return e.join(F.broadcast(chosen), "plate", "left_semi").groupBy("share", "degree").agg(r6(F.avg("error")).alias("error"))


@query("J51_smoothed_means", f"c as (select plate, frame, avg(x) as v, 0.4::double as share, 1 as degree from objects group by plate, frame), f as ({smoothing.local_fits_sql('c', 'plate', 'share', 'degree')}) select plate, frame, {q6('fit')} as fit from f", "objects")
def smoothed_means(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.avg("x").alias("v"))
    return smoothing.local_fits(c, ["plate"], 0.4, 1).select("plate", "frame", r6(F.col("fit")).alias("fit"))


@query("J21_against_random_wells", f"r as (select exp, condition from features order by {SEEDED('exp', 44)}, exp limit 120), c as (select condition, count(*) as c from r group by condition), o as (select plate, condition, count(*) as o from features group by all), w as (select *, sum(o) over (partition by plate) as so, sum(c) over (partition by plate) as sc from o join c using (condition)) select plate, {q6('sum((o * sqrt(sc / so) - c * sqrt(so / sc)) ** 2 / (o + c))')} as chi2 from w group by plate", "features")
def against_random_wells(spark, sf_dir):
    """Cluster counts of each plate against those of 120 wells at random."""
    rows = features(spark, sf_dir).select("exp", "plate", "condition")
    c = samples.first_n(rows, "exp", 120, 44).groupBy("condition").agg(F.count("*").alias("c"))
    t = rows.groupBy("plate", "condition").agg(F.count("*").alias("o")).join(F.broadcast(c), "condition")
    plate = W.partitionBy("plate")
    t = t.withColumns({"so": F.sum("o").over(plate), "sc": F.sum("c").over(plate)})
    off = F.col("o") * F.sqrt(F.col("sc") / F.col("so")) - F.col("c") * F.sqrt(F.col("so") / F.col("sc"))
    return t.groupBy("plate").agg(r6(F.sum(off * off / (F.col("o") + F.col("c")))).alias("chi2"))


# ---- K: transport; quantiles have few digits, and 1e-9 keeps a last five from being rounded either way

LEVELS = [(k + 0.5) / 20 for k in range(20)]
QUANTILES = "q as (" + " union all ".join(f"select plate, {k} as level, quantile_cont(x, {t}) as q, count(*) as n from objects group by plate" for k, t in enumerate(LEVELS)) + ")"


def _quantiles(spark, sf_dir):
    """plate, level, q: the quantile function of each plate, at the middles of 20 steps."""
    rows = objects(spark, sf_dir)
    q = S.quantiles(rows, ["plate"], "x", {f"l{k}": t for k, t in enumerate(LEVELS)})
    n = rows.groupBy("plate").agg(F.count("*").alias("n"))
    return q.join(n, "plate").select("plate", "n", F.posexplode(F.array(*[F.col(f"l{k}") for k in range(20)])).alias("level", "q"))


@query("K14_weighted_barycentre", f"{QUANTILES} select level, {q6('sum(q * n) / sum(n) + 1e-9')} as q from q group by level", "objects")
def weighted_barycentre(spark, sf_dir):
    """In one dimension the barycentre for squared costs is the mean of the quantile functions; weighted by the number of objects."""
    return _quantiles(spark, sf_dir).groupBy("level").agg(r6(F.sum(F.col("q") * F.col("n")) / F.sum("n") + 1e-9).alias("q"))


@query("K15_median_barycentre", f"{QUANTILES} select level, {q6('quantile_cont(q, 0.5) + 1e-9')} as q from q group by level", "objects")
def median_barycentre(spark, sf_dir):
    """For absolute costs it is the median of the quantile functions."""
    return _quantiles(spark, sf_dir).groupBy("level").agg(r6(F.percentile("q", 0.5) + 1e-9).alias("q"))


@query("K16_barycentre", f"{QUANTILES} select level, {q6('avg(q) + 1e-9')} as q from q group by level", "objects")
def barycentre(spark, sf_dir):
    return _quantiles(spark, sf_dir).groupBy("level").agg(r6(F.avg("q") + 1e-9).alias("q"))


DUALS = f"{shares_sql('plate')}, c as (select plate, bin, v, sum(v) over (partition by plate order by bin rows unbounded preceding) as c from h), s as (select a.plate as i, b.plate as j, a.bin, a.v - b.v as difference, sign(round(a.c - b.c, 12)) as s from c a join c b on a.bin = b.bin and a.plate < b.plate), p as (select i, j, bin, difference, coalesce(-sum(s) over (partition by i, j order by bin rows between unbounded preceding and 1 preceding), 0) as potential from s)"


def _potentials(spark, sf_dir):
    """i, j, bin, difference, potential: Kantorovich potentials for the cost |i - j|, from the signs of the differences of cumulated shares."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def of(a, b):
        signs = F.transform(F.zip_with(X.cumulative(a), X.cumulative(b), lambda x, y: F.round(x - y, 12)), lambda v: F.sign(v))
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda k: F.struct((F.get(a, k) - F.get(b, k)).alias("difference"), (-total(F.slice(signs, F.lit(1), k))).alias("potential")))

    return K.pair_table(_h(spark, sf_dir), "plate", "h", of).select("i", "j", F.posexplode("d").alias("bin", "x")).select("i", "j", "bin", "x.*")


@query("K17_dual_potentials", f"{DUALS} select i, j, bin, {q6('potential')} as potential from p", "objects")
def dual_potentials(spark, sf_dir):
    return _potentials(spark, sf_dir).select("i", "j", "bin", r6(F.col("potential")).alias("potential"))


@query("K18_dual_cost", f"{DUALS} select i, j, {q6('sum(potential * difference)')} as cost from p group by i, j", "objects")
def dual_cost(spark, sf_dir):
    """Equal to the transport cost."""
    return _potentials(spark, sf_dir).groupBy("i", "j").agg(r6(F.sum(F.col("potential") * F.col("difference"))).alias("cost"))


@query("K10_entropic_cost")
def entropic_cost(spark, sf_dir):
    return K.pair_table(_h(spark, sf_dir), "plate", "h", lambda a, b: K.sinkhorn_distance(a, b, 100.0)).select("i", "j", r6(F.col("d")).alias("cost"))


def _with_transport(spark, sf_dir, numeric):
    """Pairs of plates: a numeric part and an entropic transport cost of the histograms, weighted."""
    y = objects(spark, sf_dir).groupBy("plate").agg(F.avg("y").alias("y"))
    both = _h(spark, sf_dir).join(y, "plate").select("plate", F.struct("y", "h").alias("v"))
    d = K.pair_table(both, "plate", "v", lambda a, b: F.struct(numeric(a["y"] - b["y"]).alias("numeric"), K.sinkhorn_distance(a["h"], b["h"]).alias("transport")))
    return d.select("i", "j", r6(F.col("d.numeric")).alias("numeric"), r6(F.col("d.transport")).alias("transport"), r6(0.7 * F.col("d.numeric") + 0.3 * F.col("d.transport")).alias("d"))


@query("K12_squared_with_transport")
def squared_with_transport(spark, sf_dir):
    return _with_transport(spark, sf_dir, lambda v: v * v)


@query("K13_distance_with_transport")
def distance_with_transport(spark, sf_dir):
    return _with_transport(spark, sf_dir, F.abs)


@query("K28_stored_distances", f"{CONDITIONS} select a.condition as i, b.condition as j, {q6('sqrt(sum((a.v - b.v) ** 2))')} as d from m a join m b on a.k = b.k and a.condition < b.condition group by 1, 2", "features")
def stored_distances(spark, sf_dir):
    """Distances written once and read again by the metric's name."""
    import uuid

    d = K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", X.euclidean)
    path = f"{scratch(spark)}/distances-{uuid.uuid4().hex}"
    d.withColumn("metric", F.lit("euclidean")).write.partitionBy("metric").parquet(path)
    return spark.read.parquet(path).where("metric = 'euclidean'").select("i", "j", r6(F.col("d")).alias("d"))


PATHS = "n as (select plate, frame, " + ", ".join(f"count(case when cls = '{c}' then 1 end) / count(*) as p{i}" for i, c in enumerate(("click", "purchase", "view"))) + " from objects group by plate, frame), b as (select plate, min(frame) as lo, (min(frame) + max(frame)) // 2 as mid, max(frame) as hi from n group by plate), v as (select plate, " + ", ".join(f"max(case when frame = {at} then p{i} end) as {at}{i}" for at in ("lo", "mid", "hi") for i in range(3)) + " from n join b using (plate) group by plate)"


def _gap(at):
    return "sqrt(" + " + ".join(f"(a.{at}{i} - b.{at}{i}) ** 2" for i in range(3)) + ")"


def _turn(one, two):
    dot = " + ".join(f"(a.{two}{i} - a.{one}{i}) * (b.{two}{i} - b.{one}{i})" for i in range(3))
    norms = " * ".join("sqrt(" + " + ".join(f"({t}.{two}{i} - {t}.{one}{i}) ** 2" for i in range(3)) + ")" for t in "ab")
    return f"coalesce(acos(greatest(-1, least(1, ({dot}) / nullif({norms}, 0)))), 0)"


@query("K25_path_distances", f"{PATHS} select a.plate as i, b.plate as j, {q6(' + '.join(map(_gap, ('lo', 'mid', 'hi'))) + ' + 0.5 * (' + _turn('lo', 'mid') + ' + ' + _turn('mid', 'hi') + ')')} as d from v a join v b on a.plate < b.plate", "objects")
def path_distances(spark, sf_dir):
    """Distances of the start, the middle and the end of two paths, and half the angles between their two vectors."""
    shares = F.array(*[F.count_if(F.col("cls") == c) / F.count("*") for c in ("click", "purchase", "view")])
    n = objects(spark, sf_dir).groupBy("plate", "frame").agg(shares.alias("p"))
    b = n.groupBy("plate").agg(F.min("frame").alias("lo"), F.floor((F.min("frame") + F.max("frame")) / 2).alias("mid"), F.max("frame").alias("hi"))
    at = lambda c: F.max(F.when(F.col("frame") == F.col(c), F.col("p"))).alias(c)
    v = n.join(F.broadcast(b), "plate").groupBy("plate").agg(at("lo"), at("mid"), at("hi")).select("plate", F.struct("lo", "mid", "hi").alias("v"))
    step = lambda t, one, two: F.zip_with(t[two], t[one], lambda x, y: x - y)

    def turn(a, b, one, two):
        p, q = step(a, one, two), step(b, one, two)
        norms = F.sqrt(X.dot(p, p)) * F.sqrt(X.dot(q, q))
        return F.coalesce(F.acos(X.clamp(X.dot(p, q) / F.when(norms != 0, norms))), F.lit(0.0))

    distance = lambda a, b: sum((X.euclidean(a[c], b[c]) for c in ("lo", "mid", "hi")), F.lit(0.0)) + 0.5 * (turn(a, b, "lo", "mid") + turn(a, b, "mid", "hi"))
    return K.pair_table(v, "plate", "v", distance).select("i", "j", r6(F.col("d")).alias("d"))


# ---- L, M: clusters

STEPS = 3


def lloyd_sql(name: str, k: int, seed: int) -> str:
    """name_a (exp, label, d) after STEPS rounds from k rows in a seeded order."""
    parts = [f"{name}_s as (select exp, (row_number() over (order by {SEEDED('exp', seed)}, exp) - 1) as label from (select distinct exp from u)), {name}_0 as (select label, k, v as c from u join {name}_s using (exp) where label < {k})"]
    for i in range(STEPS):
        parts.append(f"{name}_d{i} as (select exp, label, sqrt(sum((v - c) ** 2)) as d from u join {name}_{i} using (k) group by exp, label), {name}_a{i} as (select exp, label from {name}_d{i} qualify row_number() over (partition by exp order by round(d, 9), label) = 1), {name}_{i + 1} as (select label, k, avg(v) as c from u join {name}_a{i} using (exp) group by label, k)")
    parts.append(f"{name}_d as (select exp, label, sqrt(sum((v - c) ** 2)) as d from u join {name}_{STEPS} using (k) group by exp, label), {name}_a as (select exp, label, d from {name}_d qualify row_number() over (partition by exp order by round(d, 9), label) = 1)")
    return ", ".join(parts)


def _lloyd(spark, sf_dir, k, seed):
    rows = features(spark, sf_dir)
    return L.lloyd(rows, L.first_centres(rows, k, seed), STEPS)


@query("L17_lloyd", f"{UNNESTED}, {lloyd_sql('x', 3, 1)} select exp, label, {q6('d')} as d from x_a", "features")
def lloyd(spark, sf_dir):
    return _lloyd(spark, sf_dir, 3, 1).select("exp", "label", r6(F.col("d")).alias("d"))


RESTARTS = (1, 2, 3)


@query("L16_restarts", f"{UNNESTED}, " + ", ".join(lloyd_sql(f"x{s}", 3, s) for s in RESTARTS) + ", i as (" + " union all ".join(f"select {s} as seed, sum(d * d) as inertia from x{s}_a" for s in RESTARTS) + f") select seed, {q6('inertia')} as inertia, row_number() over (order by inertia, seed) = 1 as best from i", "features")
def restarts(spark, sf_dir):
    """Lloyd from several seeds; the smallest inertia is the best."""
    runs = [_lloyd(spark, sf_dir, 3, s).agg(F.sum(F.col("d") * F.col("d")).alias("inertia")).select(F.lit(s).alias("seed"), "inertia") for s in RESTARTS]
    every = runs[0].union(runs[1]).union(runs[2])
    return every.select("seed", r6(F.col("inertia")).alias("inertia"), (F.row_number().over(W.orderBy("inertia", "seed")) == 1).alias("best"))  # a row for each restart


@query("L25_normalised_inertia", f"{UNNESTED}, " + ", ".join(lloyd_sql(f"x{k}", k, 1) for k in (2, 4)) + ", t as (select sum(s) as total from (select k, var_pop(v) * count(*) as s from u group by k)), i as (" + " union all ".join(f"select {k} as clusters, sum(d * d) as inertia from x{k}_a" for k in (2, 4)) + f") select clusters, {q6('inertia / total')} as inertia from i, t", "features")
def normalised_inertia(spark, sf_dir):
    total = C.long_features(features(spark, sf_dir), []).groupBy("i").agg((F.var_pop("v") * F.count("*")).alias("s")).agg(F.sum("s").alias("total"))
    runs = [_lloyd(spark, sf_dir, k, 1).agg(F.sum(F.col("d") * F.col("d")).alias("inertia")).select(F.lit(k).alias("clusters"), "inertia") for k in (2, 4)]
    return runs[0].union(runs[1]).crossJoin(F.broadcast(total)).select("clusters", r6(F.col("inertia") / F.col("total")).alias("inertia"))


@query("L20_first_centres", f"r as (select exp, row_number() over (order by {SEEDED('exp', 1)}, exp) as a, row_number() over (order by exp) as b from features) select 'random' as kind, (a - 1)::int as label, exp from r where a <= 4 union all select 'first', (b - 1)::int, exp from r where b <= 4", "features")
def first_centres(spark, sf_dir):
    """Initial centres by kind: at random, or the first rows."""
    rows = features(spark, sf_dir).select("exp")
    number = lambda order: (F.row_number().over(W.orderBy(*order)) - 1).alias("label")  # noqa: E731  over four rows
    seeded = (samples.order("exp", 1), F.col("exp"))
    random = samples.first_n(rows, "exp", 4, 1).select(F.lit("random").alias("kind"), number(seeded), "exp")
    return random.union(rows.orderBy("exp").limit(4).select(F.lit("first"), number(("exp",)), "exp"))


@query("L23_incremental_centres", f"{UNNESTED}, p as (select condition, plate, k, sum(v) as s, count(*) as n from u group by all) select condition, plate, (k - 1)::int as i, {q6('sum(s) over w / sum(n) over w')} as centre from p window w as (partition by condition, k order by plate rows unbounded preceding)", "features")
def incremental_centres(spark, sf_dir):
    """Centres as batches (plates) come in: old sums and counts plus new ones."""
    p = C.long_features(features(spark, sf_dir), ["condition", "plate"]).groupBy("condition", "plate", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    upto = W.partitionBy("condition", "i").orderBy("plate").rowsBetween(W.unboundedPreceding, 0)
    return p.select("condition", "plate", "i", r6(F.sum("s").over(upto) / F.sum("n").over(upto)).alias("centre"))


@query("L38_prepared_training_set", f"{UNNESTED}, s as (select k, avg(v) as m, stddev_pop(v) as s from u group by k), o as (select exp, row_number() over (partition by exp % 16 order by {SEEDED('exp', 5)}, exp)::int as place from features) select exp, exp % 16 as block, place, (k - 1)::int as i, {q6('(v - m) / nullif(s, 0)')} as z from u join s using (k) join o using (exp) where v is not null", "features")
def prepared_training_set(spark, sf_dir):
    """Shuffled within blocks, without missing values, z-scored."""
    place = F.row_number().over(W.partitionBy(F.col("exp") % 16).orderBy(samples.order("exp", 5), "exp"))
    rows = features(spark, sf_dir).select("exp", "f").withColumn("place", place)
    z = C.z_scores(C.long_features(rows, ["exp", "place"]).where("v is not null"), ["i"], "v", F.lit(True))
    return z.select("exp", (F.col("exp") % 16).alias("block"), "place", "i", r6(F.col("z")).alias("z"))


@query("L40_ward")
def ward(spark, sf_dir):
    return L.ward_clusters(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition")


@query("L42_positives", f"{UNNESTED}, s as (select exp, plate, sum(case when k % 2 = 0 then v else -v end) as s from u group by exp, plate), i as (select plate, count(*) as initial from objects where frame = 0 group by plate) select plate, count(case when s > 0 then 1 end) as positives, {q6('count(case when s > 0 then 1 end) / any_value(initial)')} as ratio from s join i using (plate) group by plate", "features objects")
def positives(spark, sf_dir):
    """A stored linear classifier (weights alternate in sign): positives over the initial object count."""
    score = F.aggregate(F.transform("f", lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0.0), lambda s, v: s + v)
    n = features(spark, sf_dir).groupBy("plate").agg(F.count_if(score > 0).alias("positives"))
    initial = objects(spark, sf_dir).where("frame = 0").groupBy("plate").agg(F.count("*").alias("initial"))
    return n.join(initial, "plate").select("plate", "positives", r6(F.col("positives") / F.col("initial")).alias("ratio"))


@query("M15_stacked_conditions", f"select 'batch' as kind, batch as condition, gene, {q6('max(measure)')} as score from screen group by batch, gene union all select 'plate', plate, gene, {q6('max(measure)')} from screen group by plate, gene", "screen")
def stacked_conditions(spark, sf_dir):
    rows = screen(spark, sf_dir)
    part = lambda c: rows.groupBy(F.lit(c).alias("kind"), F.col(c).cast("bigint").alias("condition"), "gene").agg(r6(F.max("measure")).alias("score"))
    return part("batch").union(part("plate"))


def _judged_by_controls(rows):
    """exp, plate, condition, hit: whether an experiment lies further from the controls' mean than nine tenths of these."""
    control = L.mean_vectors(rows.where("is_control"), ["is_control"]).select(F.col("f").alias("c"))
    d = rows.crossJoin(F.broadcast(control)).select("exp", "plate", "condition", "is_control", X.euclidean(F.col("f"), F.col("c")).alias("d"))
    t = S.quantiles(d.where("is_control"), [], "d", {"t": 0.9})
    return d.crossJoin(F.broadcast(t)).select("exp", "plate", "condition", (F.col("d") > F.col("t")).alias("hit"))


@query("M22_clusters_with_hits")
def clusters_with_hits(spark, sf_dir):
    """Ward clusters of conditions, the share of their experiments that lie further from the controls than nine tenths of these, and whether it is over a half."""
    rows = features(spark, sf_dir)
    hits = _judged_by_controls(rows).groupBy("condition").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    clusters = L.ward_clusters(L.mean_vectors(rows, ["condition"]), "condition")
    share = F.sum("h") / F.sum("n")
    return clusters.join(hits, "condition").groupBy("cluster").agg(F.count("*").alias("conditions"), r6(share).alias("hit_ratio"), (share > 0.5).alias("kept"))


@query("M23_hits_in_clusters", f"{UNNESTED}, {lloyd_sql('x', 4, 1)}, c as (select k, avg(v) as c from u where is_control group by k), d as (select exp, plate, condition, is_control, sqrt(sum((v - c) ** 2)) as away from u join c using (k) group by exp, plate, condition, is_control), t as (select quantile_cont(away, 0.9) as t from d where is_control), h as (select exp, plate, condition, away > t as hit from d, t), y as (select label, plate, condition from h join x_a using (exp) where hit and condition in (select condition from h group by condition having avg(hit::int) > 0.5)) select label::int as cluster, 'condition' as kind, condition::bigint as value, count(*) as hits from y group by label, condition union all select label::int, 'plate', plate::bigint, count(*) from y group by label, plate", "features")
def hits_in_clusters(spark, sf_dir):
    """Clusters of experiments (not of conditions), and how many hits of each condition and of each plate they hold. Hits count where over a half
    of their condition's experiments are hits."""
    rows = features(spark, sf_dir)
    judged = _judged_by_controls(rows)
    kept = judged.groupBy("condition").agg(F.avg(F.col("hit").cast("int")).alias("share")).where("share > 0.5").select("condition")
    hits = judged.where("hit").join(kept, "condition").join(_lloyd(spark, sf_dir, 4, 1).select("exp", "label"), "exp")
    count = lambda c: hits.groupBy(F.col("label").cast("int").alias("cluster"), F.lit(c).alias("kind"), F.col(c).cast("bigint").alias("value")).agg(F.count("*").alias("hits"))
    return count("condition").union(count("plate"))


@query("M26_ranked_genes", f"p as (select batch, gene, median(measure) as v from screen group by batch, gene), r as (select gene, row_number() over (partition by batch order by v, gene) as r from p), o as (select gene, round(exp(sum(ln(r)) / count(*)), 6) as rank_product from r group by gene) select gene, rank_product, row_number() over (order by rank_product, gene)::int as rank from o", "screen")
def ranked_genes(spark, sf_dir):
    o = M.rank_product(screen(spark, sf_dir), "gene", "batch", "measure", missing=False).select("gene", F.round("rank_product", 6).alias("rank_product"))
    return S.row_numbers(o, "rank_product", "gene", "rank").select("gene", "rank_product", F.col("rank").cast("int").alias("rank"))


# ---- N: links


@query("N02_candidates_with_truth", f"{MUTUAL} select c.plate, c.frame, c.label, c.to_label, {q6('c.d')} as d, l.label is not null as truth from c left join l using (label, to_label)", "objects")
def candidates_with_truth(spark, sf_dir):
    return _linked(spark, sf_dir).select("plate", "frame", "label", "to_label", r6(F.col("d")).alias("d"), F.coalesce(F.col("link") == F.col("to_label"), F.lit(False)).alias("truth"))


@query("N04_attached_markers", f"m as (select plate, frame, label as marker, x + 1 as x, y - 1 as y from objects where label % 13 = 0), c as (select marker, o.label, sqrt((o.x - m.x) ** 2 + (o.y - m.y) ** 2) as d from m join objects o on o.plate = m.plate and o.frame = m.frame and abs(o.x - m.x) <= 8 and abs(o.y - m.y) <= 8) select marker, label, {q6('d')} as d from c where d <= 8 qualify row_number() over (partition by marker order by round(d, 9), label) = 1", "objects")
def attached_markers(spark, sf_dir):
    """Annotated points and the nearest object of their frame."""
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y")
    markers = rows.where("label % 13 = 0").withColumns({"x": F.col("x") + 1, "y": F.col("y") - 1})
    keys = ["plate", "frame"]
    near = A.nearest(stored(A.places(markers, keys), "markers"), stored(A.places(rows, keys), "places"), keys, RADIUS, by=F.round("d", 9))
    return A.members(near, markers, keys).select(F.col("label").alias("marker"), F.col("to_label").alias("label"), r6(F.col("d")).alias("d"))


@query("N32_accuracy_by_fold", f"{ACCURACY} select (frame % 5)::int as fold, sum(y)::bigint as truth, {q6('sum(y * z) / nullif(sum(y), 0)')} as accuracy from t group by 1", "objects")
def accuracy_by_fold(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy((F.col("frame") % 5).alias("fold")).agg(F.sum("truth").alias("truth"), r6(F.sum("correct") / F.nullif(F.sum("truth"), F.lit(0))).alias("accuracy"))


@query("N13_optimal_links")
def optimal_links(spark, sf_dir):
    return A.optimal_links(_candidates(spark, sf_dir), ["plate", "frame"], RADIUS).select("plate", "frame", "label", "to_label", r6(F.col("d")).alias("d"))
