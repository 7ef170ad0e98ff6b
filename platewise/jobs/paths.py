"""Clustering of tracks by mixed distances (letter L): seeding, splitting, mini-batches, and numbers of clusters chosen by stability."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.expressions import norm
from platewise.model import q6, query, r6, screen, track_points
from platewise.operators import mixed as X
from platewise.operators import statistics as S
from platewise.sources import stored

#: A track's numeric part, the shares of its step lengths in BINS bins, and the shares of its steps' quadrants.
BINS, QUADRANTS, SEED = 5, 4, 3
KINDS, WEIGHTS, SIZES = ["euclidean", "hellinger", "total_variation"], [0.4, 0.4, 0.2], [3, BINS, QUADRANTS]
HELLINGER = ["euclidean", "hellinger", "hellinger"]

PATHS = f"""st as (select plate, track_id, x, y, x - lag(x) over w as dx, y - lag(y) over w as dy from track_points window w as (partition by track_id order by frame)),
sd as (select *, sqrt(dx * dx + dy * dy) as d from st), tm as (select max(d) as top from sd),
tr as (select plate, track_id, avg(x) as a, avg(y) as b, avg(d) as c, count(d) as n from sd group by plate, track_id having count(d) >= 2),
zs as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc from tr),
hb as (select track_id, least(floor(d / (top / {BINS})), {BINS - 1})::int as i, count(*) as n from sd, tm where d is not null group by all),
qb as (select track_id, (dx >= 0)::int * 2 + (dy >= 0)::int as i, count(*) as n from sd where d is not null group by all),
u as materialized (select plate as movie, track_id as key, 0 as p, 0 as i, (a - ma) / sa as v from tr, zs union all select plate, track_id, 0, 1, (b - mb) / sb from tr, zs union all select plate, track_id, 0, 2, (c - mc) / sc from tr, zs
union all select plate, track_id, 1, g.i, coalesce(hb.n, 0) / tr.n from tr cross join (select unnest(range({BINS}))::int as i) g left join hb using (track_id, i)
union all select plate, track_id, 2, g.i, coalesce(qb.n, 0) / tr.n from tr cross join (select unnest(range({QUADRANTS}))::int as i) g left join qb using (track_id, i))"""
DIST = X.distance_sql(KINDS, WEIGHTS)


def paths(spark, sf_dir):
    """plate, track_id, parts, of tracks with two steps at least. Numeric parts are z-scores over all tracks."""
    w = W.partitionBy("track_id").orderBy("frame")
    rows = track_points(spark, sf_dir).select("plate", "track_id", "x", "y", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    steps = stored(rows.withColumn("d", norm(F.col("dx"), F.col("dy"))), "steps")
    top = steps.agg(F.max("d").alias("top"))
    length, quadrant = F.least(F.floor(F.col("d") / (F.col("top") / BINS)), F.lit(BINS - 1)), F.when(F.col("dx") >= 0, 2).otherwise(0) + F.when(F.col("dy") >= 0, 1).otherwise(0)
    share = lambda of, size: F.array(*[F.count_if(F.col("d").isNotNull() & (of == i)) / F.count("d") for i in range(size)])
    tracks = steps.crossJoin(F.broadcast(top)).groupBy("plate", "track_id").agg(F.avg("x").alias("a"), F.avg("y").alias("b"), F.avg("d").alias("c"), F.count("d").alias("n"), share(length, BINS).alias("h"), share(quadrant, QUADRANTS).alias("q")).where("n >= 2")
    tracks = stored(tracks, "paths")
    z = tracks.agg(*[f(c).alias(f"{n}{c}") for c in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    numeric = F.array(*[(F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}") for c in "abc"])
    return stored(tracks.crossJoin(F.broadcast(z)).select("plate", "track_id", F.array(numeric, "h", "q").alias("parts")), "paths")


@query("L18_seeds", f"{PATHS}, {X.seeds_sql('s', 'u', DIST, 5, SEED)} select label, key as track_id, {q6('potential')} as potential from s_c", "track_points")
def seeds(spark, sf_dir):
    """Five centres, each drawn in proportion to the distance from those before it, and the potential that it leaves."""
    found = X.seeds(paths(spark, sf_dir), "track_id", KINDS, WEIGHTS, 5, SEED)
    return spark.createDataFrame([(i, key, round(v, 6) + 0.0) for i, (key, _, v) in enumerate(found)], "label int, track_id bigint, potential double")


@query("L19_split_largest", f"{PATHS}, {X.split_sweep_sql('s', 'u', DIST, 4, SEED)} select k, key as track_id, label, {q6('d')} as d from s_k", "track_points")
def split_largest(spark, sf_dir):
    """Two, three and four clusters, each the last with its largest cluster split."""
    got = X.split_sweep(paths(spark, sf_dir), "track_id", KINDS, WEIGHTS, 4, SEED)
    return got.select("k", F.col("key").alias("track_id"), "label", r6(F.col("d")).alias("d"))


BATCH, ROUNDS, CLUSTERS = 64, 3, 4


@query("L15_mini_batches", f"{PATHS}, {X.mini_batches_sql('b', 'u', KINDS, WEIGHTS, CLUSTERS, BATCH, ROUNDS, SEED)}, a as ({X.assigned_sql('u', 'b_w', DIST)}) select key as track_id, label, {q6('d')} as d from a", "track_points")
def mini_batches(spark, sf_dir):
    """All tracks, each at the nearest centre of mini-batch clustering."""
    rows = paths(spark, sf_dir)
    centres = X.mini_batches(rows, "track_id", KINDS, WEIGHTS, CLUSTERS, BATCH, ROUNDS, SEED)
    return X.assigned(rows, [(label, parts) for label, parts, _ in centres], KINDS, WEIGHTS).select("track_id", "label", r6(F.col("d")).alias("d"))


@query("L15_mini_batch_centres", f"{PATHS}, {X.mini_batches_sql('b', 'u', KINDS, WEIGHTS, CLUSTERS, BATCH, ROUNDS, SEED)} select label, p as part, i, {q6('v')} as v, n from b_w", "track_points")
def mini_batch_centres(spark, sf_dir):
    """The centres and the numbers of rows they have seen; each histogram keeps its mass of 1."""
    centres = X.mini_batches(paths(spark, sf_dir), "track_id", KINDS, WEIGHTS, CLUSTERS, BATCH, ROUNDS, SEED)
    return spark.createDataFrame([(label, p, i, round(v, 6) + 0.0, n) for label, parts, n in centres for p, part in enumerate(parts) for i, v in enumerate(part)], "label int, part int, i int, v double, n double")


RUNS, LLOYD = X.runs_of((2, 3, 4), 3), 3
KEYED = X.keyed_sql("k", "u", HELLINGER, WEIGHTS, RUNS, LLOYD, SEED)


def _clustered(spark, sf_dir):
    return stored(X.keyed_clusters(paths(spark, sf_dir), "plate", "track_id", X.Space(HELLINGER, WEIGHTS, SIZES), RUNS, LLOYD, SEED), "clustered")


def _chosen(clustered):
    """movie, key, e, label, d: of the run over all rows with the chosen number of clusters."""
    run = F.create_map(*[x for r, k, s in RUNS if s == 0 for x in (F.lit(k), F.lit(r))])
    best = X.stability(clustered, RUNS).where("chosen").select("movie", F.element_at(run, F.col("k")).alias("run"))
    rows = clustered.select("movie", "key", "e", F.explode("labels").alias("l")).select("movie", "key", "e", "l.*")
    return rows.join(best, ["movie", "run"])


@query("L27_chosen_clusters", f"{PATHS}, {KEYED} select movie as plate, k, {q6('stability')} as stability, {q6('deviation')} as deviation, chosen from k_k", "track_points")
def chosen_clusters(spark, sf_dir):
    """For each movie and number of clusters, how stable the clusters of its tracks are, and which number is chosen."""
    got = X.stability(_clustered(spark, sf_dir), RUNS)
    return got.select(F.col("movie").alias("plate"), "k", r6(F.col("stability")).alias("stability"), r6(F.col("deviation")).alias("deviation"), "chosen")


#: Rows of a cluster that represent it.
NEAREST = 10
REPRESENTED = f"{PATHS}, {KEYED}, rep as materialized (select a.movie, a.key, a.label from k_a a join k_k k on k.movie = a.movie and k.k = a.k and k.chosen where a.s = 0 qualify row_number() over (partition by a.movie, a.label order by round(a.d, 9), a.key) <= {NEAREST})"
ACROSS = X.runs_of((3,), 0)


@query("L27_representatives", f"{REPRESENTED} select movie as plate, label, key as track_id from rep", "track_points")
def representatives(spark, sf_dir):
    """The tracks nearest to the centre of each cluster of their movie."""
    return _representatives(spark, sf_dir).select(F.col("movie").alias("plate"), "label", F.col("key").alias("track_id"))


def _representatives(spark, sf_dir):
    nearest = F.row_number().over(W.partitionBy("movie", "label").orderBy(F.round("d", 9), "key"))
    return _chosen(_clustered(spark, sf_dir)).withColumn("place", nearest).where(F.col("place") <= NEAREST)


@query("L28_across_movies", f"{REPRESENTED}, one as materialized (select 0 as movie, key, p, i, v from u join rep using (key)), {X.keyed_sql('x', 'one', HELLINGER, WEIGHTS, ACROSS, LLOYD, SEED)} select rep.movie as plate, key as track_id, rep.label as cluster, a.label as label, {q6('a.d')} as d from x_a a join rep using (key)", "track_points")
def across_movies(spark, sf_dir):
    """The representatives of all movies, clustered together."""
    all_paths = paths(spark, sf_dir)
    chosen = stored(_representatives(spark, sf_dir).select("key", F.col("movie").alias("plate"), F.col("label").alias("cluster")), "representatives")
    rows = all_paths.withColumnRenamed("track_id", "key").drop("plate").join(chosen, "key").withColumn("one", F.lit(0))
    got = X.keyed_clusters(rows, "one", "key", X.Space(HELLINGER, WEIGHTS, SIZES), ACROSS, LLOYD, SEED)
    got = got.select("key", F.explode("labels").alias("l")).select("key", "l.label", "l.d")
    return got.join(chosen, "key").select("plate", F.col("key").alias("track_id"), "cluster", "label", r6(F.col("d")).alias("d"))


QUANTILES = 8
SIRNAS = f"q as (select {', '.join(f'quantile_cont(measure, {j / QUANTILES}) as q{j}' for j in range(1, QUANTILES))} from screen), b as (select sirna, {' + '.join(f'(measure > q{j})::int' for j in range(1, QUANTILES))} as i from screen, q), t as (select sirna, count(*) as n from b group by sirna), n as (select sirna, i, count(*) as n from b group by all), u as materialized (select 0 as movie, t.sirna as key, 0 as p, g.i, coalesce(n.n, 0) / t.n as v from t cross join (select unnest(range({QUANTILES}))::int as i) g left join n on n.sirna = t.sirna and n.i = g.i)"


@query("L31_experiment_clusters", f"{SIRNAS}, {X.keyed_sql('k', 'u', ['hellinger'], [1.0], RUNS, LLOYD, SEED)} select k, {q6('stability')} as stability, {q6('deviation')} as deviation, chosen from k_k", "screen")
def experiment_clusters(spark, sf_dir):
    """Experiments by the histograms of their measure (bins of equal frequency), and the stability of two to four clusters of them."""
    rows = screen(spark, sf_dir).select("sirna", "measure")
    q = S.quantiles(rows, [], "measure", {f"q{j}": j / QUANTILES for j in range(1, QUANTILES)})
    at = sum((F.when(F.col("measure") > F.col(f"q{j}"), 1).otherwise(0) for j in range(1, QUANTILES)), F.lit(0))
    binned = rows.crossJoin(F.broadcast(q)).select("sirna", at.alias("i"))
    h = binned.groupBy("sirna").agg(F.array(F.array(*[F.count_if(F.col("i") == i) / F.count("*") for i in range(QUANTILES)])).alias("parts")).withColumn("one", F.lit(0))
    got = X.keyed_clusters(h, "one", "sirna", X.Space(["hellinger"], [1.0], [QUANTILES]), RUNS, LLOYD, SEED)
    return X.stability(stored(got, "clustered"), RUNS).select("k", r6(F.col("stability")).alias("stability"), r6(F.col("deviation")).alias("deviation"), "chosen")
