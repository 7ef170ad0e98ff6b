"""Clustering by mixed distances: a numeric part and histograms, each with its own divergence and its own barycentre.

A row has a key and parts: an array of arrays, the first numeric, the others shares. Distances are weighted sums over the parts. Seeding
draws rows in proportion to their distance by running sums over ranges of keys; mini-batches update counted centres; and keyed clustering
runs all movies, all numbers of clusters and all subsamples at once. Rows with a null key are left out, as nothing can name them.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.operators import samples
from platewise.operators.statistics import RANGE_ROWS
from platewise.sources import stored

DIVERGENCES = {"euclidean": X.euclidean, "hellinger": X.hellinger, "total_variation": X.total_variation, "transport": X.emd_1d}


def distance(a: Column, b: Column, kinds: list[str], weights: list[float]) -> Column:
    return reduce(lambda s, d: s + d, (F.lit(w) * DIVERGENCES[kind](a[p], b[p]) for p, (kind, w) in enumerate(zip(kinds, weights, strict=True)) if w))


def distance_sql(kinds: list[str], weights: list[float], a: str = "u.v", b: str = "c.v") -> str:
    """The same over rows (p, i, v) of two relations that are joined on p and i. Transport has no such form."""
    terms = {"euclidean": "sqrt(sum(case when p = {p} then ({a} - {b}) ** 2 else 0 end))", "hellinger": "sqrt(sum(case when p = {p} then (sqrt({a}) - sqrt({b})) ** 2 else 0 end) / 2)", "total_variation": "sum(case when p = {p} then abs({a} - {b}) else 0 end)"}
    return " + ".join(f"{w} * {terms[kind]}".format(p=p, a=a, b=b) for p, (kind, w) in enumerate(zip(kinds, weights, strict=True)) if w)


def uniform(*parts) -> float:
    """In [0, 1): the first 52 bits of the MD5 of what is given."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def trials_of(k: int) -> int:
    return 2 + int(math.log(k))


def _literal(parts: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in part]) for part in parts])


# ---- seeding


def seeds(rows: DataFrame, key: str, kinds: list[str], weights: list[float], k: int, seed: int) -> list[tuple[object, list, float]]:
    """k centres as (key, parts, potential), fewer where there are fewer distinct rows. The first is a row at random. For each of the others
    trials_of(k) rows are drawn in proportion to their distance from the nearest centre, and the one that leaves the smallest potential stays.
    Distances from the first centre are squared, later ones are not. Sums run over ranges of keys: no task orders all rows, and only the
    candidates and their potentials reach the driver."""
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "parts")
    first = rows.orderBy(samples.order("key", seed), "key").first()
    if first is None:
        return []
    gap = distance(F.col("parts"), _literal(first["parts"]), kinds, weights)
    ranges = -(-rows.count() // RANGE_ROWS)
    placed = rows.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()) if ranges > 1 else rows.withColumn("range", F.lit(0))
    state = stored(placed.withColumn("closest", gap * gap), "seeding")
    sums = state.groupBy("range").agg(F.sum("closest").alias("s"))
    out = [(first["key"], first["parts"], sums.agg(F.sum("s")).first()[0])]
    for step in range(1, k):
        total = out[-1][2]
        if not total > 0:
            break  # every row is a centre already
        offset = sums.select("range", F.coalesce(F.sum("s").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("offset"))  # a row for each range
        upto = F.sum("closest").over(W.partitionBy("range").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
        summed = state.join(F.broadcast(offset), "range").withColumn("upto", F.col("offset") + upto)
        draws = [uniform(seed, step, t) * total for t in range(trials_of(k))]
        last = F.max(F.when(F.col("closest") > 0, F.struct("key", "parts")))  # where rounding leaves a draw beyond the last sum
        drawn = summed.agg(*[F.coalesce(F.min(F.when(F.col("upto") >= v, F.struct("key", "parts"))), last).alias(f"t{t}") for t, v in enumerate(draws)]).first()
        closest = F.array(*[F.least("closest", distance(F.col("parts"), _literal(c["parts"]), kinds, weights)) for c in drawn])
        state = stored(state.withColumn("closest", closest), "seeding")
        left = state.groupBy("range").agg(*[F.sum(F.col("closest")[t]).alias(f"s{t}") for t in range(len(draws))])
        potentials = [round(v, 9) for v in left.agg(*[F.sum(c) for c in left.columns[1:]]).first()]
        best = potentials.index(min(potentials))
        state, sums = state.withColumn("closest", F.col("closest")[best]), left.select("range", F.col(f"s{best}").alias("s"))
        out.append((drawn[best]["key"], drawn[best]["parts"], sums.agg(F.sum("s")).first()[0]))
    return out


def seeds_sql(name: str, rows: str, dist: str, k: int, seed: int) -> str:
    """CTEs over rows (key, p, i, v): name_c (label, key, potential)."""
    t = trials_of(k)
    parts = [f"{name}_c0 as (select key from (select distinct key from {rows}) order by {samples.order_sql('key', seed)}, key limit 1)", f"{name}_s1 as (select u.key, ({dist}) ** 2 as closest from {rows} u join {rows} c using (p, i) join {name}_c0 z on c.key = z.key group by u.key)"]
    for step in range(1, k):
        draws = ", ".join(f"({j}, {uniform(seed, step, j)!r}::double)" for j in range(t))
        parts.append(f"{name}_u{step} as (select key, sum(closest) over (order by key rows unbounded preceding) as upto, sum(closest) over () as total from {name}_s{step}), {name}_t{step} as (select t, min(key) as key from {name}_u{step}, (values {draws}) r(t, x) where upto >= x * total group by t), {name}_d{step} as (select u.key, z.t, {dist} as d from {rows} u join {rows} c using (p, i) join {name}_t{step} z on c.key = z.key group by u.key, z.t), {name}_n{step} as (select d.key, t, least(closest, d) as closest from {name}_d{step} d join {name}_s{step} using (key)), {name}_b{step} as (select t, sum(closest) as potential from {name}_n{step} group by t order by round(sum(closest), 9), t limit 1), {name}_s{step + 1} as (select key, closest from {name}_n{step} join {name}_b{step} using (t))")
    chosen = [f"select 0 as label, key, (select sum(closest) from {name}_s1) as potential from {name}_c0"] + [f"select {s}, key, potential from {name}_t{s} join {name}_b{s} using (t)" for s in range(1, k)]
    return ", ".join(parts) + f", {name}_c as ({' union all '.join(chosen)})"


# ---- assignment


def assigned(rows: DataFrame, centres: list[tuple[int, list]], kinds: list[str], weights: list[float]) -> DataFrame:
    """Adds label and d of the nearest of centres (label, parts), the smallest label of equals."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), _literal(parts).alias("parts")) for label, parts in centres])
    best = F.array_min(F.transform(table, lambda c: F.struct(F.round(distance(F.col("parts"), c["parts"], kinds, weights), 9).alias("r"), c["label"].alias("label"), distance(F.col("parts"), c["parts"], kinds, weights).alias("d"))))
    return rows.withColumn("best ", best).select("*", F.col("best ")["label"].alias("label"), F.col("best ")["d"].alias("d")).drop("best ")


def assigned_sql(rows: str, centres: str, dist: str, key: str = "key") -> str:
    """select key, label, d from rows (key, p, i, v) and centres (label, p, i, v)."""
    return f"select u.{key}, c.label, {dist} as d from {rows} u join {centres} c using (p, i) group by u.{key}, c.label qualify row_number() over (partition by u.{key} order by round({dist}, 9), c.label) = 1"


# ---- splitting the largest cluster


def split_sweep(rows: DataFrame, key: str, kinds: list[str], weights: list[float], most: int, seed: int) -> DataFrame:
    """k, key, label, d for k = 2..most: two seeds at first; then the largest cluster (of equals, the smallest label) is seeded and assigned
    anew, its label and a new one, while the others' rows are not read again."""
    rows = rows.select(F.col(key).alias("key"), "parts")
    found = seeds(rows, "key", kinds, weights, 2, seed)
    if not found:
        return rows.select(F.lit(2).alias("k"), "key", F.lit(0).alias("label"), F.lit(0.0).alias("d")).limit(0)
    now = stored(assigned(rows, [(i, parts) for i, (_, parts, _) in enumerate(found)], kinds, weights), "split")
    out = [now.select(F.lit(2).alias("k"), "key", "label", "d")]
    for k in range(3, most + 1):
        largest = now.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()  # of k - 1 rows
        if largest is None:
            break
        members = now.where(F.col("label") == largest["label"])
        two = seeds(members, "key", kinds, weights, 2, seed + k)
        again = assigned(members.select("key", "parts"), list(zip((largest["label"], k - 1), (parts for _, parts, _ in two), strict=False)), kinds, weights)
        now = now.where(F.col("label") != largest["label"]).unionByName(stored(again, "split"))
        out.append(now.select(F.lit(k).alias("k"), "key", "label", "d"))
    return reduce(DataFrame.unionByName, out)


def split_sweep_sql(name: str, rows: str, dist: str, most: int, seed: int) -> str:
    """CTEs: name_k (k, key, label, d)."""
    centres = lambda n, labels: f"select case s.label {labels} end as label, p, i, v from {n}_c s join {rows} using (key)"
    parts = [f"{seeds_sql(f'{name}2', rows, dist, 2, seed)}, {name}2_w as ({centres(f'{name}2', 'when 0 then 0 else 1')}), {name}2_a as ({assigned_sql(rows, f'{name}2_w', dist)})"]
    for k in range(3, most + 1):
        old, new = f"{name}{k - 1}", f"{name}{k}"
        parts.append(f"{new}_l as (select label from {old}_a group by label order by count(*) desc, label limit 1), {new}_m as (select r.* from {rows} r join {old}_a using (key) join {new}_l using (label)), {seeds_sql(new, f'{new}_m', dist, 2, seed + k)}, {new}_w as ({centres(new, f'when 0 then (select label from {new}_l) else {k - 1}')}), {new}_g as ({assigned_sql(f'{new}_m', f'{new}_w', dist)}), {new}_a as (select * from {old}_a where label not in (select label from {new}_l) union all select * from {new}_g)")
    return ", ".join(parts) + f", {name}_k as (" + " union all ".join(f"select {k} as k, key, label, d from {name}{k}_a" for k in range(2, most + 1)) + ")"


# ---- mini-batches


#: A centre that has seen less than this share of what the largest has is starved.
STARVED = 0.1


def _barycentre(kind: str, held: list[float], n: float, got: list[tuple[float, float, float]]) -> list[float]:
    """A part of a centre that had n rows, with the sums, the sums of roots, or the weighted medians of new ones (sum, roots, median, m)."""
    m = got[0][3]
    if kind == "euclidean":
        return [(n * c + s) / (n + m) for c, (s, _, _, _) in zip(held, got, strict=True)]
    if kind == "hellinger":
        new = [((n * math.sqrt(c) + r) / (n + m)) ** 2 for c, (_, r, _, _) in zip(held, got, strict=True)]
    elif kind == "total_variation":
        new = [median for _, _, median, _ in got]
    else:  # transport: in one dimension, the mean of the cumulative shares
        new = [(n * c + s) / (n + m) for c, (s, _, _, _) in zip(held, got, strict=True)]
    mass = sum(new)
    return [v / mass for v in new] if mass > 0 else held


def mini_batches(rows: DataFrame, key: str, kinds: list[str], weights: list[float], k: int, size: int, rounds: int, seed: int) -> list[tuple[int, list, float]]:
    """Centres (label, parts, count) after rounds batches of size rows in a seeded order. A centre keeps the number of rows it has seen; its
    numeric part is their mean, a histogram the barycentre of its divergence (Hellinger: squared mean root; total variation: weighted
    median of the old centre and the batch; all of mass 1). A centre that has seen less than STARVED of what the largest has becomes a
    row of the batch, with the count of the least of the others."""
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "parts")
    centres = [(i, [list(p) for p in parts], 0.0) for i, (_, parts, _) in enumerate(seeds(rows, "key", kinds, weights, k, seed))]
    for turn in range(rounds if centres else 0):
        batch = stored(samples.first_n(rows, "key", size, seed + 100 + turn), "batch")
        long = assigned(batch, [(label, parts) for label, parts, _ in centres], kinds, weights).select("label", F.posexplode("parts").alias("p", "part")).select("label", "p", F.posexplode("part").alias("i", "v"))
        old = rows.sparkSession.createDataFrame([(label, p, i, float(v), n) for label, parts, n in centres for p, part in enumerate(parts) for i, v in enumerate(part)], "label int, p int, i int, v double, w double")
        by = ["label", "p", "i"]
        sums = long.groupBy(*by).agg(F.sum("v").alias("s"), F.sum(F.sqrt(F.greatest("v", F.lit(0.0)))).alias("r"), F.count("*").cast("double").alias("m"))
        weighed = long.select(*by, "v", F.lit(1.0).alias("w")).union(old).groupBy(*by, "v").agg(F.sum("w").alias("w"))
        upto, whole = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)  # a batch at most
        median = weighed.select(*by, "v", F.sum("w").over(upto).alias("c"), F.sum("w").over(whole).alias("t")).where("2 * c >= t").groupBy(*by).agg(F.min("v").alias("median"))
        got = {(r["label"], r["p"], r["i"]): (r["s"], r["r"], r["median"], r["m"]) for r in sums.join(median, by).toLocalIterator()}  # an entry for each element of each centre
        moved = []
        for label, parts, n in centres:
            if (label, 0, 0) in got:
                parts = [_barycentre(kind, part, n, [got[label, p, i] for i in range(len(part))]) for p, (kind, part) in enumerate(zip(kinds, parts, strict=True))]
                n += got[label, 0, 0][3]
            moved.append((label, parts, n))
        top = max(n for *_, n in moved)
        poor = [label for label, _, n in moved if n < STARVED * top]
        least = min(n for *_, n in moved if n >= STARVED * top)
        fresh = batch.orderBy(samples.order("key", seed + 200 + turn), "key").limit(len(poor)).collect() if poor else []
        taken = {label: [list(p) for p in r["parts"]] for label, r in zip(poor, fresh, strict=False)}
        centres = [(label, taken.get(label, parts), least if label in taken else n) for label, parts, n in moved]
    return centres


def mini_batches_sql(name: str, rows: str, kinds: list[str], weights: list[float], k: int, size: int, rounds: int, seed: int) -> str:
    """CTEs: name_w (label, p, i, v, n), the centres after the rounds."""
    dist = distance_sql(kinds, weights)
    by = "label, p, i"
    parts = [seeds_sql(f"{name}_0", rows, dist, k, seed), f"{name}0 as (select label, p, i, v, 0.0::double as n from {name}_0_c join {rows} using (key))"]
    new = "case " + " ".join(f"when p = {p} then " + {"euclidean": "(n * v + s) / (n + m)", "hellinger": "((n * sqrt(v) + r) / (n + m)) ** 2", "total_variation": "median"}[kind] for p, kind in enumerate(kinds)) + " end"
    shares = ", ".join(str(p) for p, kind in enumerate(kinds) if kind != "euclidean")
    for t in range(rounds):
        c, x, y = f"{name}{t}", f"{name}{t}x", f"{name}{t + 1}"
        parts.append(f"""{x}b as (select key from (select distinct key from {rows}) order by {samples.order_sql('key', seed + 100 + t)}, key limit {size}), {x}r as (select * from {rows} join {x}b using (key)), {x}a as ({assigned_sql(f'{x}r', c, dist)}), {x}l as (select label, p, i, v from {x}r join {x}a using (key)),
{x}s as (select {by}, sum(v) as s, sum(case when v > 0 then sqrt(v) else 0 end) as r, count(*)::double as m from {x}l group by {by}), {x}g as (select {by}, v, sum(w) as w from (select {by}, v, 1.0::double as w from {x}l union all select {by}, v, n from {c}) group by {by}, v), {x}h as (select {by}, v, sum(w) over (partition by {by} order by v rows unbounded preceding) as c, sum(w) over (partition by {by}) as t from {x}g), {x}m as (select {by}, min(v) as median from {x}h where 2 * c >= t group by {by}),
{x}n as (select {by}, case when s.m is null then z.v else {new.replace('v)', 'z.v)').replace('* v ', '* z.v ')} end as v, z.n + coalesce(s.m, 0) as n from {c} z left join {x}s s using ({by}) left join {x}m using ({by})), {x}o as (select {by}, n, case when p in ({shares}) then v / nullif(sum(v) over (partition by label, p), 0) else v end as v from {x}n),
{x}p as (select label, n, row_number() over (order by label) as k from (select distinct label, n from {x}o) where n < {STARVED} * (select max(n) from {x}o)), {x}f as (select key, row_number() over (order by {samples.order_sql('key', seed + 200 + t)}, key) as k from {x}b),
{y} as (select o.label, o.p, o.i, coalesce(w.v, o.v) as v, case when w.v is null then o.n else (select min(n) from {x}o where n >= {STARVED} * (select max(n) from {x}o)) end as n from {x}o o left join (select label, r.p, r.i, r.v from {x}p join {x}f using (k) join {x}r r using (key)) w on w.label = o.label and w.p = o.p and w.i = o.i)""")
    return ", ".join(parts) + f", {name}_w as (select * from {name}{rounds})"


# ---- all movies, all numbers of clusters and all subsamples at once

#: Two digits of an MD5: about four fifths of the rows are in a subsample.
SUBSAMPLE = "cc"


def runs_of(ks: tuple[int, ...], subsamples: int) -> list[tuple[int, int, int]]:
    """(run, k, subsample): subsample 0 is all rows."""
    return [(i, k, s) for i, (k, s) in enumerate((k, s) for k in ks for s in range(subsamples + 1))]


def _member(s: Column, seed: int) -> Column:
    return (s == 0) | (F.substring(F.md5(F.concat(F.lit(f"{seed}:"), s.cast("string"), F.lit(":"), F.col("key").cast("string")).cast("binary")), 1, 2) < SUBSAMPLE)


def _member_sql(seed: int) -> str:
    return f"(s = 0 or substr(md5('{seed}:' || s || ':' || key), 1, 2) < '{SUBSAMPLE}')"


class Space:
    """Parts laid out flat, histograms by their square roots: there the Hellinger distance is Euclidean, and barycentres are means (of norm 1)."""

    def __init__(self, kinds: list[str], weights: list[float], sizes: list[int]):
        if not set(kinds) <= {"euclidean", "hellinger"}:
            raise ValueError("keyed clustering knows the Euclidean and the Hellinger distance")
        self.kinds, self.sizes = kinds, sizes
        self.starts = [1 + sum(sizes[:p]) for p in range(len(sizes))]
        self.weights = [w / math.sqrt(2) if kind == "hellinger" else w for kind, w in zip(kinds, weights, strict=True)]

    def flat(self, parts: Column) -> Column:
        return F.flatten(F.array(*[F.transform(parts[p], F.sqrt) if kind == "hellinger" else parts[p] for p, kind in enumerate(self.kinds)]))

    def part(self, e: Column, p: int) -> Column:
        return F.slice(e, self.starts[p], self.sizes[p])

    def distance(self, a: Column, b: Column) -> Column:
        return reduce(lambda s, d: s + d, (F.lit(w) * X.euclidean(self.part(a, p), self.part(b, p)) for p, w in enumerate(self.weights) if w))

    def settled(self, mean: Column) -> Column:
        def of_norm_one(x):
            norm = F.sqrt(X.dot(x, x))
            return F.transform(x, lambda v: v / F.when(norm > 0, norm).otherwise(1.0))

        return F.flatten(F.array(*[of_norm_one(self.part(mean, p)) if kind == "hellinger" else self.part(mean, p) for p, kind in enumerate(self.kinds)]))


def _with_centres(rows: DataFrame, centres: DataFrame, space: Space) -> DataFrame:
    """movie, key, e, labels: for each run of the movie that the row is in, {run, label, d}. centres: movie, runs (of {run, s, cs}), a row for each movie."""
    # a distance is taken once, and its label and d are read from what was found
    apart = lambda c: F.transform(c["cs"], lambda x: F.struct(x["label"].alias("label"), space.distance(F.col("e"), x["e"]).alias("d")))
    nearest = lambda c: F.array_min(F.transform(apart(c), lambda x: F.struct(F.round(x["d"], 9).alias("r"), x["label"].alias("label"), x["d"].alias("d"))))
    member = lambda c: F.exists("subsamples", lambda s: s == c["s"])
    found = F.transform(F.filter("runs", member), lambda c: F.struct(c["run"].alias("run"), nearest(c).alias("best")))
    labels = F.transform(found, lambda x: F.struct(x["run"].alias("run"), x["best"]["label"].alias("label"), x["best"]["d"].alias("d")))
    return rows.join(centres, "movie").select("movie", "key", "e", "subsamples", labels.alias("labels"))


def _gathered(centres: DataFrame) -> DataFrame:
    """movie, run, s, label, e to a row for each movie."""
    runs = centres.groupBy("movie", "run", "s").agg(F.array_sort(F.collect_list(F.struct("label", "e"))).alias("cs"))
    return runs.groupBy("movie").agg(F.collect_list(F.struct("run", "s", "cs")).alias("runs"))


def keyed_clusters(rows: DataFrame, movie: str, key: str, space: Space, runs: list[tuple[int, int, int]], rounds: int, seed: int) -> DataFrame:
    """movie, key, e, labels (an array of {run, label, d}) of Lloyd's rounds for every run of every movie, from a run's first rows in a seeded
    order. Centres are a table with a row for each movie; sums are taken where the rows are, and the plan of a round ends in a written table."""
    of = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("k"), F.lit(s).alias("s")) for r, k, s in runs])
    inside = F.filter(F.array(*[F.lit(s) for s in sorted({s for *_, s in runs})]), lambda s: _member(s, seed))
    rows = stored(rows.where(F.col(key).isNotNull()).select(F.col(movie).alias("movie"), F.col(key).alias("key"), space.flat(F.col("parts")).alias("e")).withColumn("subsamples", inside), "keyed")
    each = rows.select("movie", "key", "e", "subsamples", F.explode(of).alias("r")).where(F.array_contains("subsamples", F.col("r.s"))).select("movie", "key", "e", "r.*")
    # Spark keeps the first rows of each group before it shuffles
    place = F.row_number().over(W.partitionBy("movie", "run").orderBy(samples.order(F.concat_ws(":", "run", "key"), seed), "key"))
    centres = each.withColumn("place", place).where(F.col("place") <= max(k for _, k, _ in runs)).where("place <= k").select("movie", "run", "s", (F.col("place") - 1).alias("label"), "e")
    sample_of = F.array(*[F.lit(s) for *_, s in runs])
    for _ in range(rounds):
        now = _with_centres(rows, _gathered(stored(centres, "centres")), space)
        each = now.select("movie", "e", F.explode("labels").alias("l"))
        mean = each.groupBy("movie", "l.run", "l.label").agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(sum(space.sizes))]).alias("m"))
        centres = mean.select("movie", "run", F.get(sample_of, F.col("run")).alias("s"), "label", space.settled(F.col("m")).alias("e"))
    return _with_centres(rows, _gathered(stored(centres, "centres")), space)


def stability(clustered: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """movie, k, stability, deviation, chosen: the cosine of the co-membership of consecutive subsamples on the rows they share, from sums
    over contingency tables; chosen is the largest k with stability + deviation over 0.6, or else the most stable one (the smallest of equals)."""
    run = {(k, s): r for r, k, s in runs}
    pairs = [(k, s) for _, k, s in runs if s and (k, s + 1) in run]
    label = lambda r: F.get(F.filter("labels", lambda x: x["run"] == r), F.lit(0))["label"]
    both = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), label(run[k, s]).alias("a"), label(run[k, s + 1]).alias("b")) for k, s in pairs])
    n = clustered.select("movie", F.explode(both).alias("x")).where("x.a is not null and x.b is not null").groupBy("movie", "x.k", "x.s", "x.a", "x.b").agg(F.count("*").alias("n"))
    square = lambda c: F.sum(F.col(c).cast("double") * F.col(c))
    by = ["movie", "k", "s"]
    side = lambda c: n.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(square("n").alias(f"s{c}"))
    cosine = n.groupBy(*by).agg(square("n").alias("both")).join(side("a"), by).join(side("b"), by).withColumn("cosine", F.col("both") / F.sqrt(F.col("sa") * F.col("sb")))
    per = cosine.groupBy("movie", "k").agg(F.avg("cosine").alias("stability"), F.stddev_pop("cosine").alias("deviation"))
    movie = W.partitionBy("movie")  # a row for each k
    good = F.max(F.when(F.round(F.col("stability") + F.col("deviation"), 9) > 0.6, F.col("k"))).over(movie)
    most = F.min(F.struct((-F.round("stability", 9)).alias("x"), "k")).over(movie)["k"]
    return per.withColumn("chosen", F.col("k") == F.coalesce(good, most))


def keyed_sql(name: str, rows: str, kinds: list[str], weights: list[float], runs: list[tuple[int, int, int]], rounds: int, seed: int) -> str:
    """CTEs over rows (movie, key, p, i, v): name_a (run, k, s, movie, key, label, d) and name_k (movie, k, stability, deviation, chosen)."""
    shares = ", ".join(str(p) for p, kind in enumerate(kinds) if kind == "hellinger")
    terms = " + ".join(f"{w / math.sqrt(2) if kind == 'hellinger' else w!r} * sqrt(sum(case when p = {p} then (u.v - c.v) ** 2 else 0 end))" for p, (kind, w) in enumerate(zip(kinds, weights, strict=True)) if w)
    values = ", ".join(f"({r}, {k}, {s})" for r, k, s in runs)
    out = [f"{name}_r as (select * from (values {values}) r(run, k, s)), {name}_e as materialized (select movie, key, p, i, case when p in ({shares}) then sqrt(v) else v end as v from {rows}), {name}_m as (select run, k, s, movie, key from (select distinct movie, key from {rows}), {name}_r where {_member_sql(seed)}), {name}_o as (select run, movie, key, row_number() over (partition by movie, run order by md5('{seed}:' || run || ':' || key), key) - 1 as label, k from {name}_m), {name}0 as (select run, movie, label, p, i, v from {name}_o join {name}_e using (movie, key) where label < k)"]
    best = lambda t: f"{name}a{t} as materialized (select m.run, m.movie, m.key, c.label, {terms} as d from {name}_m m join {name}_e u using (movie, key) join {name}{t} c on c.movie = m.movie and c.run = m.run and c.p = u.p and c.i = u.i group by m.run, m.movie, m.key, c.label qualify row_number() over (partition by m.run, m.movie, m.key order by round({terms}, 9), c.label) = 1)".replace("case when p =", "case when u.p =")
    for t in range(rounds):
        out.append(f"{best(t)}, {name}v{t} as (select run, movie, label, p, i, avg(v) as v from {name}a{t} join {name}_e using (movie, key) group by all), {name}{t + 1} as (select run, movie, label, p, i, case when p in ({shares}) then v / coalesce(nullif(sqrt(sum(v * v) over (partition by run, movie, label, p)), 0), 1) else v end as v from {name}v{t})")
    out.append(f"{best(rounds)}, {name}_a as (select * from {name}a{rounds} join {name}_r using (run))")
    side = lambda c: f"{name}_s{c} as (select movie, k, s, sum(n * n) as s{c} from (select movie, k, s, {c}, sum(n) as n from {name}_n group by all) group by movie, k, s)"
    out.append(f"{name}_n as (select x.movie, x.k, x.s, x.label as a, y.label as b, count(*) as n from {name}_a x join {name}_a y on x.movie = y.movie and x.key = y.key and x.k = y.k and y.s = x.s + 1 and x.s > 0 group by all), {side('a')}, {side('b')}, {name}_b as (select movie, k, s, sum(n * n) as nn from {name}_n group by movie, k, s), {name}_p as (select movie, k, avg(nn / sqrt(sa * sb)) as stability, stddev_pop(nn / sqrt(sa * sb)) as deviation from {name}_b join {name}_sa using (movie, k, s) join {name}_sb using (movie, k, s) group by movie, k), {name}_k as (select *, k = coalesce(max(case when round(stability + deviation, 9) > 0.6 then k end) over (partition by movie), first(k) over (partition by movie order by round(stability, 9) desc, k rows between unbounded preceding and unbounded following)) as chosen from {name}_p)")
    return ", ".join(out)
