"""Frame-to-frame assignment: candidates in a radius, hypotheses, one-to-one links, tracks."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.expressions import norm
from platewise.sources import stored


#: Objects of one place that are carried in one row, at most; and those that a search's cell holds, on average over objects, before it is cut.
BUNDLE, CROWD = 1024, 32


def places(rows: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """keys, x, y, carry, label (the smallest) and n of the objects that share all of keys, x, y and carry. What depends on places alone is
    counted once for each pair of places, whatever the number of objects there."""
    return rows.groupBy(*keys, "x", "y", *(carry or [])).agg(F.min("label").alias("label"), F.count("*").alias("n"))


def finite_places(points: DataFrame) -> DataFrame:
    """label (the smallest), x, y and n of the points (label, x, y) that share a place; points without finite coordinates are in none."""
    return places(points.where("x - x = 0 and y - y = 0"), [])


def near_places(spots: DataFrame, radius: float) -> DataFrame:
    """label, x, y, n and to_label, to_x, to_y, to_n, d of places (see finite_places) at most radius apart, and others: how many points of the second place
    are neighbours of a point in the first. A place of several points is near itself, and there a point has the others."""
    near = of_places(spots, spots, [], radius, carry=["n"])
    return near.withColumn("others", F.col("to_n") - (F.col("label") == F.col("to_label")).cast("int")).where("others > 0")


def firsts(rows: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """The k objects of smallest label in each place."""
    at = F.row_number().over(W.partitionBy(*keys, "x", "y").orderBy("label"))
    return rows.withColumn("at", at).where(F.col("at") <= k).drop("at")


def members(pairs: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of pairs whose left side is a place (keys, x, y), once for each object there; label is the object's."""
    return rows.select(*keys, "x", "y", "label").join(pairs.drop("label"), [*keys, "x", "y"])


def reached(v: Column, reach: float, side: float) -> Column:
    """The one or two intervals [i * side, (i + 1) * side) that lie within reach of v; a side is at least twice the reach."""
    return F.array_distinct(F.array(F.floor((v - reach) / side), F.floor((v + reach) / side)))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], radius: float, left: list[str], right: list[str]) -> DataFrame:
    """keys, cx, cy, x, y, the columns in left of a, to_x, to_y, those in right of b (under their own names), and d of all pairs at most
    radius apart: an equi join on grid cells of twice that size, where the b side is repeated in the cells that it reaches, four at most. Both sides
    are dealt out by cells: a side is never broadcast, as its size on the files says nothing of its copies. Pairs lie where their left row's cell is."""
    reach, side = 1.000001 * radius, 2.00001 * radius  # a little more than the radius, whatever is rounded
    one = a.select(*keys, "x", "y", *left, F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    two = b.select(*keys, F.col("x").alias("to_x"), F.col("y").alias("to_y"), *right)
    two = two.withColumn("cx", F.explode(reached(F.col("to_x"), reach, side))).withColumn("cy", F.explode(reached(F.col("to_y"), reach, side)))
    pairs = one.join(two.hint("merge"), [*keys, "cx", "cy"])
    return pairs.withColumn("d", norm(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y"))).where(F.col("d") <= radius)


def of_places(a: DataFrame, b: DataFrame, keys: list[str], radius: float, carry: list[str] | None = None) -> DataFrame:
    """within_radius of tables that hold few objects of a place: places, or the first objects of each."""
    carry = carry or []
    b = b.select(*keys, "x", "y", *[F.col(c).alias(f"to_{c}") for c in ("label", *carry)])
    return meeting(a, b, keys, radius, ["label", *carry], [f"to_{c}" for c in ("label", *carry)]).drop("cx", "cy")


def bundled(rows: DataFrame, keys: list[str], columns: list[str], name: str, alike: list[str] | None = None) -> DataFrame:
    by = [*keys, "x", "y", *(alike or [])]
    k = F.floor((F.row_number().over(W.partitionBy(*by).orderBy("label")) - 1) / BUNDLE)
    return rows.select(*by, "label", *[c for c in columns if c != "label"], k.alias("bundle")).groupBy(*by, "bundle").agg(F.collect_list(F.struct(*columns)).alias(name))


def within_radius(a: DataFrame, b: DataFrame, keys: list[str], radius: float, carry: list[str] | None = None, own: list[str] | None = None, between: dict[str, Column] | None = None, alike: list[str] | None = None) -> DataFrame:
    """keys, label, x, y and to_label, to_x, to_y, d of all pairs at most radius apart, the columns in carry of both (to_ before those of b), and
    those in own of a. Objects of a place travel in one row (BUNDLE at most), so that a distance is taken once for two places; the pairs of their
    objects are written out where they meet, and are in no shuffle. With between (names and what they are of x, y, to_x, to_y and d), its columns,
    taken once for two places too, stand for those five; so may columns in alike (to_ before those of b), which objects of a row share."""
    carry, own, alike = carry or [], own or [], alike or []
    between = between or {c: F.col(c) for c in ("x", "y", "to_x", "to_y", "d")}
    one, two = bundled(a, keys, ["label", *carry, *own], "ours", alike), bundled(b, keys, ["label", *carry], "theirs", alike)
    two = two.withColumnsRenamed({c: f"to_{c}" for c in alike})
    rows = meeting(one, two, keys, radius, ["ours", *alike], ["theirs", *[f"to_{c}" for c in alike]]).select(*keys, *[c.alias(name) for name, c in between.items()], "ours", "theirs")
    rows = rows.select(*keys, *between, "theirs", F.explode("ours").alias("one"))
    rows = rows.select(*keys, *between, "one", F.explode("theirs").alias("two"))
    of_one, of_two = [F.col(f"one.{c}").alias(c) for c in ("label", *carry, *own)], [F.col(f"two.{c}").alias(f"to_{c}") for c in ("label", *carry)]
    return rows.select(*keys, *of_one, *of_two, *between)


def reaches(rows: DataFrame, keys: list[str], radius: float) -> list[float]:
    """Rising reaches up to the radius, each four times the last: in the first, a cell holds about CROWD of the rows or fewer for a row in it."""
    cells = rows.groupBy(*keys, F.floor(F.col("x") / (2 * radius)), F.floor(F.col("y") / (2 * radius))).agg(F.count("*").alias("n"))
    crowd = cells.agg(F.sum(F.col("n") * F.col("n").cast("double")) / F.sum("n")).first()[0] or 0.0
    out = [radius]
    while crowd > CROWD and len(out) < 12:
        crowd, out = crowd / 16, [out[0] / 4, *out]
    return out


def nearest(a: DataFrame, b: DataFrame, keys: list[str], radius: float, k: int = 1, carry: list[str] | None = None, by: Column | None = None) -> DataFrame:
    """keys, x, y, to_x, to_y, d, k, label and the columns in carry of both (to_ before those of b): for each place of a, a row of a each, the k rows of b that are
    nearest to it (or first by the column by, which is d to nine places at least; ties by label). Reaches rise by rounds: what has k within one needs no pair
    beyond it, so that pairs grow as the rows do, however many lie within the radius. a and b are read several times."""
    carry, place, out = carry or [], [*keys, "x", "y"], []
    b = b.select(*place, *[F.col(c).alias(f"to_{c}") for c in ("label", *carry)])
    at = F.row_number().over(W.partitionBy(*keys, "cx", "cy", "x", "y").orderBy(F.col("d") if by is None else by, "to_label"))  # a row's pairs lie together already
    for reach in reaches(b, keys, radius):
        got = meeting(a, b, keys, reach, ["label", *carry], [f"to_{c}" for c in ("label", *carry)]).withColumn("k", at).where(F.col("k") <= k).drop("cx", "cy")
        if reach < radius:
            got = stored(got, "nearest")
            full = got.where((F.col("k") == k) & (F.col("d") < reach * (1 - 1e-6))).select(*place)
            a, got = stored(a.join(full, place, "left_anti"), "places"), got.join(full, place, "left_semi")
        out.append(got)
    return reduce(DataFrame.unionByName, out)


def others_within(spots: DataFrame, keys: list[str], radius: float, most: int) -> DataFrame:
    """keys, x, y and others: how many objects are near one of each place (see places), or at least `most` where there are as many. Reaches rise by rounds: what
    has so many within one needs no pair beyond it."""
    place, out, left = [*keys, "x", "y"], [], spots
    for reach in reaches(spots, keys, radius):
        got = of_places(left, spots, keys, reach, carry=["n"]).groupBy(*place).agg((F.sum("to_n") - 1).alias("others"))
        if reach < radius:
            got = stored(got.where(F.col("others") >= most), "crowded")
            left = stored(left.join(got, place, "left_anti"), "places")
        out.append(got)
    return reduce(DataFrame.unionByName, out)


def mutual_nearest(a: DataFrame, b: DataFrame, keys: list[str], radius: float, carry: list[str] | None = None) -> DataFrame:
    """mutual_links() of the pairs of a and b (a row for each place) within the radius."""
    best = lambda rows: rows.withColumn("k", F.row_number().over(W.partitionBy(*keys, "label").orderBy("d", "to_label"))).where("k = 1").drop("k")
    back = best(nearest(b, a, keys, radius)).select(*keys, F.col("to_label").alias("label"), F.col("label").alias("to_label"))
    return best(nearest(a, b, keys, radius, carry=carry)).join(back, [*keys, "label", "to_label"])


def nearest_k(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*keys, "label").orderBy("d", "to_label"))
    return pairs.withColumn("k", at).where(F.col("k") <= k)


def next_frame(objects: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """The objects of frame + 1 under their previous frame's number."""
    return objects.withColumn(frame, F.col(frame) - 1)


def mutual_links(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one links: each object and its nearest candidate, where both choose one another (ties by label)."""
    a = F.row_number().over(W.partitionBy(*keys, "label").orderBy("d", "to_label"))
    b = F.row_number().over(W.partitionBy(*keys, "to_label").orderBy("d", "label"))
    return pairs.withColumns({"a": a, "b": b}).where("a = 1 and b = 1").drop("a", "b")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) with the largest total gain; pairs without a gain are left out. Augmenting paths with potentials."""
    n, m = gain.shape
    if n > m:
        return sorted((j, i) for i, j in best_assignment(gain.T))
    cost = -np.maximum(gain, 0.0)  # what has no gain costs nothing, and is dropped in the end
    u, v, match, taken = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    for i in range(n):
        length, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, least, seen = i, 0.0, []
        while True:
            seen.append(row)
            reduced = cost[row] - v
            reduced += least - u[row]
            better = np.flatnonzero((reduced < length) & ~done)
            length[better], came[better] = reduced[better], row
            j = int(np.argmin(np.where(done, np.inf, length)))
            least, done[j] = length[j], True
            if match[j] < 0:
                break
            row = match[j]
        u[seen[1:]] += least - length[taken[seen[1:]]]
        u[i] += least
        v[done] -= least - length[done]
        while True:
            row = came[j]
            match[j], taken[row], j = row, j, taken[row]
            if row == i:
                break
    return sorted((int(match[j]), j) for j in range(m) if match[j] >= 0 and gain[match[j], j] > 0)


def optimal_links(pairs: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, label, to_label, d: the one-to-one links with the largest sum of radius - d. The candidates of one pair of frames meet in a task,
    where each connected set of objects is solved by itself."""
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", label bigint, to_label bigint, d double"

    def solve(pdf):
        import pandas as pd

        a, b, d = pdf.label.to_numpy(), pdf.to_label.to_numpy(), pdf.d.to_numpy()
        rows, columns = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
        part = np.arange(rows.max() + 1)
        while True:  # objects in one connected set have one smallest row
            least = np.full(columns.max() + 1, len(part))
            np.minimum.at(least, columns, part[rows])
            new = part.copy()
            np.minimum.at(new, rows, least[columns])
            if (new == part).all():
                break
            part = new
        keep = []
        for group in np.unique(part):
            edges = np.flatnonzero(part[rows] == group)
            r, ri = np.unique(rows[edges], return_inverse=True)
            c, ci = np.unique(columns[edges], return_inverse=True)
            gain, edge = np.zeros((len(r), len(c))), np.full((len(r), len(c)), -1)
            gain[ri, ci], edge[ri, ci] = radius - d[edges] + 1e-9, edges
            keep += [edge[i, j] for i, j in best_assignment(gain)]
        return pd.DataFrame(pdf.iloc[sorted(keep)][[*keys, "label", "to_label", "d"]])

    return pairs.select(*keys, "label", "to_label", "d").groupBy(*keys).applyInPandas(solve, schema)


def chains(links: DataFrame, scratch: str) -> DataFrame:
    """label, track, position: tracks of one-to-one links (label, to_label), by pointer doubling: log2 of the longest track's length in joins.

    Each round every object jumps to its ancestor's ancestor, and is written out, so that a plan does not grow with the rounds."""
    spark = links.sparkSession

    def put(df):
        path = f"{scratch}/chains-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    up = links.select(F.col("to_label").alias("label"), F.col("label").alias("up"), F.lit(1).cast("bigint").alias("hops"))
    roots = links.select("label").join(up.select("label"), "label", "left_anti").select("label", F.col("label").alias("up"), F.lit(0).cast("bigint").alias("hops"))
    state = put(up.unionByName(roots))
    moved = state.where("hops > 0").count()
    while moved:
        ahead = state.select(F.col("label").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"))
        state = put(state.join(ahead, "up").select("label", F.col("further").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("more") > 0).alias("moved")))
        moved = state.where("moved").count()
        state = state.drop("moved")
    return state.select("label", F.col("up").alias("track"), F.col("hops").alias("position"))
