"""Sequence operators over the points of tracks (plate, track_id, frame, x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions.expressions import angle, clamp, norm


#: Steps that are no longer have no direction.
STILL = 1e-9


def ordered():
    return W.partitionBy("plate", "track_id").orderBy("frame")


def steps(points: DataFrame) -> DataFrame:
    """Adds dx, dy, displacement to the next point, and turning (the angle to the step before); no row for a track's last point."""
    nx, ny = F.lead("x").over(ordered()), F.lead("y").over(ordered())
    rows = points.select("*", (nx - F.col("x")).alias("dx"), (ny - F.col("y")).alias("dy")).where(F.col("dx").isNotNull())
    rows = rows.withColumn("displacement", norm(F.col("dx"), F.col("dy")))
    return rows.withColumn("turning", angle(F.lag("dx").over(ordered()), F.lag("dy").over(ordered()), F.col("dx"), F.col("dy"))).withColumn("acceleration", F.col("displacement") - F.lag("displacement").over(ordered()))


def track_features(points: DataFrame, least_points: int = 12) -> DataFrame:
    """One row a track: steps, total and effective length, straightness, mean displacement, persistence, turning, acceleration and slow share."""
    ends = points.groupBy("plate", "track_id").agg(F.count("*").alias("n"), *(F.min_by(c, "frame").alias(f"{c}0") for c in "xy"), *(F.max_by(c, "frame").alias(f"{c}1") for c in "xy")).where(F.col("n") >= least_points)
    agg = steps(points).groupBy("plate", "track_id").agg(
        F.count("*").alias("n_steps"), F.sum("displacement").alias("total_length"), F.avg("displacement").alias("mean_displacement"), F.max("displacement").alias("max_displacement"),
        F.avg(F.cos("turning")).alias("persistence"), F.avg("turning").alias("mean_turning"), F.avg("acceleration").alias("mean_acceleration"), F.sum(F.col("displacement") * F.col("displacement")).alias("squared_length"),
    )
    rows = agg.join(ends, ["plate", "track_id"]).withColumn("effective_length", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return rows.withColumn("straightness", F.col("effective_length") / F.when(F.col("total_length") > 0, F.col("total_length"))).drop("n", "x0", "y0", "x1", "y1")


def step_values(points: DataFrame, window: int = 10) -> DataFrame:
    """One row a step: displacement, acceleration, and against the step before the turning angle and the persistence (its cosine; without a
    direction 0 and 1), change (the signed turn); straight, from points that a window of so many begins at: the residual of their line
    over their squared step lengths."""
    return _step_values(points, window).where("displacement is not null").select("plate", "track_id", "frame", *STEP_VALUES)


STEP_VALUES = ("displacement", "acceleration", "persistence", "turning", "change", "before", "straight")


def _step_values(points: DataFrame, window: int = 10) -> DataFrame:
    """step_values() beside the points that they begin at; of points without a step they say nothing."""
    nx, ny = F.lead("x").over(ordered()), F.lead("y").over(ordered())
    frames, inner = ordered().rowsBetween(0, window - 1), ordered().rowsBetween(0, window - 2)
    a, b, c, n = F.var_pop("x").over(frames), F.var_pop("y").over(frames), F.covar_pop("x", "y").over(frames), F.count("*").over(frames)
    rows = points.select("*", (nx - F.col("x")).alias("dx"), (ny - F.col("y")).alias("dy"), a.alias("va"), b.alias("vb"), c.alias("vc"), n.alias("vn"))
    rows = rows.withColumns({"displacement": norm(F.col("dx"), F.col("dy")), "squares": F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).over(inner)})
    px, py, p = F.lag("dx").over(ordered()), F.lag("dy").over(ordered()), F.lag("displacement").over(ordered())
    moved = (p > STILL) & (F.col("displacement") > STILL)
    cosine = F.when(moved, clamp((px * F.col("dx") + py * F.col("dy")) / (p * F.col("displacement")))).when(p.isNotNull(), 1.0)
    change = F.when(moved, F.atan2("dy", "dx") - F.atan2(py, px))
    half = (F.col("va") + F.col("vb")) / 2
    residual = F.greatest(F.lit(0.0), half - F.sqrt(F.pow((F.col("va") - F.col("vb")) / 2, F.lit(2.0)) + F.col("vc") * F.col("vc"))) * window
    straight = F.when((F.col("vn") == window) & (F.col("squares") > STILL), residual / F.col("squares"))
    rows = rows.withColumns({"acceleration": F.col("displacement") - p, "persistence": cosine, "turning": F.acos(cosine), "change": change, "before": p, "straight": straight})
    return rows.select("plate", "track_id", "frame", "x", "y", "displacement", *[F.when(F.col("displacement").isNotNull(), F.col(c)).alias(c) for c in STEP_VALUES[1:]])


def _correlation(a: str, b: str) -> Column:
    """Of the rows that have both; null where one of them does not vary, which corr divides by."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(F.when(both, F.col(a))) * F.var_pop(F.when(both, F.col(b)))))


def step_vectors(points: DataFrame) -> DataFrame:
    """One row a track that has a step: its length in frames and in space, effective length and speed, largest move, corrected straightness, mean
    squared displacement, the circular mean of the signed turns, means of the per-step values, slope and correlation of persistence on speed."""
    ends = [f(c, "frame").alias(f"{c}{i}") for i, f in enumerate((F.min_by, F.max_by)) for c in "xy"]
    rows = _step_values(points).groupBy("plate", "track_id").agg(
        F.sum("displacement").alias("total_length"), F.max("displacement").alias("largest_move"), F.avg(F.col("displacement") * F.col("displacement")).alias("mean_squared_displacement"), F.abs(F.atan2(F.sum(F.sin("change")), F.sum(F.cos("change")))).alias("signed_turning"),
        F.avg("acceleration").alias("mean_acceleration"), F.avg("displacement").alias("mean_displacement"), F.avg("persistence").alias("mean_persistence"), F.avg("straight").alias("mean_straight"), F.avg("turning").alias("mean_turning"),
        F.regr_slope("persistence", "before").alias("speed_slope"), _correlation("persistence", "before").alias("speed_correlation"), F.count("*").alias("n"), *ends,
    )
    rows = rows.where("total_length is not null").withColumn("effective_length", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).drop("x0", "y0", "x1", "y1")
    return rows.withColumns({"effective_speed": F.col("effective_length") / F.sqrt(F.col("n") - 1), "corrected_straightness": F.sqrt("n") * F.col("effective_length") / F.when(F.col("total_length") > 0, F.col("total_length"))})


def shape_vectors(points: DataFrame, radii: tuple[float, float] = (4.0, 16.0)) -> DataFrame:
    """One row a track: n, hull area (also for each step), balls (over the root of n) and entropy for two radii, movement type, diffusion and their
    adequation (see scaling(); a track that never moves has no movement type). A track is made once for all of them."""
    rows = _paths(points).select("plate", "track_id", "p", F.size("p").cast("bigint").alias("n"), _shapes(F.col("p"), radii).alias("s"))
    rows = rows.select("plate", "track_id", "n", "s", F.explode_outer(_moments(F.col("p"))).alias("m"))  # after the shapes, which are taken once for a track
    logs = rows.select("plate", "track_id", "n", "s", "m.nu", F.ln("m.lag").alias("u"), F.when(F.col("m.moment") > 0, F.ln("m.moment")).alias("v"))
    rows = _spectrum(_fits(logs, F.first("n").alias("n"), F.first("s").alias("s")), F.first("n").alias("n"), F.first("s").alias("s"))
    covers = [c for i in range(len(radii)) for c in ((F.col("s.covers")[i]["balls"] / F.sqrt("n")).alias(f"balls{i + 1}"), F.col("s.covers")[i]["entropy"].alias(f"entropy{i + 1}"))]
    return rows.select("plate", "track_id", "n", "movement_type", "diffusion", "adequation", F.col("s.hull_area").alias("hull_area"), *covers, (F.col("s.hull_area") / (F.col("n") - 1)).alias("hull_area_of_step"))


def trajectory_vectors(points: DataFrame, radii: tuple[float, float] = (4.0, 16.0)) -> DataFrame:
    """One row a track with its feature vector: step_vectors() and shape_vectors()."""
    return step_vectors(points).join(shape_vectors(points, radii).drop("n"), ["plate", "track_id"])


def drift(points: DataFrame) -> DataFrame:
    """plate, frame, n, drift_x, drift_y: the cumulative mean displacement of all tracks up to each frame."""
    mean = steps(points).groupBy("plate", "frame").agg(F.count("*").alias("n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    upto = W.partitionBy("plate").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return mean.select("plate", (F.col("frame") + 1).alias("frame"), "n", F.sum("mx").over(upto).alias("drift_x"), F.sum("my").over(upto).alias("drift_y"))


def corrected(points: DataFrame) -> DataFrame:
    """Points without the drift; a plate's first frame stays."""
    curve = drift(points).drop("n")
    rows = points.join(F.broadcast(curve), ["plate", "frame"], "left")  # a row for each frame of a plate
    return rows.select("plate", "track_id", "frame", (F.col("x") - F.coalesce("drift_x", F.lit(0.0))).alias("x"), (F.col("y") - F.coalesce("drift_y", F.lit(0.0))).alias("y"))


def _paths(points: DataFrame) -> DataFrame:
    """plate, track_id, p: the points of a track by frame."""
    return points.groupBy("plate", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))


def _moments(p: Column, orders=(1, 2, 3, 4, 5, 6), share: int = 3) -> Column:
    """An array of nu, lag, moment: all lags of a path in one row, whose path is not copied."""
    pairs = lambda lag: F.zip_with(F.slice(p, lag + 1, F.size(p)), F.slice(p, F.lit(1), F.size(p) - lag), lambda b, a: norm(b["x"] - a["x"], b["y"] - a["y"]))
    mean = lambda d, nu: F.aggregate(d, F.lit(0.0), lambda s, v: s + F.pow(v, F.lit(float(nu)))) / F.size(d)
    of_lag = lambda lag, d: F.array(*[F.struct(F.lit(nu).alias("nu"), lag.alias("lag"), mean(d, nu).alias("moment")) for nu in orders])
    lags = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(p) / share).cast("int")))
    return F.when(F.size(p) > 1, F.flatten(F.transform(lags, lambda lag: F.element_at(F.transform(F.array(pairs(lag)), lambda d: of_lag(lag, d)), 1))))


def moments(points: DataFrame, orders=(1, 2, 3, 4, 5, 6), share: int = 3) -> DataFrame:
    """plate, track_id, nu, lag, moment: the mean nu-th power of the displacement over each lag up to a third of the track."""
    rows = _paths(points).where(F.size("p") > 1)  # then a row for each lag and order
    return rows.select("plate", "track_id", F.explode(_moments(F.col("p"), orders, share)).alias("m")).select("plate", "track_id", "m.nu", "m.lag", "m.moment")


def end_codes(spans: DataFrame, lineage: DataFrame) -> DataFrame:
    """spans (plate, track_id, first, last) with start_code (0 begins with the plate, 2 is a child of a lineage event, 1 appeared) and end_code
    (0 ends with the plate, 2 has several children, 3 has a child with several parents, 1 vanished)."""
    edges = lineage.select("parent", "child").distinct()
    ends = spans.groupBy("plate").agg(F.min("first").alias("m_start"), F.max("last").alias("m_end"))
    parents = edges.groupBy("child").agg(F.count("*").alias("n_parents"))
    children = edges.join(parents, "child").groupBy("parent").agg(F.count("*").alias("n_children"), F.max("n_parents").alias("n_parents"))
    rows = spans.join(F.broadcast(ends), "plate").join(parents.select(F.col("child").alias("track_id"), F.lit(True).alias("is_child")), "track_id", "left").join(children.withColumnRenamed("parent", "track_id"), "track_id", "left")
    start = F.when(F.col("first") == F.col("m_start"), 0).when(F.col("is_child"), 2).otherwise(1)
    end = F.when(F.col("last") == F.col("m_end"), 0).when(F.col("n_children") > 1, 2).when(F.col("n_parents") > 1, 3).otherwise(1)
    return rows.select("plate", "track_id", "first", "last", start.alias("start_code"), end.alias("end_code"))


def without_division_moves(points: DataFrame, codes: DataFrame) -> DataFrame:
    """Points without the first two of tracks that a division begins and the last two of those that a division or a merge ends."""
    track = W.partitionBy("plate", "track_id")
    rows = points.join(codes.select("track_id", "start_code", "end_code"), "track_id")
    rows = rows.withColumns({"a": F.row_number().over(track.orderBy("frame")), "z": F.row_number().over(track.orderBy(F.desc("frame")))})
    return rows.where("not (start_code = 2 and a <= 2) and not (end_code in (2, 3) and z <= 2)").select("plate", "track_id", "frame", "x", "y")


def _fits(logs: DataFrame, *more: Column) -> DataFrame:
    return logs.groupBy("plate", "track_id", "nu").agg(F.regr_slope("v", "u").alias("gamma"), F.regr_intercept("v", "u").alias("c"), _correlation("u", "v").alias("r"), *more)


def _spectrum(fits: DataFrame, *more: Column, least_r: float = 0.7) -> DataFrame:
    poor = F.coalesce(F.col("r"), F.lit(0.0)) < least_r
    return fits.groupBy("plate", "track_id").agg(F.regr_slope("gamma", F.col("nu").cast("double")).alias("movement_type"), F.max(F.when((F.col("nu") == 2), F.when(poor, 0.0).otherwise(F.exp("c") / 4))).alias("diffusion"), F.sum(poor.cast("int")).alias("adequation"), *more)


def scaling(points: DataFrame, least_r: float = 0.7) -> DataFrame:
    """Slope of the moment scaling spectrum (movement_type), diffusion (from nu = 2 where the fit holds) and adequation (the number of poor fits)."""
    return _spectrum(_fits(moments(points).where("moment > 0").withColumns({"u": F.ln("lag"), "v": F.ln("moment")})), least_r=least_r)


def local_straightness(points: DataFrame, window: int = 10) -> DataFrame:
    """Sum over windows of points of the squared residuals of the orthogonal line fit: the smaller eigenvalue of the scatter matrix."""
    frames = ordered().rowsBetween(0, window - 1)
    a, b, c, n = F.var_pop("x").over(frames), F.var_pop("y").over(frames), F.covar_pop("x", "y").over(frames), F.count("*").over(frames)
    rows = points.select("plate", "track_id", a.alias("a"), b.alias("b"), c.alias("c"), n.alias("n")).where(F.col("n") == window)
    half = (F.col("a") + F.col("b")) / 2
    smaller = half - F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    return rows.groupBy("plate", "track_id").agg(F.sum(F.greatest(F.lit(0.0), smaller) * window).alias("residual"))


def longest_runs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The longest run of consecutive whole numbers of value within keys (first, last, length; the first one of equals)."""
    island = F.col(value) - F.row_number().over(W.partitionBy(*keys).orderBy(value))
    runs = rows.select(*keys, value).distinct().withColumn("island", island).groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("length"), "first"))
    return runs.withColumn("k", best).where("k = 1").select(*keys, "first", "last", "length")


def run_lengths(rows: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Run-length code of a state sequence: keys, run, state, length."""
    at = W.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("new", (~F.col(state).eqNullSafe(F.lag(state).over(at))).cast("int")).withColumn("run", F.sum("new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.first(state).alias(state), F.count("*").alias("length"))


def forward_mean(rows: DataFrame, keys: list[str], order: str, value: str, k: int):
    """Column: the mean of value over this row and the k - 1 rows that follow."""
    return F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(0, k - 1))


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull by the monotone chain."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return 0.0

    def chain(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(points) + chain(points[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2


def ball_cover(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[int, float]:
    """Greedy cover of a path: the ball that holds the longest run of consecutive points that are left is taken first. Count, and entropy / log n."""
    left, sizes, n, at = np.ones(len(x), bool), [], len(x), np.arange(len(x))
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= radius * radius
    while left.any():
        inside = near & left & left[:, None]
        # length of the run of points inside a ball (a row) that ends at each point
        run = np.where(inside, at - np.maximum.accumulate(np.where(inside, -1, at), axis=1), 0)
        length = int(run.max())
        if length <= 1:  # so are all that follow; points without a place are in no ball
            sizes += [1] * int(run.any(axis=0).sum())
            break
        last = int(np.flatnonzero((run == length).any(axis=0))[0])
        left[last - length + 1 : last + 1] = False
        sizes.append(length)
    p = np.array(sizes) / n
    return len(sizes), float(-(p * np.log(p)).sum() / np.log(n)) if n > 1 else 0.0


def _shapes(p: Column, radii) -> Column:
    """hull_area and, for each radius, balls and entropy of a path. A path is bounded by the movie's length; paths meet Python in batches."""

    @F.pandas_udf("hull_area double, covers array<struct<balls: bigint, entropy: double>>")
    def shapes(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        areas, covers = [], []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            areas.append(hull_area(x, y))
            covers.append([dict(zip(("balls", "entropy"), ball_cover(x, y, r), strict=True)) for r in radii])
        return pd.DataFrame({"hull_area": areas, "covers": covers})

    return shapes(p["x"].cast("array<double>"), p["y"].cast("array<double>"))


def shape_features(points: DataFrame, radius: float) -> DataFrame:
    """hull_area, balls, ball_entropy of each track."""
    rows = _paths(points).select("plate", "track_id", _shapes(F.col("p"), [radius]).alias("s"))
    return rows.select("plate", "track_id", "s.hull_area", F.col("s.covers")[0]["balls"].alias("balls"), F.col("s.covers")[0]["entropy"].alias("ball_entropy"))
