"""Assignment, track building, contacts, simulation (letters N, O, P and R of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.model import objects, q6, query, r6, table, track_points, wells
from platewise.operators import assignment as A
from platewise.operators import samples, simulate
from platewise.sources import scratch, stored

RADIUS = 8.0
KEYS = ["plate", "frame"]
D = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
NEXT = f"c as (select a.plate, a.frame, a.label, b.label as to_label, {D} as d from objects a join objects b on a.plate = b.plate and b.frame = a.frame + 1 and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8 where {D} <= 8)"
MUTUAL = f"{NEXT}, m as (select *, row_number() over (partition by plate, frame, label order by d, to_label) as ka, row_number() over (partition by plate, frame, to_label order by d, label) as kb from c), l as (select plate, frame, label, to_label, d from m where ka = 1 and kb = 1)"


def _candidates(spark, sf_dir):
    """Pairs of objects of consecutive frames, with the class of both."""
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y", "cls")
    return A.within_radius(rows, A.next_frame(rows, ["plate"]), KEYS, RADIUS, carry=["cls"])


def _links(spark, sf_dir):
    """Of objects in one place only that of smallest label can be chosen by another object, so that no other is in a mutual link."""
    rows = objects(spark, sf_dir)
    first = rows.groupBy(*KEYS, "x", "y").agg(F.min_by("cls", "label").alias("cls"), F.min("label").alias("label"))
    first = stored(first, "places")
    return A.mutual_nearest(first, A.next_frame(first, ["plate"]), KEYS, RADIUS, carry=["cls"])


def _place_pairs(spark, sf_dir, carry=()):
    """Pairs of places (and of the values in carry) of consecutive frames, and n and to_n: how many objects both hold."""
    rows = A.places(objects(spark, sf_dir), KEYS, [*carry])
    return A.of_places(rows, A.next_frame(rows, ["plate"]), KEYS, RADIUS, carry=[*carry, "n"])


@query("N01_doublets", f"select a.plate, a.frame, a.label, b.label as to_label, {q6(D)} as d from objects a join objects b on a.plate = b.plate and a.frame = b.frame and a.label < b.label and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8 where {D} <= 8", "objects")
def doublets(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y")
    pairs = A.within_radius(rows, rows, ["plate", "frame"], RADIUS, between={"d": r6(F.col("d"))}).where("label < to_label")
    return pairs.select("plate", "frame", "label", "to_label", "d")


@query("N06_move_hypotheses", f"{NEXT} select plate, frame, label, to_label, {q6('d')} as d, row_number() over (partition by plate, frame, label order by d, to_label)::int as k from c qualify k <= 5", "objects")
def move_hypotheses(spark, sf_dir):
    """Objects of one place have the same candidates, and of a target place only the first five can be among the nearest."""
    rows = objects(spark, sf_dir).select(*KEYS, "label", "x", "y")
    spots, first = stored(A.places(rows, KEYS), "places"), stored(A.firsts(rows, KEYS, 5), "firsts")
    near = A.members(A.nearest(spots, A.next_frame(first, ["plate"]), KEYS, RADIUS, 5), rows, KEYS)
    return near.select("plate", "frame", "label", "to_label", r6(F.col("d")).alias("d"), "k")


@query("N08_hypothesis_features", f"select a.plate, a.frame, a.label, b.label as to_label, {q6('abs(b.x - a.x)')} as fx, {q6('abs(b.y - a.y)')} as fy, {q6('least(a.x, a.y, 500 - a.x)')} as border, a.cls = b.cls as same_class from objects a join objects b on a.plate = b.plate and b.frame = a.frame + 1 and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8 where {D} <= 8", "objects")
def hypothesis_features(spark, sf_dir):
    """What depends on places and classes alone is taken once for two of them, whatever the number of their objects."""
    rows = objects(spark, sf_dir).select(*KEYS, "label", "x", "y", "cls")
    features = {"fx": r6(F.abs(F.col("to_x") - F.col("x"))), "fy": r6(F.abs(F.col("to_y") - F.col("y"))), "border": r6(F.least(F.col("x"), F.col("y"), 500 - F.col("x"))), "same_class": F.col("cls") == F.col("to_cls")}
    pairs = A.within_radius(rows, A.next_frame(rows, ["plate"]), KEYS, RADIUS, between=features, alike=["cls"])
    return pairs.select(*KEYS, "label", "to_label", *features)


@query("N13_mutual_links", f"{MUTUAL} select plate, frame, label, to_label, {q6('d')} as d from l", "objects")
def mutual_links(spark, sf_dir):
    return _links(spark, sf_dir).select("plate", "frame", "label", "to_label", r6(F.col("d")).alias("d"))


@query("N28_link_accuracy", f"{MUTUAL}, o as (select label, cls from objects) select a.cls as source_class, b.cls as target_class, count(*) as n from l join o a using (label) join o b on b.label = l.to_label group by 1, 2", "objects")
def link_accuracy(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(F.col("cls").alias("source_class"), F.col("to_cls").alias("target_class")).agg(F.count("*").alias("n"))


@query("N29_event_types", f"{MUTUAL}, o as (select plate, frame, label from objects), k as (select max(frame) as last from objects) select case when i.to_label is not null and j.label is not null then 'move' when j.label is null and frame < last then 'disappear' when i.to_label is null and frame > 0 then 'appear' else 'edge' end as event, count(*) as n from o left join (select to_label from l) i on i.to_label = o.label left join (select label from l) j on j.label = o.label, k group by 1", "objects")
def event_types(spark, sf_dir):
    links, rows = _links(spark, sf_dir), objects(spark, sf_dir).select("frame", "label")
    into, out = links.select(F.col("to_label").alias("label"), F.lit(True).alias("into")), links.select("label", F.lit(True).alias("out"))
    rows = rows.join(into, "label", "left").join(out, "label", "left").crossJoin(F.broadcast(rows.agg(F.max("frame").alias("last"))))
    event = F.when(F.col("into").isNotNull() & F.col("out").isNotNull(), "move").when(F.col("out").isNull() & (F.col("frame") < F.col("last")), "disappear").when(F.col("into").isNull() & (F.col("frame") > 0), "appear").otherwise("edge")
    return rows.groupBy(event.alias("event")).agg(F.count("*").alias("n"))


@query("O01_tracks_from_links", f"{MUTUAL}, t as (select label, label as track, 0 as position from l where label not in (select to_label from l) union all select l.to_label, t.track, t.position + 1 from t join l on l.label = t.label) select label, track, position::bigint as position from t", "objects")
def tracks_from_links(spark, sf_dir):
    return A.chains(_links(spark, sf_dir), scratch(spark))


@query("O04_density", f"select a.plate, a.frame, a.label, least(count(b.label), 9) as density from objects a left join objects b on a.plate = b.plate and a.frame = b.frame and a.label <> b.label and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8 and {D} <= 8 group by a.plate, a.frame, a.label", "objects")
def density(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y")
    near = A.others_within(stored(A.places(rows, KEYS), "places"), KEYS, RADIUS, 9)
    return rows.join(near, [*KEYS, "x", "y"], "left").select("plate", "frame", "label", F.least(F.coalesce("others", F.lit(0)), F.lit(9)).alias("density"))


@query("D11_points_in_boxes", "b as (select plate, frame, label, x - 3 as x0, x + 3 as x1, y - 3 as y0, y + 3 as y1 from objects where cls = 'purchase') select b.plate, b.frame, b.label as box, count(*) as inside from b join objects o on o.plate = b.plate and o.frame = b.frame and o.x > x0 and o.x < x1 and o.y > y0 and o.y < y1 group by 1, 2, 3", "objects")
def points_in_boxes(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y", "cls")
    boxes = rows.where("cls = 'purchase'")
    pairs = A.of_places(A.places(boxes, KEYS), A.places(rows, KEYS), KEYS, RADIUS, carry=["n"])
    inside = pairs.where("to_x > x - 3 and to_x < x + 3 and to_y > y - 3 and to_y < y + 3")
    return A.members(inside.groupBy(*KEYS, "x", "y").agg(F.sum("to_n").alias("inside")), boxes, KEYS).select("plate", "frame", F.col("label").alias("box"), "inside")


@query("P01_axial_ratios", f"select track_id, min(frame) as first, {q6('avg(least(x, y + 1) / greatest(x, y + 1))')} as ratio, {q6('min(x)')} as low, {q6('max(x)')} as high from track_points group by track_id", "track_points")
def axial_ratios(spark, sf_dir):
    y = F.col("y") + 1
    return track_points(spark, sf_dir).groupBy("track_id").agg(F.min("frame").alias("first"), r6(F.avg(F.least("x", y) / F.greatest("x", y))).alias("ratio"), r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"))


@query("R07_replicate_layout", "select sirna, r as replicate, (sirna + 7 * r) % 384 + 1 as position, sirna % 48 = 0 as is_control from wells, (select unnest([1, 2, 3]) as r)", "wells")
def replicate_layout(spark, sf_dir):
    rows = wells(spark, sf_dir).select("sirna").withColumn("replicate", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.select("sirna", "replicate", ((F.col("sirna") + 7 * F.col("replicate")) % 384 + 1).alias("position"), (F.col("sirna") % 48 == 0).alias("is_control"))


@query("R05_simulated_walks")
def simulated_walks(spark, sf_dir):
    """A walk for each siRNA of the library; every seventh moves twice as far."""
    lib = wells(spark, sf_dir).select(F.col("sirna").alias("track_id"), F.when(F.col("sirna") % 7 == 0, 2.0).otherwise(1.0).alias("scale"))
    return simulate.walks(lib, 30, seed=17)


@query("G03_stratified_sample", f"select plate, frame, label, x, y, cls from objects qualify row_number() over (partition by plate, cls order by {samples.order_sql('label', 5)}, label) <= 20", "objects")
def stratified_sample(spark, sf_dir):
    """Up to 20 objects of each class and plate in a seeded order: the same rows however the table is partitioned."""
    k = F.row_number().over(W.partitionBy("plate", "cls").orderBy(samples.order("label", 5), "label"))
    return objects(spark, sf_dir).withColumn("k", k).where("k <= 20").drop("k")


@query("T01_rolling_windows", f"select user_id % 5 as plate, time_bucket(interval '6 hours', ts, timestamp '2024-01-01') as start, count(*) as n, {q6('sum(value)')} as total from events group by 1, 2")
def rolling_windows(spark, sf_dir):
    """The batch result of streaming.tumbling, which the streaming tests compare with."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("plate"), F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))
    return rows.select("plate", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("N05_link_distances", f"{MUTUAL} select floor(d)::bigint as bin, count(*) as n, {q6('avg(d)')} as mean from l group by 1", "objects")
def link_distances(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(F.floor("d").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"))


@query("N21_joint_features", f"{MUTUAL}, o as (select label, x, y, cls from objects) select a.cls = b.cls as same_class, count(*) as n, {q6('sum(abs(b.x - a.x))')} as fx, {q6('sum(abs(b.y - a.y))')} as fy from l join o a using (label) join o b on b.label = l.to_label group by 1", "objects")
def joint_features(spark, sf_dir):
    return _links(spark, sf_dir).groupBy((F.col("cls") == F.col("to_cls")).alias("same_class")).agg(F.count("*").alias("n"), r6(F.sum(F.abs(F.col("to_x") - F.col("x")))).alias("fx"), r6(F.sum(F.abs(F.col("to_y") - F.col("y")))).alias("fy"))


@query("N23_folds", f"f as (select unnest([0, 1, 2, 3, 4]) as fold), b as (select fold, min(x) as low, max(x) as high from objects, f where frame % 5 <> fold group by fold) select fold, count(*) as n, {q6('avg(2 * (x - low) / (high - low + 1e-7) - 1)')} as scaled from objects join b on frame % 5 = fold group by fold", "objects")
def folds(spark, sf_dir):
    """Five folds by frame; each fold is scaled with the bounds of the others. Bounds come from per-fold bounds, not from five scans."""
    rows = objects(spark, sf_dir).withColumn("fold", F.col("frame") % 5)
    own = rows.groupBy("fold").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    others = own.select("fold").join(F.broadcast(own.withColumnRenamed("fold", "other")), F.col("fold") != F.col("other")).groupBy("fold").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return rows.join(F.broadcast(others), "fold").groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(2 * (F.col("x") - F.col("low")) / (F.col("high") - F.col("low") + 1e-7) - 1)).alias("scaled"))


@query("R06_switch_states", "select track_id, frame, (case when (frame + track_id) % 7 < 4 then 0 else 1 end)::int as state from track_points", "track_points")
def switch_states(spark, sf_dir):
    """A two-state machine that stays four frames in the first state and three in the second, with a phase for each track."""
    return simulate.switched(track_points(spark, sf_dir), dwell=(4, 3), phase="track_id").select("track_id", "frame", "state")
