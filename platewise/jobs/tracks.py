"""Track queries: steps, features, drift, moment scaling, runs, lineage (letters F and I of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.model import lineage, objects, q6, query, r6, table, track_points
from platewise.operators import statistics as S
from platewise.operators import tracks as T

STEP = """
pair as (select plate, track_id, frame, x, y, lead(x) over w - x as dx, lead(y) over w - y as dy from track_points window w as (partition by plate, track_id order by frame)),
step0 as (select *, sqrt(dx * dx + dy * dy) as displacement from pair where dx is not null),
step1 as (select *, (lag(dx) over w * dx + lag(dy) over w * dy) / nullif(sqrt(lag(dx) over w * lag(dx) over w + lag(dy) over w * lag(dy) over w) * displacement, 0) as cosine,
  displacement - lag(displacement) over w as acceleration from step0 window w as (partition by plate, track_id order by frame)),
step as (select *, acos(case when cosine > 1 then 1 when cosine < -1 then -1 else cosine end) as turning from step1)"""
TRACK = f"""{STEP},
ends as (select plate, track_id, count(*) as n, arg_min(x, frame) as x0, arg_min(y, frame) as y0, arg_max(x, frame) as x1, arg_max(y, frame) as y1 from track_points group by plate, track_id having count(*) >= 12),
agg as (select plate, track_id, count(*) as n_steps, sum(displacement) as total_length, avg(displacement) as mean_displacement, max(displacement) as max_displacement, avg(cos(turning)) as persistence, avg(turning) as mean_turning, avg(acceleration) as mean_acceleration, sum(displacement * displacement) as squared_length from step group by plate, track_id),
track as (select agg.*, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as effective_length, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / nullif(total_length, 0) as straightness from agg join ends using (plate, track_id))"""


@query("F03_track_features", f"""{TRACK} select plate, track_id, n_steps, {", ".join(f"{q6(c)} as {c}" for c in ("total_length", "mean_displacement", "max_displacement", "persistence", "mean_turning", "mean_acceleration", "effective_length", "straightness"))} from track""", "track_points")
def track_features(spark, sf_dir):
    rows = T.track_features(track_points(spark, sf_dir))
    return rows.select("plate", "track_id", "n_steps", *(r6(F.col(c)).alias(c) for c in ("total_length", "mean_displacement", "max_displacement", "persistence", "mean_turning", "mean_acceleration", "effective_length", "straightness")))


@query("F04_squared_step_length", f"""{STEP} select plate, track_id, {q6("sum(displacement * displacement)")} as sq_norm from step group by plate, track_id""", "track_points")
def squared_step_length(spark, sf_dir):
    return T.steps(track_points(spark, sf_dir)).groupBy("plate", "track_id").agg(r6(F.sum(F.col("displacement") * F.col("displacement"))).alias("sq_norm"))


@query("F01_drift_curve", f"""{STEP}, mean as (select plate, frame + 1 as frame, count(*) as n, avg(dx) as mx, avg(dy) as my from step group by plate, frame)
select plate, frame, n, {q6("sum(mx) over w")} as drift_x, {q6("sum(my) over w")} as drift_y from mean window w as (partition by plate order by frame rows unbounded preceding)""", "track_points")
def drift_curve(spark, sf_dir):
    return T.drift(track_points(spark, sf_dir)).select("plate", "frame", "n", r6(F.col("drift_x")).alias("drift_x"), r6(F.col("drift_y")).alias("drift_y"))


@query("F02_drift_corrected", f"""{STEP}, mean as (select plate, frame + 1 as frame, avg(dx) as mx, avg(dy) as my from step group by plate, frame),
curve as (select plate, frame, sum(mx) over w as cx, sum(my) over w as cy from mean window w as (partition by plate order by frame rows unbounded preceding))
select plate, track_id, frame, {q6("x - coalesce(cx, 0)")} as x, {q6("y - coalesce(cy, 0)")} as y from track_points left join curve using (plate, frame)""", "track_points")
def drift_corrected(spark, sf_dir):
    return T.corrected(track_points(spark, sf_dir)).select("plate", "track_id", "frame", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("F05_moment_scaling", f"""
n as (select plate, track_id, count(*) as n from track_points group by plate, track_id),
lagged as (select a.plate, a.track_id, b.frame - a.frame as lag, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as d from track_points a join n using (plate, track_id) join track_points b on a.plate = b.plate and a.track_id = b.track_id and b.frame > a.frame and b.frame - a.frame <= greatest(1, n.n // 3)),
m as (select plate, track_id, nu, ln(lag) as u, ln(nullif(avg(pow(d, nu)), 0)) as v from lagged, (select unnest([1, 2, 3, 4, 5, 6]) as nu) group by plate, track_id, nu, lag),
fit as (select plate, track_id, nu, count(*) as k, regr_slope(v, u) as gamma, regr_intercept(v, u) as c, corr(u, v) as r from m where v is not null group by plate, track_id, nu)
select plate, track_id, {q6("regr_slope(gamma, nu)")} as movement_type, {q6("max(case when nu = 2 then case when coalesce(r, 0) < 0.7 then 0 else exp(c) / 4 end end)")} as diffusion, sum(case when coalesce(r, 0) < 0.7 then 1 else 0 end)::bigint as adequation
from fit group by plate, track_id""", "track_points")
def moment_scaling(spark, sf_dir):
    return T.scaling(track_points(spark, sf_dir)).select("plate", "track_id", r6(F.col("movement_type")).alias("movement_type"), r6(F.col("diffusion")).alias("diffusion"), "adequation")


@query("F06_local_straightness", f"""w as (select plate, track_id, var_pop(x) over f as a, var_pop(y) over f as b, covar_pop(x, y) over f as c, count(*) over f as n from track_points window f as (partition by plate, track_id order by frame rows between current row and 9 following))
select plate, track_id, {q6("sum(greatest(0, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c)) * 10)")} as residual from w where n = 10 group by plate, track_id""", "track_points")
def local_straightness(spark, sf_dir):
    return T.local_straightness(track_points(spark, sf_dir)).select("plate", "track_id", r6(F.col("residual")).alias("residual"))


@query("F10_longest_consecutive_days", """d as (select distinct plate, label_day as day from (select plate, frame as label_day from objects where cls = 'purchase')),
i as (select plate, day, day - row_number() over (partition by plate order by day) as island from d),
r as (select plate, min(day) as first, max(day) as last, count(*) as length from i group by plate, island)
select plate, first, last, length from r qualify row_number() over (partition by plate order by length desc, first) = 1""", "objects")
def longest_consecutive_days(spark, sf_dir):
    return T.longest_runs(objects(spark, sf_dir).where("cls = 'purchase'"), ["plate"], "frame")


@query("F13_clip_track", "select plate, track_id, frame, x, y from track_points where frame between 5 and 20", "track_points")
def clip_track(spark, sf_dir):
    return track_points(spark, sf_dir).where(F.col("frame").between(5, 20))


@query("F15_objects_near_point", "select plate, track_id, frame from track_points where frame = 10 and sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) <= 50", "track_points")
def objects_near_point(spark, sf_dir):
    return track_points(spark, sf_dir).where((F.col("frame") == 10) & (X.norm(F.col("x") - 50, F.col("y") - 50) <= 50)).select("plate", "track_id", "frame")


@query("F18_segments_at_events", """p as (select plate, track_id, frame, x, case when x > 200 then 1 else 0 end as event from track_points), s as (select *, sum(event) over (partition by plate, track_id order by frame rows unbounded preceding)::bigint as segment from p)
select plate, track_id, segment, min(frame) as first, max(frame) as last, count(*) as n from s group by plate, track_id, segment""", "track_points")
def segments_at_events(spark, sf_dir):
    upto = T.ordered().rowsBetween(W.unboundedPreceding, 0)
    rows = track_points(spark, sf_dir).withColumn("segment", F.sum((F.col("x") > 200).cast("int")).over(upto))
    return rows.groupBy("plate", "track_id", "segment").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))


@query("F19_label_sequence", "select track_id, min(frame) as first, max(frame) as last, string_agg(y::int::varchar, '-' order by frame) as labels from track_points group by track_id", "track_points")
def label_sequence(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("y").cast("int").cast("string").alias("label")))), lambda s: s["label"])
    return track_points(spark, sf_dir).groupBy("track_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.array_join(ordered, "-").alias("labels"))


@query("F20_state_run_lengths", """s as (select track_id, frame, x > 50 as fast from track_points), m as (select *, case when fast is distinct from lag(fast) over w then 1 else 0 end as new from s window w as (partition by track_id order by frame)),
r as (select *, sum(new) over (partition by track_id order by frame rows unbounded preceding)::bigint as run from m) select track_id, run, bool_and(fast) as fast, count(*) as length from r group by track_id, run""", "track_points")
def state_run_lengths(spark, sf_dir):
    return T.run_lengths(track_points(spark, sf_dir).select("track_id", "frame", (F.col("x") > 50).alias("fast")), ["track_id"], "frame", "fast")


@query("F21_sharp_movements", f"{STEP} select plate, track_id, frame, {q6('turning')} as turning, {q6('displacement')} as displacement from step where turning > 0.7 and displacement > 10", "track_points")
def sharp_movements(spark, sf_dir):
    return T.steps(track_points(spark, sf_dir)).where("turning > 0.7 and displacement > 10").select("plate", "track_id", "frame", r6(F.col("turning")).alias("turning"), r6(F.col("displacement")).alias("displacement"))


@query("F26_cycle_length_and_evidence", """select user_id as track_id, (max(date_diff('day', date '2024-01-01', ts::date)) - min(date_diff('day', date '2024-01-01', ts::date)) + 1)::int as length, count(case when event_type = 'purchase' then 1 end) as mother_score, count(case when event_type in ('view', 'click') then 1 end) as daughter_score from events group by user_id having count(*) >= 5""")
def cycle_length_and_evidence(spark, sf_dir):
    day = F.datediff("ts", F.lit("2024-01-01"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id")).agg((F.max(day) - F.min(day) + 1).alias("length"), F.count_if(F.col("event_type") == "purchase").alias("mother_score"), F.count_if(F.col("event_type").isin("view", "click")).alias("daughter_score"), F.count("*").alias("n"))
    return rows.where("n >= 5").drop("n")


@query("F29_three_way_divisions", """select parent, max(case when ordinal = 1 then child end) as first_child, count(*) as n_children, min(size) as smallest, max(size) as largest from lineage group by parent having count(*) = 3""", "lineage")
def three_way_divisions(spark, sf_dir):
    rows = lineage(spark, sf_dir).groupBy("parent").agg(F.max(F.when(F.col("ordinal") == 1, F.col("child"))).alias("first_child"), F.count("*").alias("n_children"), F.min("size").alias("smallest"), F.max("size").alias("largest"))
    return rows.where("n_children = 3")


@query("F23_complete_tracks", """k as (select parent, count(*) as n from lineage group by parent having count(*) in (2, 3)), kids as (select distinct child as id from lineage join k using (parent))
select id from kids where id in (select parent from k)""", "lineage")
def complete_tracks(spark, sf_dir):
    edges = lineage(spark, sf_dir)
    dividing = edges.groupBy("parent").count().where("count in (2, 3)").select("parent")
    return edges.join(dividing, "parent").select(F.col("child").alias("id")).distinct().intersect(dividing.select(F.col("parent").alias("id")))


@query("F24_mother_and_siblings", """select a.parent, a.child, a.ordinal, count(b.child) as siblings, min(b.child) as first_sibling from lineage a left join lineage b on a.parent = b.parent and a.ordinal <> b.ordinal group by a.parent, a.child, a.ordinal""", "lineage")
def mother_and_siblings(spark, sf_dir):
    a, b = lineage(spark, sf_dir).alias("a"), lineage(spark, sf_dir).alias("b")
    rows = a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.ordinal") != F.col("b.ordinal")), "left")
    return rows.groupBy("a.parent", "a.child", "a.ordinal").agg(F.count("b.child").alias("siblings"), F.min("b.child").alias("first_sibling"))


@query("F31_objects_at_last_frame", "select plate, max(frame) as frame, count(case when frame = last then 1 end) as n from (select *, max(frame) over (partition by plate) as last from objects) group by plate", "objects")
def objects_at_last_frame(spark, sf_dir):
    counts = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.count("*").alias("n"))
    return counts.groupBy("plate").agg(F.max("frame").alias("frame"), F.max_by("n", "frame").alias("n"))


@query("F03_shape_features")
def shape_features(spark, sf_dir):
    return T.shape_features(track_points(spark, sf_dir), 25.0).select("plate", "track_id", r6(F.col("hull_area")).alias("hull_area"), "balls", r6(F.col("ball_entropy")).alias("ball_entropy"))


@query("E26_mean_speed_over_time", f"""{STEP}, s as (select plate, frame, avg(displacement) as v, count(*) as n from step group by plate, frame), m as (select *, avg(v) over (partition by plate order by frame rows between current row and 5 following) as smooth from s),
b as (select plate, avg(v) as base from s where frame < 6 group by plate) select plate, frame, n, {q6("v")} as speed, {q6("smooth / nullif(base, 0)")} as relative_speed from m join b using (plate)""", "track_points")
def mean_speed_over_time(spark, sf_dir):
    speed = T.steps(track_points(spark, sf_dir)).groupBy("plate", "frame").agg(F.avg("displacement").alias("v"), F.count("*").alias("n"))
    smooth = speed.withColumn("smooth", T.forward_mean(speed, ["plate"], "frame", "v", 6))
    base = speed.where("frame < 6").groupBy("plate").agg(F.avg("v").alias("base"))
    return smooth.join(base, "plate").select("plate", "frame", "n", r6(F.col("v")).alias("speed"), r6(F.col("smooth") / F.when(F.col("base") != 0, F.col("base"))).alias("relative_speed"))


KS_P = X.kolmogorov_sf_sql("((sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d)")


@query("motility_vs_control", f"""{TRACK},
pool as (select mean_displacement as v from track where plate = 0),
both_ as (select plate, mean_displacement as v, 1 as mine from track where plate <> 0 union all select p.plate, v, 0 from (select distinct plate from track where plate <> 0) p, pool),
c as (select plate, v, sum(mine) as a, sum(1 - mine) as b from both_ group by plate, v),
k as (select plate, sum(a) over w as ca, sum(b) over w as cb, sum(a) over z as n1, sum(b) over z as n2 from c window w as (partition by plate order by v rows unbounded preceding), z as (partition by plate)),
t as (select plate, n1::double as n1, n2::double as n2, max(abs(ca / n1 - cb / n2)) as d from k group by plate, n1, n2),
p as (select plate, n1, n2, d, {KS_P} as p from t),
r as (select *, least(1, p * count(*) over () / row_number() over (order by p, plate)) as raw from p),
q as (select *, min(raw) over (order by p, plate rows between current row and unbounded following) as q from r)
select plate, n1::bigint as n_tracks, n2::bigint as n_control, {q6("d")} as d, {q6("p")} as p, {q6("q")} as q, q < 0.05 as hit from q""", "track_points")
def motility_vs_control(spark, sf_dir):
    """Each plate's tracks against the control plate's: KS on the mean displacement, BH over plates, hits at 5 %."""
    tracks = T.track_features(track_points(spark, sf_dir)).select("plate", "mean_displacement")
    both = S.against_pool(tracks.where("plate <> 0"), tracks.where("plate = 0"), ["plate"], "mean_displacement")
    rows = S.bh(S.kolmogorov_smirnov(both, ["plate"]))
    return rows.select("plate", F.col("n1").alias("n_tracks"), F.col("n2").alias("n_control"), r6(F.col("d")).alias("d"), r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"), (F.col("q") < 0.05).alias("hit"))


@query("I02_distance_to_border", f"select plate, frame, label, {q6('least(x, y, 500 - x, 500 - y)')} as to_border from objects", "objects")
def distance_to_border(spark, sf_dir):
    return objects(spark, sf_dir).select("plate", "frame", "label", r6(F.least(F.col("x"), F.col("y"), 500 - F.col("x"), 500 - F.col("y"))).alias("to_border"))


@query("I03_turning_angles", f"{STEP} select plate, track_id, frame, {q6('turning')} as turning, {q6('degrees(turning)')} as degrees from step where turning is not null", "track_points")
def turning_angles(spark, sf_dir):
    return T.steps(track_points(spark, sf_dir)).where("turning is not null").select("plate", "track_id", "frame", r6(F.col("turning")).alias("turning"), r6(F.degrees("turning")).alias("degrees"))


@query("I07_class_entropy", f"""n as (select plate, frame, cls, count(*) as n from objects group by plate, frame, cls), p as (select plate, frame, n / sum(n) over (partition by plate, frame) as p from n)
select plate, frame, count(*) as classes, {q6("sum(-p * ln(p)) / nullif(ln(count(*)), 0)")} as entropy from p group by plate, frame""", "objects")
def class_entropy(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "frame", "cls").agg(F.count("*").alias("n")).groupBy("plate", "frame").agg(F.collect_list(F.col("n").cast("double")).alias("a"))
    return n.select("plate", "frame", F.size("a").cast("bigint").alias("classes"), r6(X.entropy(F.transform("a", lambda v: v / X.sum_of(F.col("a"))))).alias("entropy"))


@query("I09_log_transform", f"m as (select least(0, min(x - 50)) as low from track_points) select plate, track_id, frame, {q6('ln(x - 50 + 1 - low)')} as log_x, {q6('1 / (1 + exp(-0.1 * (x - 50)))')} as gate from track_points, m", "track_points")
def log_transform(spark, sf_dir):
    rows = track_points(spark, sf_dir)
    low = rows.agg(F.least(F.lit(0.0), F.min(F.col("x") - 50)).alias("low"))
    return rows.crossJoin(F.broadcast(low)).select("plate", "track_id", "frame", r6(F.ln(F.col("x") - 50 + 1 - F.col("low"))).alias("log_x"), r6(X.sigmoid(F.col("x") - 50, 0.1)).alias("gate"))


# ---- starts and ends, divisions, small scalar functions

SPAN = """s as (select user_id % 5 as plate, user_id as track_id, min(date_diff('day', date '2024-01-01', ts::date)) as first, max(date_diff('day', date '2024-01-01', ts::date)) as last from events group by 1, 2),
e as (select plate, min(first) as m_start, max(last) as m_end from s group by plate), g as (select parent, child from lineage where size >= 45), sp as (select parent, count(distinct child) as k from g group by parent), me as (select child, count(distinct parent) as k from g group by child),
code as (select s.plate, track_id, first, last, case when first = m_start then 0 when exists (select 1 from g where g.child = track_id) then 2 else 1 end as start_code, case when last = m_end then 0 when exists (select 1 from sp where sp.parent = track_id and k > 1) then 2 when exists (select 1 from g join me using (child) where g.parent = track_id and me.k > 1) then 3 else 1 end as end_code from s join e using (plate))"""


def _codes(spark, sf_dir):
    """plate, track_id, first, last, start_code, end_code: spans in days, and what the lineage events (those of size 45 and more) say of the ends."""
    day = F.datediff("ts", F.lit("2024-01-01"))
    spans = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("plate"), F.col("user_id").alias("track_id")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return T.end_codes(spans, lineage(spark, sf_dir).where("size >= 45"))


@query("F07_start_and_end_codes", f"{SPAN} select track_id, start_code::int as start_code, end_code::int as end_code from code", "lineage")
def start_and_end_codes(spark, sf_dir):
    return _codes(spark, sf_dir).select("track_id", "start_code", "end_code")


@query("F08_ends_by_kind", f"{SPAN} select plate, end_code::int as end_code, count(*) as n, max(last)::int as latest from code group by 1, 2", "lineage")
def ends_by_kind(spark, sf_dir):
    return _codes(spark, sf_dir).groupBy("plate", "end_code").agg(F.count("*").alias("n"), F.max("last").alias("latest"))


@query("C22_without_division_moves", f"{SPAN}, r as (select p.*, start_code, end_code, row_number() over (partition by track_id order by frame) as a, row_number() over (partition by track_id order by frame desc) as z from track_points p join code using (track_id)) select plate, track_id, frame, x, y from r where not (start_code = 2 and a <= 2) and not (end_code in (2, 3) and z <= 2)", "track_points lineage")
def without_division_moves(spark, sf_dir):
    return T.without_division_moves(track_points(spark, sf_dir), _codes(spark, sf_dir))


DRIFTED = """
pair as (select plate, track_id, frame, x, y, lead(x) over w - x as dx, lead(y) over w - y as dy from track_points window w as (partition by plate, track_id order by frame)),
mean as (select plate, frame + 1 as frame, avg(dx) as mx, avg(dy) as my from pair where dx is not null group by plate, frame),
curve as (select plate, frame, sum(mx) over w as cx, sum(my) over w as cy from mean window w as (partition by plate order by frame rows unbounded preceding)),
still as (select plate, track_id, frame, x - coalesce(cx, 0) as x, y - coalesce(cy, 0) as y from track_points left join curve using (plate, frame)),
cut as (select s.*, start_code, end_code, row_number() over (partition by track_id order by frame) as a, row_number() over (partition by track_id order by frame desc) as z from still s join code using (track_id)),
kept as (select plate, track_id, frame, x, y from cut where not (start_code = 2 and a <= 2) and not (end_code in (2, 3) and z <= 2)),
long_ as (select * from kept where track_id in (select track_id from kept group by track_id having count(*) >= 12)),
v1 as (select plate, track_id, frame, lead(x) over w - x as dx, lead(y) over w - y as dy, var_pop(x) over f as va, var_pop(y) over f as vb, covar_pop(x, y) over f as vc, count(*) over f as vn from long_ window w as (partition by track_id order by frame), f as (partition by track_id order by frame rows between current row and 9 following)),
v2 as (select *, sqrt(dx * dx + dy * dy) as displacement, sum(dx * dx + dy * dy) over (partition by track_id order by frame rows between current row and 8 following) as squares from v1),
v3 as (select *, lag(displacement) over w as before, lag(dx) over w as px, lag(dy) over w as py from v2 window w as (partition by track_id order by frame)),
v4 as (select *, case when before is null then null when before > 1e-9 and displacement > 1e-9 then greatest(-1, least(1, (px * dx + py * dy) / (before * displacement))) else 1 end as persistence from v3 where displacement is not null),
v as (select plate, track_id, frame, displacement, displacement - before as acceleration, persistence, acos(persistence) as turning, case when before > 1e-9 and displacement > 1e-9 then atan2(dy, dx) - atan2(py, px) end as change, before, case when vn = 10 and squares > 1e-9 then greatest(0, (va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + vc * vc)) * 10 / squares end as straight from v4),
ends_ as (select track_id, count(*) as n, arg_min(x, frame) as x0, arg_min(y, frame) as y0, arg_max(x, frame) as x1, arg_max(y, frame) as y1 from long_ group by track_id),
sums as (select track_id, sum(displacement) as total_length, max(displacement) as largest_move, avg(displacement * displacement) as mean_squared_displacement, abs(atan2(sum(sin(change)), sum(cos(change)))) as signed_turning, avg(acceleration) as mean_acceleration, avg(displacement) as mean_displacement, avg(persistence) as mean_persistence, avg(straight) as mean_straight, avg(turning) as mean_turning, regr_slope(persistence, before) as speed_slope, corr(persistence, before) as speed_correlation from v group by track_id),
vec as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as effective_length from sums join ends_ using (track_id))"""
VECTOR = ("total_length", "effective_length", "largest_move", "mean_squared_displacement", "signed_turning", "mean_acceleration", "mean_displacement", "mean_persistence", "mean_straight", "mean_turning", "speed_slope", "speed_correlation", "effective_speed", "corrected_straightness")


def _clean_points(spark, sf_dir):
    """Points without drift and without the moves next to divisions, of tracks of at least 12 that are left."""
    points = T.without_division_moves(T.corrected(track_points(spark, sf_dir)), _codes(spark, sf_dir))
    return points.withColumn("n", F.count("*").over(W.partitionBy("plate", "track_id"))).where("n >= 12").drop("n")


@query("F03_trajectory_vectors", f"""{SPAN}, {DRIFTED.strip()}, w as (select *, effective_length / sqrt(n - 1) as effective_speed, sqrt(n) * effective_length / nullif(total_length, 0) as corrected_straightness from vec) select track_id, n, {", ".join(f"{q6(c)} as {c}" for c in VECTOR)} from w""", "track_points lineage")
def trajectory_vectors(spark, sf_dir):
    """Of the feature vector what SQL has too; F03_shape_vectors has the rest."""
    return T.step_vectors(_clean_points(spark, sf_dir)).select("track_id", "n", *[r6(F.col(c)).alias(c) for c in VECTOR])


@query("F03_shape_vectors")
def shape_vectors(spark, sf_dir):
    rest = ("hull_area", "hull_area_of_step", "balls1", "entropy1", "balls2", "entropy2", "movement_type", "diffusion")
    return T.shape_vectors(_clean_points(spark, sf_dir)).select("track_id", "n", "adequation", *[r6(F.col(c)).alias(c) for c in rest])


DISTRIBUTIONS = ("displacement", "acceleration", "persistence", "turning", "straight")


@query("F03_step_distributions", f"""{SPAN}, {DRIFTED.strip()} select track_id, frame, {", ".join(f"{q6(c)} as {c}" for c in DISTRIBUTIONS)} from v""", "track_points lineage")
def step_distributions(spark, sf_dir):
    return T.step_values(_clean_points(spark, sf_dir)).select("track_id", "frame", *[r6(F.col(c)).alias(c) for c in DISTRIBUTIONS])


@query("F11_first_wins", "select plate, frame, label from objects qualify row_number() over (partition by plate, frame order by label) = 1", "objects")
def first_wins(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate", "frame").agg(F.min("label").alias("label"))


@query("F22_flattened_measure", f"{STEP} select {q6('displacement')} as displacement, count(*) as n from step where displacement > 100 group by 1", "track_points")
def flattened_measure(spark, sf_dir):
    return T.steps(track_points(spark, sf_dir)).where("displacement > 100").groupBy(r6(F.col("displacement")).alias("displacement")).agg(F.count("*").alias("n"))


@query("F28_score_grid", f"s as (select user_id, least(count(case when event_type = 'purchase' then 1 end), 2) as a, least(count(case when event_type = 'click' then 1 end), 4) as b, max(value) > 200 as accepted from events group by user_id) select a, b, count(*) as n, {q6('100 * count(case when accepted then 1 end) / (count(*) + 1e-4)')} as precision from s group by a, b")
def score_grid(spark, sf_dir):
    e = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.count_if(e == "purchase"), F.lit(2)).alias("a"), F.least(F.count_if(e == "click"), F.lit(4)).alias("b"), (F.max("value") > 200).alias("accepted"))
    return s.groupBy("a", "b").agg(F.count("*").alias("n"), r6(100 * F.count_if("accepted") / (F.count("*") + 1e-4)).alias("precision"))


@query("F30_bounding_boxes", "select plate, frame, min(x) - 3 as x0, max(x) + 3 as x1, min(y) - 3 as y0, max(y) + 3 as y1 from objects where cls = 'purchase' group by plate, frame", "objects")
def bounding_boxes(spark, sf_dir):
    return objects(spark, sf_dir).where("cls = 'purchase'").groupBy("plate", "frame").agg(*[(f(c) + d).alias(n) for n, f, c, d in (("x0", F.min, "x", -3), ("x1", F.max, "x", 3), ("y0", F.min, "y", -3), ("y1", F.max, "y", 3))])


@query("I13_positions_and_coordinates", "select p.position, (p.position - 1) // 12 as row, (p.position - 1) % 12 as col, radians(p.position) as angle, ((p.position - 1) // 12) * 12 + (p.position - 1) % 12 + 1 as back from (select distinct user_id % 384 + 1 as position from events) p")
def positions_and_coordinates(spark, sf_dir):
    p = table(spark, sf_dir, "events").select((F.col("user_id") % 384 + 1).alias("position")).distinct()
    row, col = F.floor((F.col("position") - 1) / 12), (F.col("position") - 1) % 12
    return p.select("position", row.alias("row"), col.alias("col"), F.radians("position").alias("angle"), (row * 12 + col + 1).alias("back"))


@query("I15_parameter_key", "select distinct 'cls=' || event_type || '|plate=' || (user_id % 5)::varchar as key from events")
def parameter_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat_ws("|", F.concat(F.lit("cls="), "event_type"), F.concat(F.lit("plate="), (F.col("user_id") % 5).cast("string"))).alias("key")).distinct()


@query("J36_length_correlations", f"{TRACK} select plate, count(*) as n, {q6('corr(n_steps, mean_displacement)')} as r, {q6('avg((total_length - effective_length) ** 2)')} as mse from track group by plate", "track_points")
def length_correlations(spark, sf_dir):
    rows = T.track_features(track_points(spark, sf_dir))
    gap = F.col("total_length") - F.col("effective_length")
    return rows.groupBy("plate").agg(F.count("*").alias("n"), r6(F.corr(F.col("n_steps").cast("double"), "mean_displacement")).alias("r"), r6(F.avg(gap * gap)).alias("mse"))
