"""Further scans, filters, joins, counts and small functions of the inventory (letters A to I), each a query of its own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.functions import expressions as X
from platewise.jobs.tracks import SPAN, STEP, _codes
from platewise.model import PLATES, WIDTH, features, lineage, objects, q6, qc, query, r6, screen, table, track_points, wells
from platewise.operators import clean as C
from platewise.operators import clusters as L
from platewise.operators import distances as K
from platewise.operators import samples
from platewise.operators import statistics as S
from platewise.operators import tracks as T
from platewise.sources import stored

CENTROIDS = "m as (select plate, frame, avg(x) as x, avg(y) as y from objects group by plate, frame)"
SEEDED = samples.order_sql


def _centroids(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


# ---- A, B: sources and sinks' tables


@query("A07_object_ids", "select frame, label from objects", "objects")
def object_ids(spark, sf_dir):
    return objects(spark, sf_dir).select("frame", "label")


@query("A17_layout_parameters", "select sirna // 384 as layout, position, 'gene' as parameter, gene as value from wells union all select sirna // 384, position, 'size', size::varchar from wells", "wells")
def layout_parameters(spark, sf_dir):
    """A row for each parameter of each well."""
    rows = wells(spark, sf_dir).select(F.floor(F.col("sirna") / 384).alias("layout"), "position", "gene", F.col("size").cast("string").alias("size"))
    return rows.unpivot(["layout", "position"], ["gene", "size"], "parameter", "value")


@query("A21_position_map", "select distinct position, row, col, (col - 1) * 32 + row as by_column from wells", "wells")
def position_map(spark, sf_dir):
    return wells(spark, sf_dir).select("position", "row", "col", ((F.col("col") - 1) * 32 + F.col("row")).alias("by_column")).distinct()


@query("A23_stacked_results", f"select 'batch' as kind, batch::varchar as name, count(*) as n, {q6('avg(measure)')} as value from screen group by batch union all select 'gene', gene, count(*), {q6('avg(measure)')} from screen group by gene", "screen")
def stacked_results(spark, sf_dir):
    rows = screen(spark, sf_dir)
    part = lambda kind, c: rows.groupBy(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"), r6(F.avg("measure")).alias("value"))
    return part("batch", "batch").unionByName(part("gene", "gene"))


@query("A24_random_controls", f"select sirna, gene from (select distinct sirna, gene from screen where is_control) order by {SEEDED('sirna', 3)}, sirna limit 25", "screen")
def random_controls(spark, sf_dir):
    """In a random order, the first 25 control wells: a sampling operator."""
    return samples.first_n(screen(spark, sf_dir).where("is_control").select("sirna", "gene").distinct(), "sirna", 25, 3)


@query("A25_scaled_candidates", f"c as (select a.plate, a.frame, a.label, b.label as to_label, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as d from objects a join objects b on a.plate = b.plate and b.frame = a.frame + 1 and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8), k as (select * from c where d <= 8) select plate, frame, label, to_label, {q6('2 * (d - min(d) over (partition by plate)) / (max(d) over (partition by plate) - min(d) over (partition by plate) + 1e-7) - 1')} as scaled from k", "objects")
def scaled_candidates(spark, sf_dir):
    from platewise.jobs.tracking import _candidates, _place_pairs

    rows = _candidates(spark, sf_dir).where("not isnan(d)")
    bounds = _place_pairs(spark, sf_dir).groupBy("plate").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return rows.join(F.broadcast(bounds), "plate").select("plate", "frame", "label", "to_label", r6(2 * (F.col("d") - F.col("low")) / (F.col("high") - F.col("low") + 1e-7) - 1).alias("scaled"))


@query("A26_objects_with_annotation", "select o.plate, o.frame, o.label, q.passed as annotation from objects o left join qc q on q.doc_id = o.label", "objects qc")
def objects_with_annotation(spark, sf_dir):
    notes = qc(spark, sf_dir).select(F.col("doc_id").alias("label"), F.col("passed").alias("annotation"))
    return objects(spark, sf_dir).select("plate", "frame", "label").join(notes, "label", "left").select("plate", "frame", "label", "annotation")


@query("A27_experiment_list", "select distinct plate, sirna % 384 + 1 as position from screen", "screen")
def experiment_list(spark, sf_dir):
    return screen(spark, sf_dir).select("plate", (F.col("sirna") % 384 + 1).alias("position")).distinct()


@query("B13_thinned_first_of_class", f"s as (select label, cls, row_number() over (partition by cls order by label)::int as k from objects where {SEEDED('label', 4)} < '1999') select * from s where k <= case when cls = 'purchase' then 5 else 6 end", "objects")
def thinned_first_of_class(spark, sf_dir):
    """Each candidate with probability 1/10; of these the first of each class in the order of the list."""
    return samples.thinned_first(objects(spark, sf_dir).select("label", "cls"), "cls", "label", 4, F.when(F.col("cls") == "purchase", 5).otherwise(6))


@query("B16_frame_offsets", f"select plate, track_id, (frame + ('0x' || substr({SEEDED('track_id', 9)}, 1, 4))::int % 12)::int as frame, x, y from track_points", "track_points")
def frame_offsets(spark, sf_dir):
    """A random start for every trajectory, the same for all its points."""
    offset = F.conv(F.substring(samples.order("track_id", 9), 1, 4), 16, 10).cast("int") % 12
    return track_points(spark, sf_dir).select("plate", "track_id", (F.col("frame") + offset).alias("frame"), "x", "y")


# ---- C: cleaning


@query("C02_without_elements", f"select exp, {q6('list_sum(list_concat(f[2:3], f[5:]))')} as rest from features", "features")
def without_elements(spark, sf_dir):
    """Vectors without their elements 0 and 3."""
    return features(spark, sf_dir).select("exp", r6(X.sum_of(F.filter("f", lambda v, i: ~i.isin(0, 3)))).alias("rest"))


@query("C04_without_columns", "select plate, frame, label, x from objects", "objects")
def without_columns(spark, sf_dir):
    return objects(spark, sf_dir).drop("y", "cls")


@query("C08_scaled_back", f"select label, {q6('x')} as x from objects", "objects")
def scaled_back(spark, sf_dir):
    """Min-max scaling and its inverse: the round trip gives the values back."""
    rows = objects(spark, sf_dir)
    bounds = rows.groupBy("cls").agg(F.min("x").alias("low"), (F.max("x") - F.min("x") + 1e-7).alias("span"))
    scaled = rows.join(F.broadcast(bounds), "cls").withColumn("s", 2 * (F.col("x") - F.col("low")) / F.col("span") - 1)
    return scaled.select("label", r6((F.col("s") + 1) / 2 * F.col("span") + F.col("low")).alias("x"))


@query("C12_counts_of_usable_plates", "u as (select plate from objects group by plate having avg(case when cls = 'error' then 1.0 else 0 end) < 0.3) select plate, frame, count(*) as n from objects join u using (plate) group by plate, frame", "objects")
def counts_of_usable_plates(spark, sf_dir):
    rows = objects(spark, sf_dir)
    usable = rows.groupBy("plate").agg((F.count_if(F.col("cls") == "error") / F.count("*")).alias("blurred")).where("blurred < 0.3").select("plate")
    return rows.join(F.broadcast(usable), "plate", "left_semi").groupBy("plate", "frame").agg(F.count("*").alias("n"))


@query("C15_reasons_of_failure", """c as (select plate, frame, count(*) as n, count(case when cls = 'error' then 1 end) / count(*) as blurred from objects group by plate, frame), b as (select plate, min(frame) as first, max(frame) as last from c group by plate), s as (select plate, avg(case when frame < first + 10 then n end) as initial, avg(case when frame > last - 10 then blurred end) as blurred from c join b using (plate) group by plate)
select plate, case when plate = 3 then 'manual' when initial < 60 then 'few cells' when blurred > 0.21 then 'out of focus' else 'passed' end as reason from s""", "objects")
def reasons_of_failure(spark, sf_dir):
    """The manual list first, then the initial count, then focus."""
    rows = C.count_qc(objects(spark, sf_dir), "error", 60, 0.21)
    return rows.select("plate", F.when(F.col("plate") == 3, "manual").when(F.col("initial") < 60, "few cells").when(F.col("blurred") > 0.21, "out of focus").otherwise("passed").alias("reason"))


@query("C17_usable_mapped", "select distinct s.sirna from screen s join wells w using (sirna) where s.batch <> 1998 and w.gene not in (select gene from wells group by gene having min(size) < 1)", "screen wells")
def usable_mapped(spark, sf_dir):
    """siRNAs that are mapped to a gene, outside the batch that validation replaced."""
    lib = wells(spark, sf_dir)
    odd = lib.groupBy("gene").agg(F.min("size").alias("low")).where("low < 1").select("gene")
    return screen(spark, sf_dir).where("batch <> 1998").select("sirna").join(lib.join(odd, "gene", "left_anti").select("sirna"), "sirna", "left_semi").distinct()


@query("C18_failed_with_exceptions", "c as (select plate, count(case when frame = 0 then 1 end) as initial, count(case when cls = 'error' then 1 end) / count(*) as blurred from objects group by plate) select plate, initial, blurred > 0.15 and initial <= 50 as failed from c", "objects")
def failed_with_exceptions(spark, sf_dir):
    """Out of focus, but plates that began with more than 50 cells are kept."""
    c = objects(spark, sf_dir).groupBy("plate").agg(F.count_if(F.col("frame") == 0).alias("initial"), (F.count_if(F.col("cls") == "error") / F.count("*")).alias("blurred"))
    return c.select("plate", "initial", ((F.col("blurred") > 0.15) & (F.col("initial") <= 50)).alias("failed"))


@query("C19_rule_by_plate", "select plate, sirna, case when plate in (0, 2) then min(measure) > 2000 else max(measure) > 20000 end as accepted from screen group by plate, sirna", "screen")
def rule_by_plate(spark, sf_dir):
    rows = screen(spark, sf_dir).groupBy("plate", "sirna").agg(F.min("measure").alias("low"), F.max("measure").alias("high"))
    return rows.select("plate", "sirna", F.when(F.col("plate").isin(0, 2), F.col("low") > 2000).otherwise(F.col("high") > 20000).alias("accepted"))


@query("C20_usable_controls", "select distinct plate, sirna from screen where is_control and sirna not in (select doc_id from qc where not passed)", "screen qc")
def usable_controls(spark, sf_dir):
    failed = qc(spark, sf_dir).where(~F.col("passed")).select(F.col("doc_id").alias("sirna"))
    return screen(spark, sf_dir).where("is_control").select("plate", "sirna").distinct().join(failed, "sirna", "left_anti").select("plate", "sirna")


@query("C25_count_of_small_events", "select parent, count(case when size <= 4 then 1 end) as small, count(*) as n from lineage group by parent", "lineage")
def count_of_small_events(spark, sf_dir):
    return lineage(spark, sf_dir).groupBy("parent").agg(F.count_if(F.col("size") <= 4).alias("small"), F.count("*").alias("n"))


@query("C26_names_by_score", "s as (select user_id, frame, count(case when event_type = 'purchase' then 1 end) as a, count(case when event_type = 'click' then 1 end) as b from (select *, date_diff('day', date '2024-01-01', ts::date) as frame from events) group by user_id, frame), n as (select least(a, 9) || '_' || least(b, 9) || '_' || user_id || '_' || frame as name, user_id, frame, least(a, 9) as a, least(b, 9) as b from s) select name from n where substr(name, 1, 3) in ('1_0', '0_1', '1_1') and not exists (select 1 from n m where m.user_id = n.user_id and m.frame = n.frame + 1)")
def names_by_score(spark, sf_dir):
    """Names that begin with a score pair of the level, without those whose follow-up frame is there as well."""
    e = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("frame")).agg(F.least(F.count_if(e == "purchase"), F.lit(9)).alias("a"), F.least(F.count_if(e == "click"), F.lit(9)).alias("b"))
    n = s.select("user_id", "frame", F.concat_ws("_", "a", "b", "user_id", "frame").alias("name"))
    return n.where(F.substring("name", 1, 3).isin("1_0", "0_1", "1_1")).join(n.select("user_id", (F.col("frame") - 1).alias("frame")), ["user_id", "frame"], "left_anti").select("name")


@query("C27_bad_features", "u as (select generate_subscripts(f, 1) - 1 as i, unnest(f) as v from features) select i::int as i, count(*) as n, count(case when v is null or isnan(v) then 1 end) as bad from u group by i", "features")
def bad_features(spark, sf_dir):
    return C.long_features(features(spark, sf_dir), []).groupBy("i").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull() | F.isnan("v")).alias("bad"))


@query("C28_lengths_after_cleaning", "t as (select plate, track_id, count(*) as n from track_points group by plate, track_id) select plate, count(*) as n_tracks, count(case when n < 6 then 1 end) as n_deleted from t group by plate", "track_points")
def lengths_after_cleaning(spark, sf_dir):
    t = track_points(spark, sf_dir).groupBy("plate", "track_id").agg(F.count("*").alias("n"))
    return t.groupBy("plate").agg(F.count("*").alias("n_tracks"), F.count_if(F.col("n") < 6).alias("n_deleted"))


# ---- D: lookups


@query("D05_first_plate_of_prefix", "b as (select distinct gene from wells) select sirna, w.gene, (select min(b.gene) from b where contains(b.gene, substr(w.gene, 1, 7))) as plate from wells w", "wells")
def first_plate_of_prefix(spark, sf_dir):
    """The first name that contains an id's first seven characters."""
    rows = wells(spark, sf_dir).select("sirna", "gene", F.substring("gene", 1, 7).alias("prefix"))
    names = rows.select("gene").distinct()  # one row a gene; contained prefixes are all substrings of seven
    grams = names.withColumn("prefix", F.explode(F.expr("transform(sequence(1, greatest(1, length(gene) - 6)), i -> substring(gene, i, 7))"))).groupBy("prefix").agg(F.min("gene").alias("plate"))
    return rows.join(grams, "prefix").select("sirna", "gene", "plate")


@query("D07_labels_with_sirna", "select f.exp, f.condition, w.gene from features f join wells w on w.sirna = f.exp", "features wells")
def labels_with_sirna(spark, sf_dir):
    """Rows of experiments that have no siRNA go."""
    return features(spark, sf_dir).select("exp", "condition").join(wells(spark, sf_dir).select(F.col("sirna").alias("exp"), "gene"), "exp")


@query("D10_points_with_box_ordinal", "b as (select plate, frame, label, row_number() over (partition by plate, frame order by label)::int as ordinal from objects where cls = 'purchase') select o.plate, o.frame, o.label, b.ordinal from objects o join b on b.plate = o.plate and b.frame = o.frame and b.label = o.label", "objects")
def points_with_box_ordinal(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label", "cls")
    boxes = rows.where("cls = 'purchase'").select("plate", "frame", "label", F.row_number().over(W.partitionBy("plate", "frame").orderBy("label")).alias("ordinal"))
    return rows.select("plate", "frame", "label").join(boxes, ["plate", "frame", "label"])


@query("D12_feature_through_correspondence", "select l.parent, l.ordinal::int as ordinal, w.size, w.position from lineage l join wells w on w.sirna = l.child join (select distinct o_orderkey from orders) o on o.o_orderkey = l.parent", "lineage wells")
def feature_through_correspondence(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"))
    return lineage(spark, sf_dir).join(wells(spark, sf_dir).withColumnRenamed("sirna", "child").drop("row", "col").withColumnRenamed("size", "of_child"), "child").join(own, "parent", "left_semi").select("parent", "ordinal", F.col("of_child").alias("size"), "position")


@query("D13_arity_of_label", "g as (select * from lineage where size >= 50), c as (select parent, count(*) as arity from g group by parent) select child as label, max(arity) as arity from g join c using (parent) group by child having count(distinct arity) = 1", "lineage")
def arity_of_label(spark, sf_dir):
    """The arity of a label's event; labels in events of several arities are left out."""
    edges = lineage(spark, sf_dir).where("size >= 50")
    c = edges.groupBy("parent").agg(F.count("*").alias("arity"))
    return edges.join(c, "parent").groupBy(F.col("child").alias("label")).agg(F.max("arity").alias("arity"), F.min("arity").alias("low")).where("arity = low").select("label", "arity")


@query("D14_index_in_list", "select plate, frame, label, row_number() over (partition by plate, frame order by label)::int - 1 as idx from objects", "objects")
def index_in_list(spark, sf_dir):
    """The place of a label in its frame's list; a duplicate is an error."""
    at = W.partitionBy("plate", "frame").orderBy("label")
    again = F.when(F.lag("label").over(at) == F.col("label"), F.raise_error(F.lit("a label twice in one frame")))
    rows = objects(spark, sf_dir).select("plate", "frame", "label", (F.row_number().over(at) - 1).alias("idx"), again.cast("string").alias("again"))
    return rows.where("again is null").drop("again")


@query("D16_best_overlap", "n as (select plate, track_id, cls, count(*) as n from (select user_id % 5 as plate, user_id as track_id, event_type as cls from events) group by all), k as (select *, max(n) over (partition by track_id) as top from n) select track_id, case when count(*) = 1 then max(cls) end as best from k where n = top group by track_id")
def best_overlap(spark, sf_dir):
    """The set that shares most objects with a track; none where two share equally many."""
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id"), F.col("event_type").alias("cls")).agg(F.count("*").alias("n"))
    top = n.groupBy("track_id").agg(F.max("n").alias("top"))
    return n.join(top, "track_id").where("n = top").groupBy("track_id").agg(F.count("*").alias("k"), F.max("cls").alias("cls")).select("track_id", F.when(F.col("k") == 1, F.col("cls")).alias("best"))


@query("D18_nearest_in_other_segmentation", f"a as (select * from objects where cls = 'purchase'), b as (select * from objects where cls = 'view'), c as (select a.label, b.label as other, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as d from a join b on a.plate = b.plate and a.frame = b.frame and abs(b.x - a.x) <= 40 and abs(b.y - a.y) <= 40), n as (select label, other, d from c where d <= 40 qualify row_number() over (partition by label order by d, other) = 1) select a.label, n.other, {q6('n.d')} as d from a left join n using (label)", "objects")
def nearest_in_other_segmentation(spark, sf_dir):
    """Within 40; labels without a partner stay, with nulls."""
    from platewise.operators import assignment as A

    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y", "cls")
    a, b = rows.where("cls = 'purchase'"), rows.where("cls = 'view'")
    at = ["plate", "frame", "x", "y"]
    near = A.nearest(stored(A.places(a, at[:2]), "places"), stored(A.places(b, at[:2]), "others"), at[:2], 40.0).select(*at, "to_label", "d")
    return a.join(near, at, "left").select("label", F.col("to_label").alias("other"), r6(F.col("d")).alias("d"))


@query("D19_same_prefix", "select substr(gene, 1, 7) as prefix, count(distinct gene) as genes, count(*) as n from wells group by 1", "wells")
def same_prefix(spark, sf_dir):
    return wells(spark, sf_dir).groupBy(F.substring("gene", 1, 7).alias("prefix")).agg(F.count_distinct("gene").alias("genes"), F.count("*").alias("n"))


@query("D20_joined_sources", f"select s.sirna, w.size, count(*) as n, {q6('avg(ln(s.measure + 1))')} as log_measure, bool_or(s.is_control) as is_control from screen s join wells w using (sirna) where s.sirna not in (select doc_id from qc where not passed) group by s.sirna, w.size having count(*) >= 20", "screen wells qc")
def joined_sources(spark, sf_dir):
    """Measures with the layout, without what failed by either list, from 20 rows on, log-transformed."""
    failed = qc(spark, sf_dir).where(~F.col("passed")).select(F.col("doc_id").alias("sirna"))
    rows = screen(spark, sf_dir).join(failed, "sirna", "left_anti").groupBy("sirna").agg(F.count("*").alias("n"), r6(F.avg(F.ln(F.col("measure") + 1))).alias("log_measure"), F.bool_or("is_control").alias("is_control")).where("n >= 20")
    return rows.join(wells(spark, sf_dir).select("sirna", "size"), "sirna").select("sirna", "size", "n", "log_measure", "is_control")


@query("D22_joined_without_histograms", f"select plate, sirna, gene, {q6('avg(measure)')} as measure from screen where batch in (1994, 1995) and not is_control group by plate, sirna, gene", "screen")
def joined_without_histograms(spark, sf_dir):
    return screen(spark, sf_dir).where(F.col("batch").isin(1994, 1995) & ~F.col("is_control")).groupBy("plate", "sirna", "gene").agg(r6(F.avg("measure")).alias("measure"))


@query("D24_first_experiments", "k as (select sirna, dense_rank() over (order by sirna) as k from (select distinct sirna from screen where not is_control)) select s.sirna, count(*) as n from screen s join k using (sirna) where k <= 30 group by s.sirna", "screen")
def first_experiments(spark, sf_dir):
    """The rows of the first 30 experiments that are no controls."""
    rows = screen(spark, sf_dir)
    first = rows.where(~F.col("is_control")).select("sirna").distinct().orderBy("sirna").limit(30)
    return rows.join(F.broadcast(first), "sirna", "left_semi").groupBy("sirna").agg(F.count("*").alias("n"))


@query("D26_aligned_distances", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k), c as (select distinct condition, condition % 2 = 0 as is_hit from features) select a.condition as hit, b.condition as reference, {q6('sqrt(sum((a.v - b.v) ** 2))')} as d from m a join m b using (k) join c x on x.condition = a.condition and x.is_hit join c y on y.condition = b.condition and not y.is_hit group by 1, 2", "features")
def aligned_distances(spark, sf_dir):
    """Hits (even conditions) against references (odd ones)."""
    d = K.symmetric(K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", X.euclidean))
    return d.where("i % 2 = 0 and j % 2 <> 0").select(F.col("i").alias("hit"), F.col("j").alias("reference"), r6(F.col("d")).alias("d"))


# ---- E: aggregates


@query("E04_highest_density", "n as (select a.label, count(b.label) as n from objects a left join objects b on a.plate = b.plate and a.frame = b.frame and a.label <> b.label and abs(b.x - a.x) <= 8 and abs(b.y - a.y) <= 8 and sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) <= 8 group by a.label) select user_id as track_id, max(n) as density from events join n on label = event_id group by user_id", "objects")
def highest_density(spark, sf_dir):
    from platewise.operators import assignment as A

    rows = objects(spark, sf_dir).select("plate", "frame", "label", "x", "y")
    at = ["plate", "frame", "x", "y"]
    spots = A.places(rows, at[:2])
    near = A.of_places(spots, spots, at[:2], 8.0, carry=["n"]).groupBy(*at).agg((F.sum("to_n") - 1).alias("n"))
    near = rows.join(near, at).select("label", "n")
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("label"))
    return ids.join(near, "label", "left").groupBy("track_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("density"))


@query("E11_proportions_by_block", f"select plate, sirna % 7 as compound, batch, {q6('count(case when is_control then 1 end) / count(*)')} as share from screen group by 1, 2, 3", "screen")
def proportions_by_block(spark, sf_dir):
    return screen(spark, sf_dir).groupBy("plate", (F.col("sirna") % 7).alias("compound"), "batch").agg(r6(F.count_if("is_control") / F.count("*")).alias("share"))


@query("E15_control_ratios", f"c as (select plate, sirna, batch, count(*) as n from screen where is_control group by all) select plate, sirna, {q6('arg_max(n, batch) / arg_min(n, batch)')} as ratio from c group by plate, sirna", "screen")
def control_ratios(spark, sf_dir):
    c = screen(spark, sf_dir).where("is_control").groupBy("plate", "sirna", "batch").agg(F.count("*").alias("n"))
    return c.groupBy("plate", "sirna").agg(r6(F.max_by("n", "batch") / F.min_by("n", "batch")).alias("ratio"))


@query("E16_sampled_controls", f"c as (select distinct sirna from screen where is_control order by {SEEDED('sirna', 5)}, sirna limit 20) select gene, count(*) as n, {q6('avg(measure)')} as measure from screen join c using (sirna) group by gene", "screen")
def sampled_controls(spark, sf_dir):
    rows = screen(spark, sf_dir).where("is_control")
    chosen = samples.first_n(rows.select("sirna").distinct(), "sirna", 20, 5)
    return rows.join(F.broadcast(chosen), "sirna", "left_semi").groupBy("gene").agg(F.count("*").alias("n"), r6(F.avg("measure")).alias("measure"))


@query("E17_cluster_counts", f"select plate, condition, count(*) as n, {q6('100 * count(*) / sum(count(*)) over (partition by plate)')} as percent from features group by plate, condition", "features")
def cluster_counts(spark, sf_dir):
    n = features(spark, sf_dir).groupBy("plate", "condition").agg(F.count("*").alias("n"))
    return n.select("plate", "condition", "n", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy("plate"))).alias("percent"))


CLUSTERS = (0, 1, 2, 3)


@query("E18_cluster_percents", "select plate, " + ", ".join(f"{q6(f'100 * count(case when condition = {c} then 1 end) / count(*)')} as c{c}" for c in CLUSTERS) + " from features group by plate", "features")
def cluster_percents(spark, sf_dir):
    rows = features(spark, sf_dir)
    wide = rows.groupBy("plate").pivot("condition", list(CLUSTERS)).count().fillna(0)
    return wide.join(rows.groupBy("plate").agg(F.count("*").alias("n")), "plate").select("plate", *[r6(100 * F.col(str(c)) / F.col("n")).alias(f"c{c}") for c in CLUSTERS])


@query("E21_padded_counts", "select gene, " + ", ".join(f"count(case when size % 4 = {i} then 1 end) as c{i}" for i in range(4)) + " from wells group by gene", "wells")
def padded_counts(spark, sf_dir):
    """The counts of 0 to 3, also of those that are not there."""
    return wells(spark, sf_dir).groupBy("gene").agg(*[F.count_if(F.col("size") % 4 == i).alias(f"c{i}") for i in range(4)])


@query("E27_segmented_fraction", f"select frame, {q6('avg(case when x > 2 and y > 2 then 1.0 else 0 end)')} as fraction, count(*) as n from objects group by frame", "objects")
def segmented_fraction(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("frame").agg(r6(F.avg(((F.col("x") > 2) & (F.col("y") > 2)).cast("double"))).alias("fraction"), F.count("*").alias("n"))


@query("E28_counts_and_lists", "select plate, frame, count(*) over (partition by plate, frame) as n, row_number() over (partition by plate, frame order by label) as place, label from objects", "objects")
def counts_and_lists(spark, sf_dir):
    """The labels of each frame in order, a row for each, with their number."""
    rows = objects(spark, sf_dir).select("plate", "frame", "label")
    return S.row_numbers(rows, "label", "label", "place", ["plate", "frame"]).select("plate", "frame", F.col("all_rows").alias("n"), "place", "label")


@query("E29_last_class_fraction", f"t as (select max(cls) as last from objects) select plate, label % 24 as well, {q6('count(case when cls = last then 1 end) / count(*)')} as fraction from objects, t group by 1, 2", "objects")
def last_class_fraction(spark, sf_dir):
    rows = objects(spark, sf_dir)
    last = rows.agg(F.max("cls").alias("last"))
    return rows.crossJoin(F.broadcast(last)).groupBy("plate", (F.col("label") % 24).alias("well")).agg(r6(F.count_if(F.col("cls") == F.col("last")) / F.count("*")).alias("fraction"))


@query("E36_first_non_zero", "select plate, arg_min(frame, label) as frame from objects where frame > 0 group by plate", "objects")
def first_non_zero(spark, sf_dir):
    """In storage order, which is that of the labels."""
    return objects(spark, sf_dir).where("frame > 0").groupBy("plate").agg(F.min_by("frame", "label").alias("frame"))


@query("E39_artefact_states", "select case when l.doc_id is null then 'missing' when l.quality is null then 'empty' when l.quality = 1 and l.toxic = 0 then 'done' when l.toxic = 1 then 'flagged' else 'failed' end as state, count(*) as n from documents d left join labels l using (doc_id) group by 1")
def artefact_states(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("quality").isNull(), "empty").when((F.col("quality") == 1) & (F.col("toxic") == 0), "done").when(F.col("toxic") == 1, "flagged").otherwise("failed")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("E41_raw_against_stored", "select parent, count(*) as stored, max(ordinal)::bigint as raw from lineage group by parent having count(*) <> max(ordinal) or count(*) > 6", "lineage")
def raw_against_stored(spark, sf_dir):
    """Movies whose stored images are not as many as the raw ones, or more than six."""
    return lineage(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("stored"), F.max("ordinal").cast("bigint").alias("raw")).where("stored <> raw or stored > 6")


@query("E42_mean_of_movie", f"select plate, frame, {q6('avg(x)')} as mean from objects group by plate, frame", "objects")
def mean_of_movie(spark, sf_dir):
    return _centroids(spark, sf_dir).select("plate", "frame", r6(F.col("x")).alias("mean"))


@query("E43_values_of_movie", "select plate, frame, row_number() over (partition by plate, frame order by round(x)::bigint, label) as place, round(x)::bigint as v from objects where x is not null", "objects")
def values_of_movie(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label", F.round("x").cast("bigint").alias("v"))
    return S.row_numbers(rows, "v", "label", "place", ["plate", "frame"]).select("plate", "frame", "place", "v")


@query("E44_trajectories_of_movie", "select plate, count(distinct track_id) as n from track_points group by plate", "track_points")
def trajectories_of_movie(spark, sf_dir):
    return track_points(spark, sf_dir).select("plate", "track_id").distinct().groupBy("plate").agg(F.count("*").alias("n"))


# ---- F: tracks


@query("F09_prepared_tracks", f"{SPAN}, {STEP}, n as (select track_id, count(*) as n from track_points group by track_id) select s.track_id, count(*) as n_steps, {q6('sum(displacement)')} as total_length from step s join n using (track_id) join code c using (track_id) where n > 11 and end_code <> 3 group by s.track_id", "track_points lineage")
def prepared_tracks(spark, sf_dir):
    """Features of tracks that no merge ends, of more than 11 points."""
    kept = _codes(spark, sf_dir).where("end_code <> 3").select("track_id")
    rows = T.track_features(track_points(spark, sf_dir), least_points=12).join(kept, "track_id", "left_semi")
    return rows.select("track_id", "n_steps", r6(F.col("total_length")).alias("total_length"))


@query("F12_track_records", f"{SPAN}, t as (select track_id, count(*) as n, min(frame) as first, max(frame) as last, arg_min(x, frame) as x0, arg_max(x, frame) as x1 from track_points group by track_id) select t.track_id, n, t.first, t.last, x0, x1, end_code = 3 as fusion, start_code = 2 as mitosis from t join code using (track_id)", "track_points lineage")
def track_records(spark, sf_dir):
    t = track_points(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min_by("x", "frame").alias("x0"), F.max_by("x", "frame").alias("x1"))
    codes = _codes(spark, sf_dir).select("track_id", (F.col("end_code") == 3).alias("fusion"), (F.col("start_code") == 2).alias("mitosis"))
    return t.join(codes, "track_id")


@query("F14_copy_before", "select track_id, frame, x, y from track_points where frame <= 8", "track_points")
def copy_before(spark, sf_dir):
    return track_points(spark, sf_dir).where("frame <= 8").select("track_id", "frame", "x", "y")


@query("F16_tracks_with_object", "select user_id as track_id, count(*) as n from events where user_id in (select user_id from events where event_id % 97 = 5) group by user_id")
def tracks_with_object(spark, sf_dir):
    """Tracks that contain one of the objects asked for."""
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_id % 97 = 5").select("user_id").distinct(), "user_id", "left_semi").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("n"))


@query("F17_tracks_of_cell", "select track_id // 5 as cell, count(distinct track_id) as tracks, count(*) as n from track_points group by 1", "track_points")
def tracks_of_cell(spark, sf_dir):
    return track_points(spark, sf_dir).groupBy(F.floor(F.col("track_id") / PLATES).alias("cell")).agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("n"))


@query("F25_incomplete_mothers", "select parent, min(child) as child from lineage group by parent having count(distinct child) = 1", "lineage")
def incomplete_mothers(spark, sf_dir):
    """Mothers of whose children one alone is known."""
    return lineage(spark, sf_dir).groupBy("parent").agg(F.min("child").alias("child"), F.max("child").alias("other")).where("child = other").select("parent", "child")


@query("F27_series_of_passing_tracks", "s as (select user_id as track_id, count(*) as n, count(case when event_type = 'purchase' then 1 end) as a, count(case when event_type = 'click' then 1 end) as b from events group by user_id) select p.track_id, string_agg(round(x)::bigint::varchar, ',' order by frame) as series from track_points p join s using (track_id) where a >= 1 and b >= 1 and n >= 5 group by p.track_id", "track_points")
def series_of_passing_tracks(spark, sf_dir):
    e = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.count("*").alias("n"), F.count_if(e == "purchase").alias("a"), F.count_if(e == "click").alias("b")).where("a >= 1 and b >= 1 and n >= 5")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", F.round("x").cast("bigint").alias("v")))), lambda v: v["v"].cast("string"))
    return track_points(spark, sf_dir).join(s, "track_id", "left_semi").groupBy("track_id").agg(F.array_join(ordered, ",").alias("series"))


# ---- G, H: rankings and sets


@query("G04_movies_by_difference", f"p as (select x as v from objects where plate = 0), u as (select plate, x as v, 1 as mine from objects where plate <> 0 union all select g.plate, v, 0 from (select distinct plate from objects where plate <> 0) g, p), c as (select plate, v, sum(mine) as a, sum(1 - mine) as b from u group by plate, v), k as (select plate, sum(a) over w as ca, sum(b) over w as cb, sum(a) over z as n1, sum(b) over z as n2 from c window w as (partition by plate order by v rows unbounded preceding), z as (partition by plate)), d as (select plate, max(abs(ca / n1 - cb / n2)) as d from k group by plate), m as (select plate, median(x) as m from objects group by plate) select d.plate, {q6('abs(m.m - (select m from m where plate = 0))')} as median_difference, {q6('d')} as d from d join m using (plate)", "objects")
def movies_by_difference(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "x")
    ks = S.kolmogorov_smirnov(S.against_pool(rows.where("plate <> 0"), rows.where("plate = 0"), ["plate"], "x"), ["plate"])
    m = S.quantiles(rows, ["plate"], "x", {"m": 0.5})
    control = m.where("plate = 0").select(F.col("m").alias("c"))
    return ks.join(m, "plate").crossJoin(F.broadcast(control)).select("plate", r6(F.abs(F.col("m") - F.col("c"))).alias("median_difference"), r6(F.col("d")).alias("d"))


@query("G07_edges_below_percentile", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k), d as (select a.condition as i, b.condition as j, round(sqrt(sum((a.v - b.v) ** 2)), 9) as d from m a join m b on a.k = b.k and a.condition < b.condition group by 1, 2) select i, j, {q6('d')} as d from d where d <= (select quantile_cont(d, 0.1) from d)", "features")
def edges_below_percentile(spark, sf_dir):
    d = K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", X.euclidean).withColumn("d", F.round("d", 9))
    return d.crossJoin(F.broadcast(S.quantiles(d, [], "d", {"t": 0.1}))).where("d <= t").select("i", "j", r6(F.col("d")).alias("d"))


@query("G08_results_by_dose", "select gene, sirna, size as dose, row_number() over (partition by gene order by size, sirna)::int as k from wells", "wells")
def results_by_dose(spark, sf_dir):
    return wells(spark, sf_dir).select("gene", "sirna", F.col("size").alias("dose"), F.row_number().over(W.partitionBy("gene").orderBy("size", "sirna")).alias("k"))


@query("G09_random_positions", f"p as (select distinct sirna // 384 as layout, position from wells) select layout, position from p qualify row_number() over (partition by layout order by {SEEDED('position', 6)}, position) <= 12", "wells")
def random_positions(spark, sf_dir):
    p = wells(spark, sf_dir).select(F.floor(F.col("sirna") / 384).alias("layout"), "position").distinct()
    return samples.first_n_of(p, "layout", "position", 12, 6)


@query("G10_random_positions_without_controls", f"g as (select unnest(range(1, 385)) as position), p as (select position from g where position not in (15, 26, 63, 99, 200)) select position from p order by {SEEDED('position', 8)}, position limit 40 + 0 * (select count(*) from wells)", "wells")
def random_positions_without_controls(spark, sf_dir):
    rows = wells(spark, sf_dir).agg(F.max("position")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(384).cast("bigint"))).alias("position"))
    return samples.first_n(rows.where(~F.col("position").isin(15, 26, 63, 99, 200)), "position", 40, 8)


def _shuffled(spark, sf_dir, seed):
    """plate, sirna, order: the controls of each plate with their place in a seeded order."""
    return stored(screen(spark, sf_dir).where("is_control").select("plate", "sirna").distinct().withColumn("order", samples.order("sirna", seed)), "shuffled")


@query("G11_separated_controls", f"c as (select distinct plate, sirna from screen where is_control) select plate, sirna, case when row_number() over (partition by plate order by {SEEDED('sirna', 11)}, sirna) <= 6 then 'reference' else 'experiment' end as role from c", "screen")
def separated_controls(spark, sf_dir):
    """The first six of a plate's shuffled controls are the reference, the rest stand for experiments."""
    shuffled = S.row_numbers(_shuffled(spark, sf_dir, 11), "order", "sirna", "k", ["plate"])
    return shuffled.select("plate", "sirna", F.when(F.col("k") <= 6, "reference").otherwise("experiment").alias("role"))


@query("G12_permuted_controls", f"c as (select distinct plate, sirna from screen where is_control) select plate, sirna, row_number() over (partition by plate order by {SEEDED('sirna', 12)}, sirna)::int as place from c", "screen")
def permuted_controls(spark, sf_dir):
    return S.row_numbers(_shuffled(spark, sf_dir, 12), "order", "sirna", "place", ["plate"]).select("plate", "sirna", F.col("place").cast("int").alias("place"))


@query("H01_labels_by_arity", "c as (select parent, count(*) as arity from lineage group by parent), u as (select parent as label, arity from c union select child, 1 from lineage union select -1, 0) select arity, count(*) as n from u where label <> -1 group by arity", "lineage")
def labels_by_arity(spark, sf_dir):
    """Labels added to the sets of their arity; the label -1 stands for nothing and is left out."""
    edges = lineage(spark, sf_dir)
    c = edges.groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("arity"))
    return c.union(edges.select("child", F.lit(1).cast("bigint"))).distinct().where("label <> -1").groupBy("arity").agg(F.count("*").alias("n"))


@query("H02_union_by_plate", "a as (select plate, label, 1 as lot from objects), b as (select plate, label, 2 as lot from objects where frame >= 12 and plate % 2 = 1) select plate, lot, count(*) as n from (select * from b union all select * from a where plate not in (select plate from b)) group by all", "objects")
def union_by_plate(spark, sf_dir):
    """The lot of all plates, and a second lot of odd plates from frame 12 on, which takes the first one's place there."""
    rows = objects(spark, sf_dir).select("plate", "label", "frame")
    old, new = rows.withColumn("lot", F.lit(1)), rows.where("frame >= 12 and plate % 2 = 1").withColumn("lot", F.lit(2))
    return C.union_right_wins(old, new, ["plate"]).groupBy("plate", "lot").agg(F.count("*").alias("n"))


@query("H03_distinct_sirnas", "select distinct sirna from screen where measure > 60000", "screen")
def distinct_sirnas(spark, sf_dir):
    return screen(spark, sf_dir).where("measure > 60000").select("sirna").distinct()


@query("H06_positions_of_sirnas", "select distinct position from wells where sirna in (select sirna from screen where measure > 90000)", "screen wells")
def positions_of_sirnas(spark, sf_dir):
    return wells(spark, sf_dir).join(screen(spark, sf_dir).where("measure > 90000").select("sirna"), "sirna", "left_semi").select("position").distinct()


# ---- I: geometry and small functions


@query("I01_centre_distances", f"{CENTROIDS}, c as (select plate, avg(x) as x, avg(y) as y from m group by plate) select a.plate as i, b.plate as j, {q6('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} as d from c a join c b on a.plate < b.plate", "objects")
def centre_distances(spark, sf_dir):
    c = _centroids(spark, sf_dir).groupBy("plate").agg(F.array(F.avg("x"), F.avg("y")).alias("c"))
    return K.pair_table(c, "plate", "c", X.euclidean).select("i", "j", r6(F.col("d")).alias("d"))


@query("I04_angles_of_moving_steps", f"{STEP} select track_id, frame, {q6('turning')} as angle from step where turning is not null", "track_points")
def angles_of_moving_steps(spark, sf_dir):
    """Without a guard against steps of length 0: those have no angle and no row."""
    return T.steps(track_points(spark, sf_dir)).where("turning is not null").select("track_id", "frame", r6(F.col("turning")).alias("angle"))


@query("I05_hull_areas")
def hull_areas(spark, sf_dir):
    return T.shape_features(track_points(spark, sf_dir), 100.0).select("plate", "track_id", r6(F.col("hull_area")).alias("hull_area"))


@query("I06_ball_covers")
def ball_covers(spark, sf_dir):
    return T.shape_features(track_points(spark, sf_dir), 100.0).select("plate", "track_id", "balls", r6(F.col("ball_entropy")).alias("ball_entropy"))


@query("I08_affinities", f"u as (select condition, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select condition, k, avg(v) as v from u group by condition, k) select a.condition as i, b.condition as j, {q6('exp(-0.5 * sum((a.v - b.v) ** 2))')} as w from m a join m b on a.k = b.k and a.condition < b.condition group by 1, 2", "features")
def affinities(spark, sf_dir):
    return K.pair_table(L.mean_vectors(features(spark, sf_dir), ["condition"]), "condition", "f", lambda a, b: X.rbf(a, b, 0.5)).select("i", "j", r6(F.col("d")).alias("w"))


@query("I10_log_transform_from_minimum", f"select label, {q6('ln(x + 1 - min(x) over (partition by cls))')} as v from objects", "objects")
def log_transform_from_minimum(spark, sf_dir):
    rows = objects(spark, sf_dir)
    low = rows.groupBy("cls").agg(F.min("x").alias("low"))
    return rows.join(F.broadcast(low), "cls").select("label", r6(F.ln(F.col("x") + 1 - F.col("low"))).alias("v"))


@query("I11_sigmoid", f"select label, {q6('1 / (1 + exp(-0.05 * (x - 100)))')} as v from objects", "objects")
def sigmoid(spark, sf_dir):
    return objects(spark, sf_dir).select("label", r6(X.sigmoid(F.col("x") - 100, 0.05)).alias("v"))


@query("I12_radians", f"select label, {q6('radians(x)')} as v from objects", "objects")
def radians(spark, sf_dir):
    return objects(spark, sf_dir).select("label", r6(F.radians("x")).alias("v"))


@query("I14_coordinates_of_position", "select distinct position, ((position - 1) % 12)::bigint as x, ((position - 1) // 12)::bigint as y from wells", "wells")
def coordinates_of_position(spark, sf_dir):
    p = F.col("position") - 1
    return wells(spark, sf_dir).select("position", (p % WIDTH).alias("x"), F.floor(p / WIDTH).alias("y")).distinct()


@query("I16_vector_distances", f"u as (select exp, plate, generate_subscripts(f, 1) as k, unnest(f) as v from features), m as (select k, avg(v) as m from u where plate = 0 group by k) select exp, {q6('sqrt(sum((v - m) ** 2))')} as d, {q6('sum((v - m) ** 2)')} as squared, {q6('sqrt(sum(v ** 2))')} as norm from u join m using (k) group by exp", "features")
def vector_distances(spark, sf_dir):
    """Each vector against the control plate's mean."""
    rows = features(spark, sf_dir)
    mean = L.mean_vectors(rows.where("plate = 0"), ["plate"]).select(F.col("f").alias("m"))
    d = X.euclidean(F.col("f"), F.col("m"))
    return rows.crossJoin(F.broadcast(mean)).select("exp", r6(d).alias("d"), r6(d * d).alias("squared"), r6(F.sqrt(X.dot(F.col("f"), F.col("f")))).alias("norm"))
