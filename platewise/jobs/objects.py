"""Object-table queries: scans, sinks' tables, cleaning, aggregates (letters A, B, C and E of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.model import features, lineage, objects, q6, qc, query, r6, screen, table, track_points, wells
from platewise.operators import clean as C
from platewise.operators import statistics as S
from platewise.operators import tracks as T
from platewise.sources import stored

SKIPPED = "(select distinct frame from objects where frame % 7 = 3)"


@query("A01_objects_renumbered", f"s as {SKIPPED} select plate, frame - (select count(*) from s where s.frame < o.frame)::int as frame, label, x, y from objects o where frame not in (select frame from s)", "objects")
def objects_renumbered(spark, sf_dir):
    rows = objects(spark, sf_dir)
    return C.without_frames(rows, rows.where("frame % 7 = 3").select("frame").distinct()).select("plate", "frame", "label", "x", "y")


@query("A02_targeted_scan", "select label, x, cls from objects where cls in ('click', 'view')", "objects")
def targeted_scan(spark, sf_dir):
    return objects(spark, sf_dir).where(F.col("cls").isin("click", "view")).select("label", "x", "cls")


@query("A04_class_dictionary", "select cls, dense_rank() over (order by cls)::int as idx from (select distinct cls from objects)", "objects")
def class_dictionary(spark, sf_dir):
    return objects(spark, sf_dir).select("cls").distinct().select("cls", F.dense_rank().over(W.orderBy("cls")).alias("idx"))


@query("A06_union_right_wins", "a as (select plate, frame, label, 'old' as lot from objects where frame < 20), b as (select plate, frame, label, 'new' as lot from objects where frame >= 10) select * from b union all select * from a where not exists (select 1 from b where b.plate = a.plate and b.frame = a.frame)", "objects")
def union_right_wins(spark, sf_dir):
    rows = objects(spark, sf_dir).select("plate", "frame", "label")
    return C.union_right_wins(rows.where("frame < 20").withColumn("lot", F.lit("old")), rows.where("frame >= 10").withColumn("lot", F.lit("new")), ["plate", "frame"])


@query("A12_index_ranges", "select plate, min(label) as first, max(label) as last, count(*) as n from objects group by plate", "objects")
def index_ranges(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("n"))


@query("A13_splits_and_merges", "select 'split' as event, parent as id, count(*) as n from lineage group by parent having count(*) > 1 union all select 'merge', child, count(distinct parent) from lineage group by child having count(distinct parent) > 1", "lineage")
def splits_and_merges(spark, sf_dir):
    edges = lineage(spark, sf_dir)
    splits = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n")).select(F.lit("split").alias("event"), "id", "n")
    merges = edges.select("parent", "child").distinct().groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n")).select(F.lit("merge").alias("event"), "id", "n")
    return splits.where("n > 1").union(merges.where("n > 1"))


CLASSES = ("click", "purchase", "view")
SHARES = ", ".join(f"{q6(f'count(case when cls = {c!r} then 1 end) / count(*)')} as {c}" for c in CLASSES)


@query("A14_class_proportions", f"select plate, frame, {SHARES} from objects group by plate, frame", "objects")
def class_proportions(spark, sf_dir):
    return C.class_shares(objects(spark, sf_dir), ["plate", "frame"], CLASSES)


@query("A18_layout_with_defaults", "d as (select sirna // 384 as layout, position, gene, size from wells), l as (select distinct layout from d) select l.layout::bigint as layout, p.position, coalesce(d.gene, 'none') as gene, coalesce(d.size, 0) as size from l cross join (select unnest(range(1, 385)) as position) p left join d on d.layout = l.layout and d.position = p.position", "wells")
def layout_with_defaults(spark, sf_dir):
    """A plate number beside the position: every plate has all its positions, with defaults where the library has no siRNA."""
    rows = wells(spark, sf_dir).select(F.floor(F.col("sirna") / 384).alias("layout"), "position", "gene", "size")
    grid = rows.select("layout").distinct().withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(384).cast("bigint"))))
    return grid.join(rows, ["layout", "position"], "left").select("layout", "position", F.coalesce("gene", F.lit("none")).alias("gene"), F.coalesce("size", F.lit(0)).alias("size"))


@query("A19_dose_parsing", """t as (select sirna, (size % 10)::varchar || ',5 ' || (case size % 3 when 0 then 'uM' when 1 then 'nM' else 'mg' end) as dose from wells)
select sirna, dose, (round(replace(regexp_extract(dose, '^([0-9,]+)', 1), ',', '.')::double * case regexp_extract(dose, '([a-zA-Z]+)$', 1) when 'uM' then 1e-6 when 'nM' then 1e-9 when 'pM' then 1e-12 else 0 end, 12) + 0.0) as molar from t""", "wells")
def dose_parsing(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("uM"), F.lit("nM"), F.lit("mg")), (F.col("size") % 3 + 1).cast("int"))
    rows = wells(spark, sf_dir).select("sirna", F.concat((F.col("size") % 10).cast("string"), F.lit(",5 "), unit).alias("dose"))
    return rows.select("sirna", "dose", F.round(C.molar(F.col("dose")), 12).alias("molar"))


@query("A20_wells_of_compound", "select gene, size, count(*) as n, string_agg(position::varchar, ',' order by position, sirna) as positions from wells where size > 10 group by gene, size", "wells")
def wells_of_compound(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "sirna"))), lambda s: s["position"].cast("string"))
    return wells(spark, sf_dir).where("size > 10").groupBy("gene", "size").agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("positions"))


@query("B01_track_edges", "select track_id, frame, lead(frame) over w as next_frame, lead(x) over w as next_x from track_points window w as (partition by track_id order by frame) qualify lead(frame) over w is not null", "track_points")
def track_edges(spark, sf_dir):
    at = W.partitionBy("track_id").orderBy("frame")
    return track_points(spark, sf_dir).select("track_id", "frame", F.lead("frame").over(at).alias("next_frame"), F.lead("x").over(at).alias("next_x")).where("next_frame is not null")


@query("B02_first_and_last_object", "select track_id, arg_min(x, frame) as first_x, arg_max(x, frame) as last_x, max(frame) as last_frame from track_points group by track_id", "track_points")
def first_and_last_object(spark, sf_dir):
    return track_points(spark, sf_dir).groupBy("track_id").agg(F.min_by("x", "frame").alias("first_x"), F.max_by("x", "frame").alias("last_x"), F.max("frame").alias("last_frame"))


@query("B07_ranking_table", f"m as (select gene, median(measure) as score from screen group by gene) select gene as name, row_number() over (order by score desc, gene)::int as rank, {q6('score')} as score from m", "screen")
def ranking_table(spark, sf_dir):
    rows = screen(spark, sf_dir).groupBy("gene").agg(F.percentile("measure", 0.5).alias("score"))
    return rows.select(F.col("gene").alias("name"), F.row_number().over(W.orderBy(F.desc("score"), "gene")).alias("rank"), r6(F.col("score")).alias("score"))


@query("C01_feature_nulls", "select plate, count(*) as n, count(*) - count(f[1]) as null_first, sum(len(list_filter(f, lambda v: v is null)))::bigint as n_null, count(case when len(list_filter(f, lambda v: v < -1)) > 0 then 1 end) as n_low from features group by plate", "features")
def feature_nulls(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rows.groupBy("plate").agg(F.count("*").alias("n"), F.count_if(F.get("f", F.lit(0)).isNull()).alias("null_first"), F.sum(F.size(F.filter("f", lambda v: v.isNull()))).alias("n_null"), F.count_if(F.exists("f", lambda v: v < -1)).alias("n_low"))


@query("C05_min_max", f"u as (select plate, generate_subscripts(f, 1) - 1 as i, unnest(f) as v from features) select i::int as i, {q6('min(v)')} as low, {q6('max(v)')} as high from u group by i", "features")
def min_max(spark, sf_dir):
    return C.long_features(features(spark, sf_dir), []).groupBy("i").agg(r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"))


@query("C06_z_scores_by_controls", f"u as (select exp, is_control, generate_subscripts(f, 1) - 1 as i, unnest(f) as v from features), s as (select i, avg(v) as m, stddev_pop(v) as s from u where is_control group by i) select exp, i::int as i, {q6('(v - m) / nullif(s, 0)')} as z from u join s using (i)", "features")
def z_scores_by_controls(spark, sf_dir):
    return C.z_scores(C.long_features(features(spark, sf_dir), ["exp", "is_control"]), ["i"], "v", F.col("is_control")).select("exp", "i", r6(F.col("z")).alias("z"))


@query("C07_min_max_scaling", f"select plate, frame, label, {q6('2 * (x - min(x) over w) / (max(x) over w - min(x) over w + 1e-7) - 1')} as scaled from objects window w as (partition by cls)", "objects")
def min_max_scaling(spark, sf_dir):
    rows = objects(spark, sf_dir)
    bounds = rows.groupBy("cls").agg(F.min("x").alias("low"), F.max("x").alias("high"))  # one row a class, not a window over all rows of a class
    return rows.join(F.broadcast(bounds), "cls").select("plate", "frame", "label", r6(2 * (F.col("x") - F.col("low")) / (F.col("high") - F.col("low") + 1e-7) - 1).alias("scaled"))


@query("C10_usable_experiments", "select source, count(*) as n, count(case when passed then 1 end) as n_passed from qc group by source having count(case when passed then 1 end) >= 5", "qc")
def usable_experiments(spark, sf_dir):
    return qc(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed")).where("n_passed >= 5")


@query("C13_count_quality_control", f"""c as (select plate, frame, count(*) as n, count(case when cls = 'error' then 1 end) / count(*) as blurred from objects group by plate, frame), b as (select plate, min(frame) as first, max(frame) as last from c group by plate)
select plate, {q6("avg(case when frame < first + 10 then n end)")} as initial, {q6("avg(case when frame > last - 10 then blurred end)")} as blurred, avg(case when frame < first + 10 then n end) < 60 or avg(case when frame > last - 10 then blurred end) > 0.21 as failed from c join b using (plate) group by plate""", "objects")
def count_quality_control(spark, sf_dir):
    return C.count_qc(objects(spark, sf_dir), "error", 60, 0.21).select("plate", r6(F.col("initial")).alias("initial"), r6(F.col("blurred")).alias("blurred"), "failed")


@query("C14_intensity_outliers", f"""m as (select plate, frame, avg(x) as v from objects group by plate, frame), f as (select plate, frame, v, avg(v) over (partition by plate order by frame rows between current row and 9 following) as smooth, stddev_pop(v) over (partition by plate) as s from m)
select plate, frame, {q6("v")} as v, {q6("smooth")} as smooth, abs(v - smooth) > 2 * s as outlier from f""", "objects")
def intensity_outliers(spark, sf_dir):
    mean = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.avg("x").alias("v"))
    spread = F.stddev_pop("v").over(W.partitionBy("plate"))
    rows = mean.withColumns({"smooth": T.forward_mean(mean, ["plate"], "frame", "v", 10), "s": spread})
    return rows.select("plate", "frame", r6(F.col("v")).alias("v"), r6(F.col("smooth")).alias("smooth"), (F.abs(F.col("v") - F.col("smooth")) > 2 * F.col("s")).alias("outlier"))


@query("C16_wells_without_failures", "select doc_id, source from qc where doc_id not in (select doc_id from qc where not passed) and source not in (select source from qc group by source having count(case when not passed then 1 end) > count(*) * 0.3)", "qc")
def wells_without_failures(spark, sf_dir):
    rows = qc(spark, sf_dir)
    bad = rows.groupBy("source").agg((F.count_if(~F.col("passed")) > F.count("*") * 0.3).alias("bad")).where("bad").select("source")
    return rows.join(rows.where(~F.col("passed")).select("doc_id"), "doc_id", "left_anti").join(bad, "source", "left_anti").select("doc_id", "source")


@query("E01_links_by_arity", "c as (select parent, count(*) as arity from lineage group by parent) select arity, count(*) as events, sum(arity)::bigint as links from c group by arity", "lineage")
def links_by_arity(spark, sf_dir):
    return lineage(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("arity")).groupBy("arity").agg(F.count("*").alias("events"), F.sum("arity").alias("links"))


@query("E02_rollup_counts", "select plate, cls, count(*) as n from objects group by rollup (plate, cls)", "objects")
def rollup_counts(spark, sf_dir):
    return objects(spark, sf_dir).rollup("plate", "cls").agg(F.count("*").alias("n"))


@query("E03_centroids", f"select plate, frame, {q6('avg(x)')} as x, {q6('avg(y)')} as y from objects group by plate, frame", "objects")
def centroids(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate", "frame").agg(r6(F.avg("x")).alias("x"), r6(F.avg("y")).alias("y"))


@query("E05_well_summary", f"""c as (select plate, frame, count(*) as n, count(*) - count(case when cls = 'error' then 1 end) as cells, count(case when cls = 'purchase' then 1 end) as dead from objects group by plate, frame)
select plate, arg_min(cells, frame) as initial, arg_max(cells, frame) as final, {q6("arg_max(cells, frame) / (arg_min(cells, frame) + 1e-4)")} as proliferation, {q6("sum(dead) / (sum(cells) + 1e-4)")} as death from c group by plate""", "objects")
def well_summary(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("plate", "frame").agg((F.count("*") - F.count_if(F.col("cls") == "error")).alias("cells"), F.count_if(F.col("cls") == "purchase").alias("dead"))
    first, last = F.min_by("cells", "frame"), F.max_by("cells", "frame")
    return c.groupBy("plate").agg(first.alias("initial"), last.alias("final"), r6(last / (first + 1e-4)).alias("proliferation"), r6(F.sum("dead") / (F.sum("cells") + 1e-4)).alias("death"))


@query("E08_class_counts_per_frame", "select plate, frame, count(case when cls in ('click', 'view') then 1 end) as light, count(case when cls = 'purchase' then 1 end) as purchase, count(case when cls not in ('click', 'view', 'purchase') then 1 end) as rest from objects group by plate, frame", "objects")
def class_counts_per_frame(spark, sf_dir):
    kind = F.when(F.col("cls").isin("click", "view"), "light").when(F.col("cls") == "purchase", "purchase").otherwise("rest")
    rows = objects(spark, sf_dir).select("plate", "frame", kind.alias("kind")).groupBy("plate", "frame").pivot("kind", ["light", "purchase", "rest"]).count()
    return rows.fillna(0, ["light", "purchase", "rest"])


@query("E10_time_aggregated_proportions", f"select plate, (frame // 6)::bigint as block, cls, {q6('count(*) / sum(count(*)) over (partition by plate, frame // 6)')} as share from objects group by plate, frame // 6, cls", "objects")
def time_aggregated_proportions(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", F.floor(F.col("frame") / 6).alias("block"), "cls").agg(F.count("*").alias("n"))
    return n.select("plate", "block", "cls", r6(F.col("n") / F.sum("n").over(W.partitionBy("plate", "block"))).alias("share"))


@query("E13_weighted_fraction", f"c as (select plate, frame, count(*) as n, count(case when cls = 'view' then 1 end) / count(*) as f from objects group by plate, frame) select plate, {q6('sum(f * n) / sum(n)')} as fraction from c group by plate", "objects")
def weighted_fraction(spark, sf_dir):
    c = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.count("*").alias("n"), (F.count_if(F.col("cls") == "view") / F.count("*")).alias("f"))
    return c.groupBy("plate").agg(r6(F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("fraction"))


@query("E19_label_counts_grouping_sets", "select plate, condition, count(*) as n from features group by grouping sets ((plate), (condition), (plate, condition), ())", "features")
def label_counts_grouping_sets(spark, sf_dir):
    return features(spark, sf_dir).cube("plate", "condition").agg(F.count("*").alias("n"))


@query("E23_quadrants", f"""m as (select sirna, avg(measure) as m, median(measure) as d from screen group by sirna), t as (select quantile_cont(m, 0.1) as ml, quantile_cont(m, 0.9) as mh, quantile_cont(d, 0.1) as dl, quantile_cont(d, 0.9) as dh from m)
select sirna, {q6("d")} as median, case when m <= ml and d <= dl then 'low-low' when m >= mh and d >= dh then 'high-high' when m <= ml and d >= dh then 'low-high' when m >= mh and d <= dl then 'high-low' else 'middle' end as quadrant from m, t""", "screen")
def quadrants(spark, sf_dir):
    rows = screen(spark, sf_dir)
    m = stored(rows.groupBy("sirna").agg(F.avg("measure").alias("m")).join(S.quantiles(rows, ["sirna"], "measure", {"d": 0.5}), "sirna"), "means")
    low, high = (S.quantiles(m, [], c, {f"{c}l": 0.1, f"{c}h": 0.9}) for c in "md")
    t = low.crossJoin(F.broadcast(high))  # one row
    kind = F.when(F.expr("m <= ml and d <= dl"), "low-low").when(F.expr("m >= mh and d >= dh"), "high-high").when(F.expr("m <= ml and d >= dh"), "low-high").when(F.expr("m >= mh and d <= dl"), "high-low").otherwise("middle")
    return m.crossJoin(F.broadcast(t)).select("sirna", r6(F.col("d")).alias("median"), kind.alias("quadrant"))


@query("E24_blank_corrected_intensity", f"m as (select plate, frame, avg(x) as v from objects group by plate, frame) select m.plate, m.frame, {q6('m.v - b.v')} as corrected from m join m b on b.plate = 0 and b.frame = m.frame where m.plate <> 0", "objects")
def blank_corrected_intensity(spark, sf_dir):
    m = objects(spark, sf_dir).groupBy("plate", "frame").agg(F.avg("x").alias("v"))
    blank = m.where("plate = 0").select("frame", F.col("v").alias("b"))
    return m.where("plate <> 0").join(blank, "frame").select("plate", "frame", r6(F.col("v") - F.col("b")).alias("corrected"))


@query("E33_replicate_combiner", f"r as (select sirna, batch, max(measure) as v from screen group by sirna, batch), s as (select sirna, list_sort(list(v)) as a from r group by sirna) select sirna, len(a)::bigint as n, {q6('case when len(a) < 2 then 0 when len(a) = 2 then a[1] else a[len(a) // 2 + 1] end')} as v from s", "screen")
def replicate_combiner(spark, sf_dir):
    r = screen(spark, sf_dir).groupBy("sirna", "batch").agg(F.max("measure").alias("v")).groupBy("sirna").agg(F.array_sort(F.collect_list("v")).alias("a"))
    v = F.when(F.size("a") < 2, 0.0).when(F.size("a") == 2, F.get("a", F.lit(0))).otherwise(F.get("a", F.floor(F.size("a") / 2).cast("int")))
    return r.select("sirna", F.size("a").cast("bigint").alias("n"), r6(v).alias("v"))


@query("E38_missing_artefacts", "select 'no label' as kind, count(*) as n from documents where doc_id not in (select doc_id from labels) union all select 'no quality', count(*) from labels where quality = 0 union all select 'no document', count(*) from labels where doc_id not in (select doc_id from documents)")
def missing_artefacts(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    kinds = {"no label": docs.join(labels, "doc_id", "left_anti"), "no quality": labels.where("quality = 0"), "no document": labels.join(docs, "doc_id", "left_anti")}
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("E34_multiset_difference", "select x::int as x from (select floor(x) as x from objects where frame < 15) except all select floor(x)::int from objects where frame >= 15", "objects")
def multiset_difference(spark, sf_dir):
    rows = objects(spark, sf_dir).select(F.floor("x").cast("int").alias("x"), "frame")
    return rows.where("frame < 15").select("x").exceptAll(rows.where("frame >= 15").select("x"))


# ---- further scans, tables for sinks, predicates and counts


@query("A05_feature_dictionary", "select distinct generate_subscripts(f, 1)::int - 1 as i, 'f' || (generate_subscripts(f, 1) - 1)::varchar as name from features", "features")
def feature_dictionary(spark, sf_dir):
    return features(spark, sf_dir).agg(F.max(F.size("f")).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("i", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"))


@query("A22_plate_class_proportions", f"select plate, {SHARES} from objects group by plate", "objects")
def plate_class_proportions(spark, sf_dir):
    return C.class_shares(objects(spark, sf_dir), ["plate"], CLASSES)


@query("B03_lineage_edges", "select a.parent, a.child as from_child, b.child as to_child from lineage a join lineage b on a.parent = b.parent and a.ordinal = 1 and b.ordinal > 1", "lineage")
def lineage_edges(spark, sf_dir):
    first = lineage(spark, sf_dir).where("ordinal = 1").select("parent", F.col("child").alias("from_child"))
    return first.join(lineage(spark, sf_dir).where("ordinal > 1").select("parent", F.col("child").alias("to_child")), "parent")


@query("B06_ragged_lists", "r as (select sirna, size % 3 as list, row_number() over (partition by size % 3 order by sirna)::int as line from wells) select line, max(case when list = 0 then sirna end) as list0, max(case when list = 1 then sirna end) as list1, max(case when list = 2 then sirna end) as list2 from r group by line", "wells")
def ragged_lists(spark, sf_dir):
    line = F.row_number().over(W.partitionBy(F.col("size") % 3).orderBy("sirna"))
    rows = wells(spark, sf_dir).select("sirna", (F.col("size") % 3).alias("list"), line.alias("line"))
    return rows.groupBy("line").pivot("list", [0, 1, 2]).agg(F.max("sirna")).toDF("line", "list0", "list1", "list2")


@query("B09_quality_table", "select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic, case when l.doc_id is null then 'unknown' when l.quality = 1 and l.toxic = 0 then 'passed' else 'failed' end as status from documents d left join labels l using (doc_id)")
def quality_table(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unknown").when((F.col("quality") == 1) & (F.col("toxic") == 0), "passed").otherwise("failed")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), status.alias("status"))


@query("B12_densest_box", "select floor(x / 50)::bigint as bx, floor(y / 50)::bigint as by_, count(*) as n from objects group by 1, 2 order by n desc, 1, 2 limit 1", "objects")
def densest_box(spark, sf_dir):
    return objects(spark, sf_dir).groupBy(F.floor(F.col("x") / 50).alias("bx"), F.floor(F.col("y") / 50).alias("by_")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bx", "by_").limit(1)


@query("C03_zeroed_columns", "select exp, list_transform(f[1:4], lambda v, i: case when i in (2, 4) then 0.0 else round(v, 6) + 0.0 end)[1] as f0, 0.0::double as f1 from features", "features")
def zeroed_columns(spark, sf_dir):
    zeroed = F.transform("f", lambda v, i: F.when(i.isin(1, 3), 0.0).otherwise(F.round(v, 6)))
    return features(spark, sf_dir).select("exp", zeroed[0].alias("f0"), zeroed[1].alias("f1"))


@query("C09_corrected_missing", f"r as (select sirna, plate, case when batch > 1996 then null else measure end as movement, batch - 1991 as density from screen) select plate, count(*) as n, count(movement) as n_movement, {q6('avg(movement)')} as movement from r where density < 5 group by plate", "screen")
def corrected_missing(spark, sf_dir):
    rows = screen(spark, sf_dir).select("plate", F.when(F.col("batch") <= 1996, F.col("measure")).alias("movement"), (F.col("batch") - 1991).alias("density"))
    return rows.where("density < 5").groupBy("plate").agg(F.count("*").alias("n"), F.count("movement").alias("n_movement"), r6(F.avg("movement")).alias("movement"))


@query("C11_control_wells", "select sirna, position, case when sirna % 5 < 2 then position in (15, 26, 63, 74, 304, 315, 352) else position in (1, 49, 97, 145, 193, 241, 289, 337) end as is_control from wells", "wells")
def control_wells(spark, sf_dir):
    a, b = F.col("position").isin(15, 26, 63, 74, 304, 315, 352), F.col("position").isin(1, 49, 97, 145, 193, 241, 289, 337)
    return wells(spark, sf_dir).select("sirna", "position", F.when(F.col("sirna") % 5 < 2, a).otherwise(b).alias("is_control"))


@query("C21_full_plate_minus_failures", "select position from (select unnest(range(1, 385)) as position) where position not in (select position from wells where size < 5)", "wells")
def full_plate_minus_failures(spark, sf_dir):
    return spark.range(1, 385).withColumnRenamed("id", "position").join(wells(spark, sf_dir).where("size < 5").select("position"), "position", "left_anti")


@query("C23_small_events", "select parent, count(*) as n from lineage group by parent having count(*) <= 4", "lineage")
def small_events(spark, sf_dir):
    return lineage(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("n")).where("n <= 4")


@query("C24_fold_members", "select plate, frame, count(*) as n from objects where (plate, frame) in (select plate, frame from objects where label % 97 = 3) group by plate, frame", "objects")
def fold_members(spark, sf_dir):
    rows = objects(spark, sf_dir)
    return rows.join(rows.where("label % 97 = 3").select("plate", "frame").distinct(), ["plate", "frame"], "left_semi").groupBy("plate", "frame").agg(F.count("*").alias("n"))


@query("D09_points_with_class", "select t.track_id, string_agg(coalesce(substr(e.event_type, 1, 1), '?'), '' order by t.frame) as classes from track_points t left join (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events) e on e.user_id = t.track_id and e.frame = t.frame and e.event_type <> 'error' group by t.track_id", "track_points")
def points_with_class(spark, sf_dir):
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    cls = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), frame.alias("frame"), F.substring("event_type", 1, 1).alias("c"), "event_type").where("event_type <> 'error'")
    rows = track_points(spark, sf_dir).join(cls, ["track_id", "frame"], "left").select("track_id", "frame", F.coalesce("c", F.lit("?")).alias("c"))
    return rows.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "c"))), lambda s: s["c"]), "").alias("classes"))


@query("E06_bin_fraction", f"select plate, frame, {q6('count(case when x >= 20 and x < 40 then 1 end) / count(*)')} as fraction from objects group by plate, frame", "objects")
def bin_fraction(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate", "frame").agg(r6(F.count_if((F.col("x") >= 20) & (F.col("x") < 40)) / F.count("*")).alias("fraction"))


@query("E07_channel_ratio", f"select label, {q6('x / (y + 1e-5)')} as ratio from objects", "objects")
def channel_ratio(spark, sf_dir):
    return objects(spark, sf_dir).select("label", r6(F.col("x") / (F.col("y") + 1e-5)).alias("ratio"))


@query("E09_time_aggregated_counts", "select plate, cls, count(*) as n from objects group by plate, cls", "objects")
def time_aggregated_counts(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate", "cls").agg(F.count("*").alias("n"))


@query("E14_fraction_at_frame", f"select plate, {q6(chr(39).join(['count(case when cls = ', 'view', ' then 1 end) / count(*)']))} as fraction from objects where frame = 0 group by plate", "objects")
def fraction_at_frame(spark, sf_dir):
    return objects(spark, sf_dir).where("frame = 0").groupBy("plate").agg(r6(F.count_if(F.col("cls") == "view") / F.count("*")).alias("fraction"))


@query("E20_integer_percent", "select plate, cls, (100 * count(*) // sum(count(*)) over (partition by plate))::int as percent from objects group by plate, cls", "objects")
def integer_percent(spark, sf_dir):
    n = objects(spark, sf_dir).groupBy("plate", "cls").agg(F.count("*").alias("n"))
    return n.select("plate", "cls", F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy("plate"))).cast("int").alias("percent"))


@query("E25_tracks_per_plate", "select plate, count(distinct track_id) as n from track_points group by plate", "track_points")
def tracks_per_plate(spark, sf_dir):
    return track_points(spark, sf_dir).groupBy("plate").agg(F.count_distinct("track_id").alias("n"))


@query("E30_event_counts", "c as (select parent, count(*) as k from lineage group by parent) select case when k = 1 then 'move' when k in (2, 3) then 'split' else 'other' end as event, count(*) as events, sum(k)::bigint as links from c group by 1", "lineage")
def event_counts(spark, sf_dir):
    c = lineage(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("k"))
    event = F.when(F.col("k") == 1, "move").when(F.col("k").isin(2, 3), "split").otherwise("other")
    return c.groupBy(event.alias("event")).agg(F.count("*").alias("events"), F.sum("k").alias("links"))


@query("E31_hits_per_position", "select case when sirna % 5 < 2 then 'druggable' else 'genome' end as config, position, count(*) as n from wells where size > 40 group by 1, 2", "wells")
def hits_per_position(spark, sf_dir):
    return wells(spark, sf_dir).where("size > 40").groupBy(F.when(F.col("sirna") % 5 < 2, "druggable").otherwise("genome").alias("config"), "position").agg(F.count("*").alias("n"))


@query("E32_values_by_position", f"select position, count(*) as n, {q6('avg(size)')} as mean, {q6('median(size)')} as median, {q6('stddev_pop(size)')} as spread from wells group by position", "wells")
def values_by_position(spark, sf_dir):
    return wells(spark, sf_dir).groupBy("position").agg(F.count("*").alias("n"), r6(F.avg("size")).alias("mean"), r6(F.percentile("size", 0.5)).alias("median"), r6(F.stddev_pop("size")).alias("spread"))


@query("E35_frames_per_plate", "select plate, max(frame) + 1 as frames from objects group by plate", "objects")
def frames_per_plate(spark, sf_dir):
    return objects(spark, sf_dir).groupBy("plate").agg((F.max("frame") + 1).alias("frames"))


@query("E37_store_mismatches", "a as (select doc_id % 50 as plate, count(*) as n_a from documents group by 1), b as (select doc_id % 50 as plate, count(*) as n_b from labels group by 1) select plate, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b from a full join b using (plate) where coalesce(n_a, 0) <> coalesce(n_b, 0)")
def store_mismatches(spark, sf_dir):
    count = lambda t, n: table(spark, sf_dir, t).groupBy((F.col("doc_id") % 50).alias("plate")).agg(F.count("*").alias(n))
    rows = count("documents", "n_a").join(count("labels", "n_b"), "plate", "full").fillna(0, ["n_a", "n_b"])
    return rows.where("n_a <> n_b")


@query("S08_not_yet_done", "w as (select *, label % 96 as well from objects) select d.plate, d.well from (select distinct plate, well from w) d where not exists (select 1 from w o where o.plate = d.plate and o.well = d.well and o.cls = 'error' and o.frame >= 20)", "objects")
def not_yet_done(spark, sf_dir):
    """Wells whose last step (an error in the last ten days stands for its output) is not there."""
    rows = objects(spark, sf_dir).withColumn("well", F.col("label") % 96)
    return rows.select("plate", "well").distinct().join(rows.where("cls = 'error' and frame >= 20").select("plate", "well"), ["plate", "well"], "left_anti")
