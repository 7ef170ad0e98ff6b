"""Streams equal their batch form; readers and writers make round trips."""

from pyspark.sql import functions as F

from platewise import sources, streaming
from platewise.model import table
from platewise.queries import QUERIES

SF = "/root/testdata/sf0.001"


def drained(query_of, spark, path, name, mode):
    stream = query_of(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).toPandas()


def test_tumbling_windows(spark, tmp_path):
    table(spark, SF, "events").orderBy("ts").repartition(6).write.parquet(f"{tmp_path}/e")
    got = drained(lambda s: streaming.tumbling(s, late="60 days"), spark, f"{tmp_path}/e", "tumbling", "complete")
    want = QUERIES["T01_rolling_windows"](spark, SF).toPandas()
    key = lambda f: sorted(zip(f.plate, f.start.astype(str), f.n, f.total, strict=True))
    assert key(got) == key(want)


def test_sessions_cover_all_events(spark, tmp_path):
    table(spark, SF, "events").write.parquet(f"{tmp_path}/e")
    got = drained(lambda s: streaming.sessions(s, late="60 days"), spark, f"{tmp_path}/e", "sessions", "complete")
    assert got.n.sum() == 1000


def test_path_lengths_keep_state(spark, tmp_path):
    from platewise.model import track_points

    points = track_points(spark, SF).select("track_id", "frame", "x", "y")
    for i in range(3):
        points.where(F.floor(F.col("frame") / 30) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    got = drained(streaming.path_lengths, spark, f"{tmp_path}/p", "paths", "update").groupby("track_id").n.max()
    assert got.to_dict() == {r["track_id"]: r["n"] for r in points.where("frame < 90").groupBy("track_id").agg(F.count("*").alias("n")).collect()}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Id\tsirna\nA--1\ts1\nA--2\ts2\n")
    assert [tuple(r) for r in sources.read_tsv(spark, f"{tmp_path}/t.tsv").collect()] == [("A--1", "s1"), ("A--2", "s2")]
    (tmp_path / "g.dot").write_text('digraph g {\n "1_2" -> "2_5" [w=1];\n a -> b;\n}\n')
    assert {tuple(r) for r in sources.read_tracking_graph(spark, f"{tmp_path}/g.dot").collect()} == {("1_2", "2_5"), ("a", "b")}
    (tmp_path / "m.xml").write_text("<M><Marker_Type><Type>3</Type><Marker><MarkerX>1</MarkerX><MarkerY>2</MarkerY><MarkerZ>1</MarkerZ></Marker><Marker><MarkerX>4</MarkerX><MarkerY>5</MarkerY><MarkerZ>2</MarkerZ></Marker></Marker_Type></M>")
    assert {tuple(r) for r in sources.read_markers(spark, f"{tmp_path}/m.xml").collect()} == {(3, 1.0, 2.0, 0), (3, 4.0, 5.0, 1)}
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", 2.5)], "plate int, name string, v double")
    sources.write_plates(rows, f"{tmp_path}/w")
    sources.write_plates(spark.createDataFrame([(2, "c", 1.0)], rows.schema), f"{tmp_path}/w")
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {"a", "c"}
    sources.write_ranking(rows.coalesce(1), f"{tmp_path}/r", "name", "v")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/r").collect()] == ["b\t2.5", "a\t0.5"]


def test_text_formats_of_features_classes_and_markers(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("0\t3\textra\t1.5\t2\t0\t4\t1\t5\n1\t4\t9\t9\t7\t8\t6\t9\t5\t9\n\n")
    got = {(r["frame"], r["label"], r["feature"]): r["value"] for r in sources.read_feature_maps(spark, f"{tmp_path}/f.tsv").collect()}
    assert len(got) == 12 and got[0, 3, "x"] == 1.5 and got[0, 3, "bottom"] == 5 and got[1, 4, "x"] == 7 and got[1, 4, "left"] == 6
    (tmp_path / "a.arff").write_text("%class-labels 1:inter 2:mito\n%class-colors 1:#00ff00\n@relation r\n@attribute size numeric\n@ATTRIBUTE 'mean x' REAL\n@attribute class {inter,mito}\n@data\n1, 2.5, inter\n3,?,mito\n")
    rows, pragmas = sources.read_arff(spark, f"{tmp_path}/a.arff")
    assert dict(rows.dtypes) == {"size": "double", "mean x": "double", "class": "string"} and [tuple(r) for r in rows.orderBy("size").collect()] == [(1.0, 2.5, "inter"), (3.0, None, "mito")]
    assert pragmas == {"class-labels": ["1:inter", "2:mito"], "class-colors": ["1:#00ff00"]}
    points = spark.createDataFrame([(7, 0, 1.0, 2.0), (7, 1, 3.0, 4.0), (7, 2, 5.0, 6.0), (9, 2, 0.0, 0.5)], "track_id int, frame int, x double, y double")
    sources.write_markers(points, f"{tmp_path}/m", skipped=(1,))
    back = {tuple(r) for r in sources.read_markers(spark, f"{tmp_path}/m").collect()}
    assert back == {(7, 1.0, 2.0, 0), (7, 3.0, 4.0, 2), (7, 5.0, 6.0, 3), (9, 0.0, 0.5, 3)}
