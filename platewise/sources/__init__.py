"""Readers and writers of screening tables, and the shared folder for intermediate ones."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs on one machine."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-platewise-", dir="/tmp"))
    return _OWN[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and a lost executor costs a reread."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated text with a header; all columns are strings unless a schema is given."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_tracking_graph(spark: SparkSession, path: str) -> DataFrame:
    """source, target: the edges of a GraphViz digraph, one `a -> b` a line."""
    edge = r'^\s*"?([^"\s]+)"?\s*->\s*"?([^"\s;\[]+)"?'
    rows = spark.read.text(path).where(F.col("value").rlike(edge))
    return rows.select(F.regexp_extract("value", edge, 1).alias("source"), F.regexp_extract("value", edge, 2).alias("target"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """track, x, y, frame: annotation XML with Marker_Type and Marker elements; frames count from 0."""
    rows = spark.read.format("xml").option("rowTag", "Marker_Type").schema("Type int, Marker array<struct<MarkerX:double, MarkerY:double, MarkerZ:int>>").load(path)
    return rows.select(F.col("Type").alias("track"), F.explode("Marker").alias("m")).select("track", F.col("m.MarkerX").alias("x"), F.col("m.MarkerY").alias("y"), (F.col("m.MarkerZ") - 1).alias("frame"))


def write_plates(df: DataFrame, path: str, keys: tuple[str, ...] = ("plate",)) -> None:
    """One directory for each plate; plates that are written again replace their old rows only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_ranking(df: DataFrame, path: str, name: str, score: str) -> None:
    """`#Name score` lines in descending order, tab-separated."""
    df.orderBy(F.desc(score), name).select(F.concat_ws("\t", name, F.col(score).cast("string"))).write.mode("overwrite").text(path)


def read_feature_maps(spark: SparkSession, path: str) -> DataFrame:
    """frame, label, feature, value: a tab-separated feature file without a header, whose first two columns are frame and label and whose last six
    are x, y and four extents. One row for each object and feature."""
    names = ("x", "y", "left", "right", "top", "bottom")
    cells = F.split("value", "\t")
    at = lambda i: F.element_at(cells, i - len(names))
    rows = spark.read.text(path).where(F.size(cells) >= len(names) + 2)
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), at(i).cast("double").alias("value")) for i, n in enumerate(names)]))
    return rows.select(F.get(cells, F.lit(0)).cast("int").alias("frame"), F.get(cells, F.lit(1)).cast("int").alias("label"), values.alias("v")).select("frame", "label", "v.*")


def read_arff(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The rows of an ARFF file, typed by its attributes (numeric: double, else string), and its pragmas (class-labels, class-colors). Only the
    lines that begin with @ or % reach the driver."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    head = [r["line"] for r in lines.where(F.col("line").rlike("^[@%]")).collect()]
    attributes = [re.match(r"@attribute\s+('[^']*'|\S+)\s+(.*)", line, re.I).groups() for line in head if line.lower().startswith("@attribute")]
    pragmas = {p[0]: p[1:] for p in (line.lstrip("%").split() for line in head if line.startswith("%")) if p}
    numeric = {"numeric", "real", "integer"}
    schema = ", ".join(f"`{name.strip(chr(39))}` {'double' if kind.split()[0].lower() in numeric else 'string'}" for name, kind in attributes)
    data = lines.where(~F.col("line").rlike("^[@%]"))
    return data.select(F.from_csv("line", schema, {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*"), pragmas


def write_markers(points: DataFrame, path: str, skipped: tuple[int, ...] = ()) -> None:
    """Annotation XML: a Marker_Type for each track (track_id, frame, x, y), its markers by frame. Frames count from 1 in the file, and those in
    skipped, which the tracks were numbered without, are put back."""
    frame = F.col("frame") + 1
    for gap in sorted(skipped):
        frame = F.when(frame >= gap + 1, frame + 1).otherwise(frame)
    markers = F.array_sort(F.collect_list(F.struct(frame.alias("MarkerZ"), F.col("x").alias("MarkerX"), F.col("y").alias("MarkerY"))))
    rows = points.groupBy(F.col("track_id").alias("Type")).agg(markers.alias("Marker"))
    rows.write.mode("overwrite").format("xml").option("rowTag", "Marker_Type").option("rootTag", "Marker_Data").save(path)
