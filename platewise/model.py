"""The screening model as views over the driver's tables, once as DataFrames and once as DuckDB SQL.

Only this module knows the tables. Real screening tables with the same columns can replace a view without touching an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLATES = 5
WIDTH, HEIGHT = 12, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _y():
    return F.get_json_object("props", "$.k").cast("double")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plate, track_id, frame, x, y: one row for each object of a track, frames counted from 0."""
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select((F.col("user_id") % PLATES).alias("plate"), F.col("user_id").alias("track_id"), frame.alias("frame"), F.col("value").alias("x"), _y().alias("y"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plate, frame, label, x, y, cls: the objects of each frame (a day) with their class."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % PLATES).alias("plate"), F.datediff("ts", F.lit("2024-01-01")).alias("frame"), F.col("event_id").alias("label"), F.col("value").alias("x"), _y().alias("y"), F.col("event_type").alias("cls"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp, plate, condition, is_control, f: a feature vector for each experiment; condition 0 is the control."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("exp"), (F.col("vec_id") % PLATES).alias("plate"), F.col("label").alias("condition"), (F.col("label") == 0).alias("is_control"), F.col("embedding").cast("array<double>").alias("f"))


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plate, sirna, gene, batch, measure, is_control: one measure for each experiment of the screen."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_suppkey") % PLATES).alias("plate"), F.col("p_partkey").alias("sirna"), F.col("p_brand").alias("gene"), F.year("l_shipdate").alias("batch"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("measure"), (F.col("p_type") == "ECONOMY").alias("is_control"))


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sirna, gene, position, row, col: the place of each siRNA on its plate, 32 rows of 12."""
    position = (F.col("p_partkey") % (WIDTH * HEIGHT) + 1).alias("position")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sirna"), F.col("p_brand").alias("gene"), F.col("p_size").alias("size"), position)
    return rows.select("*", (F.floor((F.col("position") - 1) / WIDTH) + 1).alias("row"), ((F.col("position") - 1) % WIDTH + 1).alias("col"))


def qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, passed: the quality flag of each experiment that has one."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", "source", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child, ordinal: the children of each lineage event."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("size"))


VIEWS = {
    "track_points": """select user_id % 5 as plate, user_id as track_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as frame, value as x, regexp_extract(props, '"k": *([0-9]+)', 1)::double as y from events""",
    "objects": """select user_id % 5 as plate, date_diff('day', date '2024-01-01', ts::date)::int as frame, event_id as label, value as x, regexp_extract(props, '"k": *([0-9]+)', 1)::double as y, event_type as cls from events""",
    "features": """select vec_id as exp, vec_id % 5 as plate, label as condition, label = 0 as is_control, embedding::double[] as f from embeddings""",
    "screen": """select l_suppkey % 5 as plate, p_partkey as sirna, p_brand as gene, year(l_shipdate)::int as batch, l_extendedprice * (1 - l_discount) as measure, p_type = 'ECONOMY' as is_control from lineitem join part on l_partkey = p_partkey""",
    "wells": """select p_partkey as sirna, p_brand as gene, p_size as size, p_partkey % 384 + 1 as position, (p_partkey % 384) // 12 + 1 as row, (p_partkey % 384) % 12 + 1 as col from part""",
    "qc": """select doc_id, source, quality = 1 and toxic = 0 as passed from labels join documents using (doc_id)""",
    "lineage": """select l_orderkey as parent, l_partkey as child, l_linenumber as ordinal, l_quantity as size from lineitem""",
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query, and its DuckDB SQL over the named views. sql is a select, or common table expressions and a select."""

    def register(function):
        QUERIES[name] = function
        if sql:
            heads = [f"{v} as ({VIEWS[v]})" for v in views.split()]
            starts = sql.lstrip().lower().startswith("select")
            ORACLES[name] = ("with recursive " + ", ".join(heads) + (" " if starts else ", ") if heads else "" if starts else "with ") + sql.strip()
        return function

    return register


def r6(column):
    """Rounded to six places, for results that another engine sums in another order."""
    return F.round(column.cast("double"), 6)


def q6(sql: str) -> str:
    return f"(round(({sql})::double, 6) + 0.0)"
