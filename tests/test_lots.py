"""H02: both lots reach the result, each plate from one of them, and no frame of the first is left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.model import objects
from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def test_both_lots_are_in_the_union(spark):
    got = {r["plate"]: (r["lot"], r["n"]) for r in queries()["H02_union_by_plate"](spark, SF).collect()}
    n = objects(spark, SF).groupBy("plate").agg(F.count("*").alias("whole"), F.count_if(F.col("frame") >= 12).alias("later")).collect()
    assert got == {r["plate"]: (2, r["later"]) if r["plate"] % 2 else (1, r["whole"]) for r in n}
