"""How many modes a distribution has (letter J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.model import features, query, r6, screen
from platewise.operators import modes as M


@query("J42_dip_by_gene")
def dip_by_gene(spark, sf_dir):
    """The dip of each gene's measures."""
    return M.dip(screen(spark, sf_dir), ["gene"], "measure").select("gene", "n", r6(F.col("dip")).alias("dip"), "thinned")


@query("J42_dip_by_element")
def dip_by_element(spark, sf_dir):
    """The dip of each element of the feature vectors, over all experiments."""
    rows = features(spark, sf_dir).select(F.posexplode("f").alias("element", "v"))
    return M.dip(rows, ["element"], "v").select("element", "n", r6(F.col("dip")).alias("dip"), "thinned")
