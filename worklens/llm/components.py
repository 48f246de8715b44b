"""Connected components of an edge table by alternating large and small stars.

Kiveris et al., SoCC 2014. Every step is a grouped minimum and a join on the
node, so neighbours of a node are never gathered; the edge table is written
after each round, which keeps lineage short and loses nothing with an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.session import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the least neighbour: the larger ones (large star) or the smaller ones and itself."""
    if small:
        directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        directed = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = directed.join(least, "u")
    if small:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    else:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node. No edges give no rows."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        pairs = materialize(_star(_star(pairs, small=False), small=True), "stars")
        new = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
