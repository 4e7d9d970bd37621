"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation (partial before the shuffle) and a join on node ids; the edge table is
written to the shared folder after each round, and the round's before emptied.  Nothing is collected but one number a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the smallest node it is connected with.
    Self-loops, repeated edges and either direction are fine; no edges give no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = e = materialize(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(low, "u")
        e = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = held, materialize(e, "edges")
        held = e
        release(last)
        # stars are what is wanted: every node but a root has one edge, and no root has one upwards
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        ends = ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
        if not ends.where("n > 1 or (n = 1 and least = 0)").limit(1).count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
