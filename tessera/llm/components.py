"""Distributed connected components, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, label) for every vertex that an edge names; label: the smallest vertex reachable.

    Each round joins every vertex to its smallest neighbour and that one's own,
    replaces the ends of edges by what they were joined to, and drops edges
    within one vertex and repeated ones, so the graph shrinks by more than half
    each time. Edges and labels are cut from their lineage as tables in the
    shared folder. A vertex with a third of all edges has one row on the other
    side of each join, so adaptive skew joins split it; minima are combined
    before they are shuffled.
    """
    spark = edges.sparkSession
    left = written(spark, edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("_u"), F.greatest(a, b).alias("_v")).distinct(), "edges")
    if left.isEmpty():
        return left.select(F.col("_u").alias("vertex"), F.col("_v").alias("label"))
    labels = None
    while labels is None or not left.isEmpty():
        ends = left.select(F.col("_v").alias("_x"), F.col("_u").alias("_p")).unionAll(left.select(F.col("_u").alias("_x"), F.col("_u").alias("_p")))
        parents = ends.groupBy("_x").agg(F.min("_p").alias("_p"))
        joined = written(spark, parents.join(parents.select(F.col("_x").alias("_p"), F.col("_p").alias("_l")), "_p").select("_x", "_l"), "joined")
        by_u = left.join(joined.select(F.col("_x").alias("_u"), F.col("_l").alias("_lu")), "_u")
        both = by_u.join(joined.select(F.col("_x").alias("_v"), F.col("_l").alias("_lv")), "_v").where("_lu != _lv")
        done, left = left, written(spark, both.select(F.least("_lu", "_lv").alias("_u"), F.greatest("_lu", "_lv").alias("_v")).distinct(), "edges")
        drop_written(spark, done)
        if labels is None:
            labels = joined
        else:
            done, labels = labels, written(spark, labels.join(joined.select(F.col("_x").alias("_l"), F.col("_l").alias("_n")), "_l", "left").select("_x", F.coalesce("_n", "_l").alias("_l")), "labels")
            drop_written(spark, done)
            drop_written(spark, joined)
    drop_written(spark, left)
    return labels.select(F.col("_x").alias("vertex"), F.col("_l").alias("label"))
