"""Connected components of large graphs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, label) of all vertices that edges name; the label is the smallest vertex that can be reached.

    In each round a vertex is joined to its smallest neighbour, and that one to
    its own; edges are redrawn between what they are joined to, and those within
    one vertex or drawn twice go. Vertices may be structs.
    """
    open_ = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    found = None
    while True:
        lowest = open_.select(F.col("v").alias("x"), F.col("u").alias("p")).unionAll(open_.select(F.col("u").alias("x"), F.col("u").alias("p"))).groupBy("x").agg(F.min("p").alias("p"))
        step = cut_lineage(lowest.join(lowest.select(F.col("x").alias("p"), F.col("p").alias("label")), "p").select(F.col("x").alias("vertex"), "label"))
        found = step if found is None else cut_lineage(found.join(step.select(F.col("vertex").alias("label"), F.col("label").alias("further")), "label", "left").select("vertex", F.coalesce("further", "label").alias("label")))
        ends = [step.select(F.col("vertex").alias(c), F.col("label").alias(f"{c}_")) for c in ("u", "v")]
        moved = open_.join(ends[0], "u").join(ends[1], "v").where("u_ != v_").select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v"))
        open_ = cut_lineage(moved.distinct())
        if open_.isEmpty():
            return found
