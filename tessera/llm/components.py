"""Connected components of an edge table, all in Spark.

Every round each vertex takes the smallest of itself and its neighbours as
parent, edges are redrawn between grandparents, and loops and repeats go. A
vertex that is smallest among its neighbours absorbs at least one other, so the
number of vertices at least halves each round: rounds grow with the logarithm
of the largest component. Hubs are only ever met by aggregations with partial
sums and by joins against one row for each vertex, which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``: one row ``(id, component)`` for each vertex that has an edge to another; component is the smallest id."""
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        old = [edges, labels]
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        up = materialize(parent)
        grand = up.select(F.col("v").alias("p"), F.col("p").alias("g"))
        step = materialize(up.join(grand, "p").select("v", "g"))
        if labels is None:
            labels = step.select(F.col("v").alias("id"), F.col("g").alias("component"))
        else:
            labels = labels.join(step.withColumnRenamed("v", "component"), "component", "left").select("id", F.coalesce("g", "component").alias("component"))
        labels = materialize(labels)
        old += [up, step]
        a = step.select(F.col("v").alias("a"), F.col("g").alias("x"))
        b = step.select(F.col("v").alias("b"), F.col("g").alias("y"))
        edges = materialize(
            edges.join(a, "a").join(b, "b").where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
        discard(*old)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
