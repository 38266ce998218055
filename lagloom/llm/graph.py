"""Connected components by contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.sources.writers import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges (a, b)``; the component is its smallest id.

    Union-find as rounds over tables: every vertex hooks to its smallest
    neighbour and the edges between hooked vertices remain.  Only vertices
    smaller than all their neighbours survive, so each round leaves at most
    half of them, and the survivor of a component is its smallest id.  A vertex
    with many neighbours costs one pre-aggregated row per task.  Each round is
    a written table, so a lost executor repeats one round at most.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = cut_lineage(edges.dropna().distinct(), "edges")
    both = edges.union(edges.select("b", "a")).toDF("id", "other")
    found = both.select("id", F.col("id").alias("component")).distinct()
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("id", "other")
        hooks = cut_lineage(both.groupBy("id").agg(F.least("id", F.min("other")).alias("to")), "hooks")
        found = found.join(hooks.toDF("component", "to"), "component", "left")
        found = found.select("id", F.coalesce("to", "component").alias("component"))
        ends = edges.join(hooks.toDF("a", "to_a"), "a").join(hooks.toDF("b", "to_b"), "b")
        left = ends.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = cut_lineage(left.distinct(), "edges")
    return cut_lineage(found, "components")
