"""Distributed connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.session import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, component`` for every vertex that has an edge to another; the component is its smallest vertex.

    Loops, nulls, repeated and reversed edges do no harm; no edges give no rows. Each half round points the ends of
    every edge at a smaller vertex, written once as a table in the shared folder: a lost executor repeats one half
    round. Minima are aggregated before the shuffle and looked up in a written table, so both sides of every join are
    shuffles that adaptive execution can split where a hub holds many edges. The driver sees two numbers per round.
    """
    def oriented(x, y):
        return edges_of.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")).where("low < high").distinct()

    def parents(graph):
        return materialize(graph.groupBy("high").agg(F.min("low").alias("parent")), "parents")

    edges_of = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    graph, seen = materialize(oriented(F.col("x"), F.col("y")), "edges"), None
    while True:
        state = graph.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(20)"))).first()
        if not state[0] or tuple(state) == seen:
            break
        seen = tuple(state)
        parent = parents(graph)
        # every lower neighbour of a vertex, and the vertex itself, is tied to the smallest of them
        edges_of = graph.join(parent, "high").select(F.col("low").alias("x"), F.col("parent").alias("y")).union(
            parent.select("high", "parent"))
        graph = materialize(oriented(F.col("x"), F.col("y")), "edges")
        parent = parents(graph)
        # every higher neighbour of a vertex is tied to that vertex's smallest neighbour
        edges_of = graph.join(parent.select(F.col("high").alias("low"), "parent"), "low", "left").select(
            F.col("high").alias("x"), F.coalesce("parent", "low").alias("y")).union(parent.select("high", "parent"))
        graph = materialize(oriented(F.col("x"), F.col("y")), "edges")
    return graph.select(F.col("high").alias("vertex"), F.col("low").alias("component")).union(
        graph.select(F.col("low"), F.col("low")).distinct())
