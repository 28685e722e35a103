"""Connected components of a link table, by hash-to-min rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.shared_files import Tables


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``id`` and ``root``, the smallest node of
    its component, for every node that is not itself the smallest, as one of ``tables``. Links may repeat; a node
    linked with itself alone is left out.

    In a round every node and its neighbours are tied to the smallest of them, until each node has larger neighbours
    alone or a single one. A node's smallest neighbour comes from partial minima, so that no node is a task's alone; it
    is stored, so that the join with it is one of two tables, whose crowded nodes Spark splits.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    edges = tables.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = tables.store(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("last")))
        if near.filter("m < a and m < last").isEmpty():
            out = tables.store(near.filter("m < a").select(F.col("a").alias("id"), F.col("m").alias("root")))
            tables.drop(edges, near)
            return out
        told = both.join(near.select("a", F.least("a", "m").alias("m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = told.union(near.filter("m < a").select("a", F.col("m").alias("b"))).filter("a != b")
        later = tables.store(stars.distinct())
        tables.drop(edges, near)
        edges = later
