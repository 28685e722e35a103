"""Minimum spanning trees of many graphs at once, by rounds of contraction.

In a round every component takes its least edge, by weight and then by its ends, so that no two edges are equal and the edges
taken close no circle; what they tie becomes one component, and of the edges between two components the least is kept. The
components of a graph at least halve, so that rounds are few; a round is aggregations with partial minima and joins on nodes,
and no graph is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.plans.storage import checkpointed, dropped


def spanning_trees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (``keys``, i, j, dist) of a minimum spanning tree, or forest, of each graph of ``edges``. Edges may repeat; of the spanning
    trees of a graph it is the one whose edges come first by dist, i and j."""
    end = F.struct("dist", "i", "j")
    live = edges.filter("i <> j").select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").groupBy(*keys, "i", "j").agg(F.min("dist").alias("dist"))
    live = checkpointed(live.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), end.alias("edge")))
    taken = None
    while True:
        both = live.select(*keys, F.col("a").alias("node"), F.struct("edge", F.col("b").alias("other")).alias("way"))
        both = both.unionByName(live.select(*keys, F.col("b").alias("node"), F.struct("edge", F.col("a").alias("other")).alias("way")))
        least = checkpointed(both.groupBy(*keys, "node").agg(F.min("way").alias("way")))
        if least.isEmpty():
            dropped(live)
            return edges.select(*keys, "i", "j", "dist").limit(0) if taken is None else taken.select(*keys, "edge.i", "edge.j", "edge.dist")
        found = least.select(*keys, "way.edge").distinct()
        taken = found if taken is None else taken.unionByName(found)
        # least edges run towards one pair that take each other: the lower of these names the component
        back = least.select(*keys, F.col("node").alias("up"), F.col("way.other").alias("then"))
        tops = least.select(*keys, "node", F.col("way.other").alias("up")).join(back, [*keys, "up"])
        tops = tops.select(*keys, "node", F.when((F.col("then") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up"))
        tops = checkpointed(tops)
        settled = False
        while not settled:
            further = tops.select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
            later = checkpointed(tops.join(further, [*keys, "up"]).select(*keys, "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            dropped(tops)
            tops, settled = later, later.filter("moved").isEmpty()
        merged = live
        for side in ("a", "b"):
            merged = merged.join(tops.select(*keys, F.col("node").alias(side), F.col("up").alias("top")), [*keys, side]).drop(side).withColumnRenamed("top", side)
        merged = merged.filter("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge"))
        later = checkpointed(merged)
        dropped(live, tops)
        live = later


def spanning_weights(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``weight`` of the minimum spanning tree of each graph."""
    return spanning_trees(edges, keys).groupBy(*keys).agg(F.sum("dist").alias("weight"))
