"""Lower bounds of what taxa still add, upper bounds of the whole, and addition orders, for many alignments at once.

``patterns`` has ``aln_id``, ``site``, ``states`` and ``weight``. Bounds are tables ``aln_id``, ``k``, ``bound``: k is the rank of the
last taxon on the tree. Work that is not plain SQL runs on one alignment, or one alignment and k, per task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.functions import bounds as b
from cladeflow.functions import fitch, newick
from cladeflow.operators import pairs, prefixes, sites, spanning, trees
from cladeflow.operators.trees import _matrix, _per_alignment
from cladeflow.plans.storage import checkpointed


def spanning_tree_weights(patterns: DataFrame, strict: bool = False) -> DataFrame:
    """Weight of the minimum spanning tree of the taxa of each alignment, by Fitch or strict distances. Of the distances
    of every two blocks of taxa the tasks keep a spanning tree, and trees of these come from rounds over all alignments."""
    cells = patterns.select("aln_id", "site", "weight", F.posexplode("states").alias("taxon", "mask")).withColumn("taxon", F.col("taxon").cast("long"))
    found = spanning.spanning_weights(pairs.blocked_spanning_edges(cells, strict), ["aln_id"])
    return patterns.select("aln_id").distinct().join(found, "aln_id", "left").select("aln_id", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))


def upper_bounds(patterns: DataFrame) -> DataFrame:
    """Weight of the spanning tree of strict distances over the informative patterns, and the forced weight of the others."""
    told = checkpointed(patterns.withColumn("forced", sites.forced_weight()))
    fixed = told.groupBy("aln_id").agg(F.coalesce(F.sum(F.col("weight") * F.col("forced")), F.lit(0)).alias("fixed"))
    tree = spanning_tree_weights(told.filter("forced is null").drop("forced"), strict=True)
    return fixed.join(tree, "aln_id", "left").select("aln_id", (F.col("fixed") + F.coalesce("weight", F.lit(0))).alias("upper"))


def swapped_upper_bounds(patterns: DataFrame) -> DataFrame:
    """Length of the greedy tree after swapping, if the spanning tree is not less."""
    begin = trees.greedy_trees(patterns).withColumn("tree_id", F.lit(0).cast("long"))
    end = trees.improved_trees(begin, patterns)
    both = upper_bounds(patterns).join(end.select("aln_id", "length"), "aln_id", "left")
    return both.select("aln_id", F.least("upper", "length").alias("upper"))


def _by_rank(patterns: DataFrame, compute) -> DataFrame:
    """Runs ``compute(masks, weights, first, seed)`` for the patterns of an alignment and each number of first taxa from 3 on; a
    task has one such number. The bound stands at rank first - 1."""
    held = trees.blocks(patterns).withColumn("n", F.size(F.col("row")[0]["states"]))
    keyed = held.withColumn("first", F.explode(F.when(F.col("n") > 3, F.sequence(F.lit(3), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))))

    def run(key, table):
        masks, weights = _matrix(table)
        name, first = key[0].as_py(), key[1].as_py()
        value = compute(masks, weights, first, zlib.crc32(f"{name} {first}".encode()))
        return pa.table({"aln_id": [name], "k": pa.array([first - 1], pa.int64()), "bound": pa.array([value], pa.int64())})

    return keyed.drop("n").groupBy("aln_id", "first").applyInArrow(run, "aln_id string, k long, bound long")


def spanning_rest_bounds(patterns: DataFrame) -> DataFrame:
    """Half the spanning tree of the taxa up to k as one, and the rest."""
    return _by_rank(patterns, lambda masks, weights, first, seed: b.spanning_tree(b.distances(b.merged_rows(masks, first), weights)) // 2)


def pair_cost_table(spark) -> DataFrame:
    """``cost`` of the two sites and ``extra`` beyond their own, for each of the 65,535 masks of joint states."""
    @F.pandas_udf("cost int, extra int")
    def costs(masks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([b.pair_cost(int(m)) for m in masks], columns=["cost", "extra"])

    table = spark.range(1, 1 << 16).select(F.col("id").cast("int").alias("mask16"))
    return table.select("mask16", costs("mask16").alias("c")).select("mask16", "c.cost", "c.extra")


def incompatible_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of unambiguous sites that need more together than alone (``extra``), and the first number of taxa at which either
    is informative (``onset``). The cost table has 65,535 rows and is broadcast."""
    spark = cells.sparkSession
    clear = cells.groupBy("aln_id", "site").agg(F.max(F.bit_count("mask")).alias("most")).filter("most = 1")
    cells = cells.join(clear.select("aln_id", "site"), ["aln_id", "site"], "left_semi")
    found = pairs.blocked_site_pairs(cells).join(F.broadcast(pair_cost_table(spark)), "mask16").filter("extra > 0")
    onset = prefixes.onsets(cells)
    found = found.join(onset.select("aln_id", F.col("site").alias("p"), F.col("onset").alias("onset_p")), ["aln_id", "p"])
    found = found.join(onset.select("aln_id", F.col("site").alias("q"), F.col("onset").alias("onset_q")), ["aln_id", "q"])
    return found.select("aln_id", "p", "q", "mask16", "cost", "extra", F.least("onset_p", "onset_q").alias("onset"))


def incompatibility_bounds(cells: DataFrame, patterns: DataFrame) -> DataFrame:
    """What a greedy matching of incompatible pairs adds at each k: pairs whose onset is above the number of taxa."""
    weights = patterns.select("aln_id", "site", "weight")
    found = incompatible_pairs(cells.join(weights.select("aln_id", "site"), ["aln_id", "site"], "left_semi")).filter("onset > 3")
    found = found.join(weights.select("aln_id", F.col("site").alias("p"), F.col("weight").alias("w_p")), ["aln_id", "p"])
    found = found.join(weights.select("aln_id", F.col("site").alias("q"), F.col("weight").alias("w_q")), ["aln_id", "q"])
    keyed = found.withColumn("k", F.explode(F.sequence(F.lit(3).cast("long"), F.col("onset") - 1)))

    def run(key, held):
        rows = held.select(["p", "q", "onset", "extra", "w_p", "w_q"]).to_pylist()
        copies = {r["p"]: r["w_p"] for r in rows} | {r["q"]: r["w_q"] for r in rows}
        count, cost = b.matching([(r["p"], r["q"], r["onset"], r["extra"]) for r in rows], copies)
        return pa.table({"aln_id": [key[0].as_py()], "k": pa.array([key[1].as_py() - 1], pa.int64()), "bound": [count], "cost": [cost]})

    return keyed.groupBy("aln_id", "k").applyInArrow(run, "aln_id string, k long, bound long, cost long")


def part_bounds(patterns: DataFrame, part, first: int) -> DataFrame:
    """``lower``, ``upper``, ``additive`` and ``final`` of parts of the sites, for trees of the first taxa; ``width`` is the sites of a part."""
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    held = patterns.groupBy("aln_id", part.cast("long").alias("part_id")).agg(row.alias("row"))

    def run(key, table):
        masks, _ = _matrix(table)
        values = {"lower": b.part_lower(masks), "upper": b.part_upper(masks, first), "additive": b.part_additive(masks, first), "final": b.part_final(masks, first), "width": masks.shape[1]}
        return pa.table({"aln_id": [key[0].as_py()], "part_id": [key[1].as_py()]} | {k: pa.array([v], pa.int64()) for k, v in values.items()})

    return held.groupBy("aln_id", "part_id").applyInArrow(run, "aln_id string, part_id long, lower long, upper long, additive long, final long, width long")


def two_way_scores(patterns: DataFrame, part) -> DataFrame:
    """The simple score of each part, and the best over its splits in two."""
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    held = patterns.groupBy("aln_id", part.cast("long").alias("part_id")).agg(row.alias("row"))

    def run(key, table):
        masks, _ = _matrix(table)
        return pa.table({"aln_id": [key[0].as_py()], "part_id": [key[1].as_py()], "score": pa.array([b.simple_partition(masks)], pa.int64()), "best": pa.array([b.best_two_way(masks)], pa.int64())})

    return held.groupBy("aln_id", "part_id").applyInArrow(run, "aln_id string, part_id long, score long, best long")


def _layers(patterns: DataFrame) -> DataFrame:
    """Layers of the weights of each alignment: ``level``, and how often (``times``) the patterns of at least that weight count
    beyond those of the layer below. Distinct weights are few beside the patterns."""
    levels = patterns.select("aln_id", F.col("weight").alias("level")).distinct()
    below = F.lag("level", 1, 0).over(W.Window.partitionBy("aln_id").orderBy("level"))
    return levels.withColumn("times", F.col("level") - below)


def partition_bounds(patterns: DataFrame) -> DataFrame:
    """Sum of the final scores of parts, for each number of first taxa from 3 on; the bound stands at rank k = first - 1.

    Each layer of weights has a partition of its own, found by moving sites until none gains. An alignment, a number of first taxa and a
    layer are one task; the layers' sums are added up, by ``times``."""
    layers = _layers(patterns)
    some = patterns.join(layers, "aln_id").filter("weight >= level")
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    held = some.groupBy("aln_id", "level", "times").agg(row.alias("row"), F.max(F.size("states")).alias("n"))
    keyed = held.withColumn("first", F.explode(F.when(F.col("n") > 3, F.sequence(F.lit(3), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))))

    def run(key, table):
        masks, _ = _matrix(table)
        value = b.optimised_partition(masks, key[2].as_py())[1]
        return pa.table({"aln_id": [key[0].as_py()], "k": pa.array([key[2].as_py() - 1], pa.int64()), "bound": pa.array([table.column("times")[0].as_py() * value], pa.int64())})

    parts = keyed.select("aln_id", "level", "first", "times", "row").groupBy("aln_id", "level", "first").applyInArrow(run, "aln_id string, k long, bound long")
    return parts.groupBy("aln_id", "k").agg(F.sum("bound").alias("bound"))


def uninformative_bounds(patterns: DataFrame) -> DataFrame:
    """From the patterns that are not informative on the taxa up to k: what they need on all taxa beyond their forced weight."""

    def compute(masks, weights, first, seed):
        forced = b.forced_weights(masks[:first])
        some = forced >= 0
        return b.uninformative_bound(masks[:, some], weights[some], forced[some], seed)

    return prefixes.held_for_fewer(_by_rank(patterns, compute))


def corrected_bounds(patterns: DataFrame, tries: int = 8) -> DataFrame:
    """Random parts of four sites, each counted as often as it stands there: lower bound less upper bound on the taxa up to k. The best of
    ``tries`` seeded tries, each with swaps at its end, is the bound; a try of an alignment and a number of first taxa is one task's
    row, so that more tries spread over more tasks."""
    held = trees.blocks(patterns, 1 << 40).withColumn("n", F.size(F.col("row")[0]["states"]))
    keyed = held.filter("n > 3").withColumn("first", F.explode(F.sequence(F.lit(3), F.col("n") - 1))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                names, firsts, turns, rows = (part.column(c).to_pylist() for c in ("aln_id", "first", "turn", "row"))
                cells = [(np.array([r["states"] for r in row], np.uint8).T, np.array([r["weight"] for r in row], np.int64)) for row in rows]
                seeds = [zlib.crc32(f"{name} {first}".encode()) + turn for name, first, turn in zip(names, firsts, turns)]
                value = b.corrected_tries(cells, firsts, seeds)
                yield pa.RecordBatch.from_arrays([part.column("aln_id"), pa.array([f - 1 for f in firsts], pa.int64()), pa.array(value, pa.int64())], names=["aln_id", "k", "bound"])

    dealt = keyed.select("aln_id", "first", "turn", "row").repartition(patterns.sparkSession.sparkContext.defaultParallelism * 4, "aln_id", "first", "turn")
    found = dealt.mapInArrow(run, "aln_id string, k long, bound long").groupBy("aln_id", "k").agg(F.max("bound").alias("bound"))
    return prefixes.held_for_fewer(found)


def hitting_set_bounds(patterns: DataFrame) -> DataFrame:
    """Greedy covers of taxon pairs; at least the corrected bound."""

    def compute(masks, weights, first, seed):
        expanded = np.repeat(np.arange(masks.shape[1]), weights)
        return sum(gain for gain, _ in b.hitting_sets(masks[:, expanded], first))

    covers = _by_rank(patterns, compute)
    both = covers.join(corrected_bounds(patterns).withColumnRenamed("bound", "corrected"), ["aln_id", "k"], "left")
    return both.select("aln_id", "k", F.greatest("bound", F.coalesce("corrected", F.lit(0))).alias("bound"))


def surplus_bounds(cells: DataFrame) -> DataFrame:
    """Lower bound of each alignment: what its sites need alone, and the surpluses of a first-fit matching of site pairs."""
    alone = sites.columns(cells).groupBy("aln_id").agg(F.sum(sites.site_lower_bound()).alias("base"))
    found = pairs.pair_surplus(cells).filter("surplus > 0").groupBy("aln_id").agg(F.collect_list(F.struct("p", "q", "surplus")).alias("pairs"))
    both = alone.join(found, "aln_id", "left")

    def run(batches):
        for batch in batches:
            names, base, held = (batch.column(c).to_pylist() for c in ("aln_id", "base", "pairs"))
            value = [b.first_fit([(x["p"], x["q"], x["surplus"]) for x in h or []], n) for n, h in zip(base, held)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(value, pa.int64())], names=["aln_id", "bound"])

    return both.mapInArrow(run, "aln_id string, bound long")


def combined(distinct: DataFrame, incompatible: DataFrame | None = None, loaded: DataFrame | None = None, others: list[DataFrame] | None = None) -> DataFrame:
    """Bounds put together: the incompatibility bound is added to the distinct-bases bound, a loaded table takes its
    place where it has a row, and of all others the largest counts."""
    out = distinct.select("aln_id", "k", "bound")
    if incompatible is not None:
        out = out.join(incompatible.select("aln_id", "k", F.col("bound").alias("more")), ["aln_id", "k"], "left")
        out = out.select("aln_id", "k", (F.col("bound") + F.coalesce("more", F.lit(0))).alias("bound"))
    if loaded is not None:
        out = out.join(loaded.select("aln_id", "k", F.col("bound").alias("given")), ["aln_id", "k"], "left")
        out = out.select("aln_id", "k", F.coalesce("given", "bound").alias("bound"))
    for other in others or []:
        out = out.join(other.select("aln_id", "k", F.col("bound").alias("other")), ["aln_id", "k"], "left")
        out = out.select("aln_id", "k", F.greatest("bound", F.coalesce("other", F.lit(0))).alias("bound"))
    return out


def whole_lower_bounds(patterns: DataFrame) -> DataFrame:
    """Lower bound of all patterns of an alignment: what its sites need alone and the surpluses of pairs of sites, taken in order as
    long as both are unused, or the spanning tree's half; and for the uninformative patterns their forced weight."""
    told = checkpointed(patterns.withColumn("forced", sites.forced_weight()))
    fixed = told.groupBy("aln_id").agg(F.coalesce(F.sum(F.col("weight") * F.col("forced")), F.lit(0)).alias("fixed"))

    def run(key, held):
        masks, weights = _matrix(held)
        value = max(b.paired_lower(masks, weights), -(-b.spanning_tree(b.distances(masks, weights)) // 2))
        return pa.table({"aln_id": [key[0].as_py()], "rest": [value]})

    rest = _per_alignment(told.filter("forced is null").drop("forced"), run, "aln_id string, rest long")
    return fixed.join(rest, "aln_id", "left").select("aln_id", (F.col("fixed") + F.coalesce("rest", F.lit(0))).alias("lower"))


def partitioned_lower_bounds(patterns: DataFrame) -> DataFrame:
    """Lower bound of all patterns of an alignment: the lower bounds of parts of its informative patterns, layer by layer of their
    weights, by the partition that moves of single sites reach; and the forced weight of the others. A layer is one task."""
    told = checkpointed(patterns.withColumn("forced", sites.forced_weight()))
    fixed = told.groupBy("aln_id").agg(F.coalesce(F.sum(F.col("weight") * F.col("forced")), F.lit(0)).alias("fixed"))
    some = told.filter("forced is null").drop("forced")
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    held = some.join(_layers(some), "aln_id").filter("weight >= level").groupBy("aln_id", "level", "times").agg(row.alias("row"))

    def run(key, table):
        masks, _ = _matrix(table)
        return pa.table({"aln_id": [key[0].as_py()], "part": pa.array([table.column("times")[0].as_py() * b.optimised_partition(masks)[1]], pa.int64())})

    parts = held.groupBy("aln_id", "level").applyInArrow(run, "aln_id string, part long").groupBy("aln_id").agg(F.sum("part").alias("rest"))
    return fixed.join(parts, "aln_id", "left").select("aln_id", (F.col("fixed") + F.coalesce("rest", F.lit(0))).alias("lower"))


def addition_orders(distances: DataFrame, rule: str = "max_min") -> DataFrame:
    """``rank`` and ``taxon`` of each alignment by distances (aln_id, i, j, dist); rules are ``max_min`` and ``max_sum``."""

    def run(key, held):
        i, j, d = (held.column(c).to_numpy() for c in ("i", "j", "dist"))
        n = int(max(i.max(), j.max())) + 1
        matrix = np.zeros((n, n), np.int64)
        matrix[i, j] = matrix[j, i] = d
        order = b.addition_order(matrix, rule)
        return pa.table({"aln_id": [key[0].as_py()] * n, "rank": pa.array(range(n), pa.int64()), "taxon": pa.array(order, pa.int64())})

    return distances.select("aln_id", "i", "j", "dist").groupBy("aln_id").applyInArrow(run, "aln_id string, rank long, taxon long")


def addition_orders_of_cells(cells: DataFrame, rule: str = "max_min") -> DataFrame:
    """``addition_orders`` by Fitch distances, for alignments without gaps in the grid and without weights. A task has an alignment's rows, a byte a
    cell; no distance becomes a row. Taxa are ranks from 0."""

    def run(key, held):
        held = held.sort_by("id")
        masks = np.frombuffer(b"".join(held.column("masks").to_pylist()), np.uint8).reshape(len(held), -1)
        order = b.order_of_rows(masks, rule) if len(masks) > 1 else []
        return pa.table({"aln_id": pa.array([key[0].as_py()] * len(order), pa.string()), "rank": pa.array(range(len(order)), pa.int64()), "taxon": pa.array(order, pa.int64())})

    rows = pairs.packed_rows(cells).select("aln_id", "id", "masks")
    rows = rows.repartition(4 * cells.sparkSession.sparkContext.defaultParallelism, "aln_id")
    return rows.groupBy("aln_id").applyInArrow(run, "aln_id string, rank long, taxon long")


#: Which absent taxon is placed next, from the costs of all its places: larger keys first.
RULES = ("max_mini", "max_mini_lb", "max_variance", "max_rank", "tournament")


def placement_orders(patterns: DataFrame, rule: str = "max_mini") -> DataFrame:
    """Orders from placing every absent taxon on every edge of the growing tree, from the heaviest three taxa on. The next is
    the one with the largest least cost (``max_mini``; of equals the larger variance), that cost less newly shown states
    (``max_mini_lb``), the largest variance, the largest mean rank of its costs among all costs, or the most wins over
    others' costs (``tournament``)."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")

    def run(key, held):
        masks, weights = _matrix(held)
        order = list(fitch.heaviest_three(masks, weights)[0])
        parents = newick.insert(newick.start(), 1)
        while len(order) < len(masks):
            down, up, _ = fitch.views(parents, masks[order], weights)
            rest = [t for t in range(len(masks)) if t not in order]
            costs = np.array([fitch.insertion_costs(down, up, masks[t], weights)[1:] for t in rest])
            seen = np.bitwise_or.reduce(masks[order], axis=0)
            least, spread = costs.min(1), costs.var(1)
            every = np.sort(costs.ravel())
            value = {
                "max_mini": least,
                "max_mini_lb": least - np.array([int(weights[(masks[t] & seen) == 0].sum()) for t in rest]),
                "max_variance": spread,
                "max_rank": np.searchsorted(every, costs).mean(1),
                "tournament": (np.searchsorted(every, costs) - np.array([np.searchsorted(np.sort(c), c) for c in costs])).sum(1),
            }[rule]
            k = max(range(len(rest)), key=lambda x: (value[x], spread[x], -x))
            parents = newick.insert(parents, 1 + int(costs[k].argmin()))
            order.append(rest[k])
        n = len(order)
        return pa.table({"aln_id": [key[0].as_py()] * n, "rank": pa.array(range(n), pa.int64()), "taxon": pa.array(order, pa.int64())})

    return _per_alignment(patterns.filter(F.size("states") >= 3), run, "aln_id string, rank long, taxon long")


def rest_upper_bounds(patterns: DataFrame, distances: DataFrame) -> DataFrame:
    """At most so much do the taxa after rank k add: the length of a neighbour-joining tree of them alone, and the least
    distance between the two groups."""
    across = pairs.cross_minimum(distances).select("aln_id", F.col("r").alias("first"), "min_dist")
    held = trees.blocks(patterns).withColumn("n", F.size(F.col("row")[0]["states"]))
    keyed = held.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))

    def run(key, table):
        masks, weights = _matrix(table)
        first = key[1].as_py()
        tail = masks[first:]
        value = 0
        if len(tail) > 1:
            text = fitch.neighbour_joining(b.distances(tail, weights, strict=True).astype(float))
            value = fitch.length(newick.from_newick(text, {str(i + 1): i for i in range(len(tail))}), tail, weights)
        return pa.table({"aln_id": [key[0].as_py()], "first": pa.array([first], pa.int64()), "length": pa.array([value], pa.int64())})

    own = keyed.drop("n").groupBy("aln_id", "first").applyInArrow(run, "aln_id string, first long, length long")
    return own.join(across, ["aln_id", "first"]).select("aln_id", (F.col("first") - 1).alias("k"), (F.col("length") + F.col("min_dist")).alias("bound"))
