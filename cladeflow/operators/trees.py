"""Trees over alignments: scoring, placement, building, swapping and exact search.

Trees are rows; so are blocks of patterns. A task gets some trees of one alignment and one block of its patterns, and
numpy runs across the block. ``patterns`` has ``aln_id``, ``site``, ``states`` and ``weight``; trees are ``parents`` arrays
(see ``cladeflow.functions.newick``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import fitch, newick
from cladeflow.functions.dna import fitch_cost, fitch_union
from cladeflow.plans.storage import checkpointed

#: Patterns of a block; trees of a batch.
BLOCK, BATCH = 4096, 1024


def three_taxon_lengths(patterns: DataFrame) -> DataFrame:
    """Length of the only tree of the first three taxa of each alignment."""
    a, b, c = (F.element_at("states", i) for i in (1, 2, 3))
    cost = fitch_cost(a, b) + fitch_cost(fitch_union(a, b), c)
    return patterns.filter(F.size("states") >= 3).groupBy("aln_id").agg(F.sum(F.col("weight") * cost).alias("length"))


def blocks(patterns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Patterns of an alignment in blocks of ``size`` sites."""
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    return patterns.groupBy("aln_id", F.floor(F.col("site") / size).alias("block")).agg(row.alias("row"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Masks, taxa by patterns, and weights of all blocks in a table."""
    rows = [r for held in table.column("row").to_pylist() for r in held]
    return np.array([r["states"] for r in rows], np.uint8).T.copy(), np.array([r["weight"] for r in rows], np.int64)


def _met(trees: DataFrame, held: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """Runs on batches of an alignment's trees with its blocks of patterns. Alignments with many trees make many batches."""
    sizes = trees.groupBy("aln_id").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
    dealt = trees.join(sizes, "aln_id").withColumn("batch", F.pmod(F.xxhash64("parents"), F.col("batches")).cast("int"))
    copies = held.join(sizes, "aln_id").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    if "block" in keys:
        dealt = dealt.join(held.select("aln_id", "block"), "aln_id")
    keys = [*keys, "batch"]
    # both may come from one table: their columns get names of their own
    fresh = lambda df: df.drop("batches").select(*[F.col(c).alias(c) for c in df.columns if c != "batches"])
    return fresh(dealt).groupBy(*keys).cogroup(fresh(copies).groupBy(*keys)).applyInArrow(run, schema)


def score_trees(trees: DataFrame, patterns: DataFrame, size: int = BLOCK) -> DataFrame:
    """``length`` of each tree (aln_id, tree_id, parents): changes over all patterns, by weight."""

    def run(key, some, held):
        masks, weights = _matrix(held)
        ids = some.column("tree_id").to_pylist()
        lengths = [fitch.length(p, masks, weights) for p in some.column("parents").to_pylist()]
        return pa.table({"aln_id": [key[0].as_py()] * len(ids), "tree_id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int64())})

    part = _met(trees.select("aln_id", "tree_id", "parents"), blocks(patterns, size), ["aln_id", "block"], run, "aln_id string, tree_id long, length long")
    return part.groupBy("aln_id", "tree_id").agg(F.sum("length").alias("length"))


def edge_views(trees: DataFrame, patterns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Of each tree, block and edge: the sets ``down`` below it, ``up`` of all else, and ``mid`` between, a byte per pattern."""

    def run(key, some, held):
        masks, weights = _matrix(held)
        out: dict[str, list] = {c: [] for c in ("aln_id", "tree_id", "block", "edge", "down", "up", "mid")}
        for tree, parents in zip(some.column("tree_id").to_pylist(), some.column("parents").to_pylist()):
            down, up, _ = fitch.views(parents, masks[: newick.taxa(parents)], weights)
            for edge in range(1, len(parents)):
                mid = fitch.union(down[edge], up[edge])
                for name, value in zip(out, (key[0].as_py(), tree, key[1].as_py(), edge, down[edge].tobytes(), up[edge].tobytes(), mid.tobytes())):
                    out[name].append(value)
        return pa.table(out, schema=pa.schema([("aln_id", pa.string()), ("tree_id", pa.int64()), ("block", pa.int64()), ("edge", pa.int32()), ("down", pa.binary()), ("up", pa.binary()), ("mid", pa.binary())]))

    schema = "aln_id string, tree_id long, block long, edge int, down binary, up binary, mid binary"
    return _met(trees.select("aln_id", "tree_id", "parents"), blocks(patterns, size), ["aln_id", "block"], run, schema)


def placements(trees: DataFrame, patterns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Extra length ``cost`` of hanging every taxon that a tree lacks on each of its edges."""

    def run(key, some, held):
        masks, weights = _matrix(held)
        parts = []
        for tree, parents in zip(some.column("tree_id").to_pylist(), some.column("parents").to_pylist()):
            k = newick.taxa(parents)
            down, up, _ = fitch.views(parents, masks[:k], weights)
            for t in range(k, len(masks)):
                parts.append((tree, t, fitch.insertion_costs(down, up, masks[t], weights)[1:]))
        n = [len(c) for _, _, c in parts]
        repeat = lambda values, kind: pa.array(np.repeat(np.array(values, np.int64), n) if parts else [], kind)
        return pa.table(
            {
                "aln_id": pa.array([key[0].as_py()] * sum(n), pa.string()),
                "tree_id": repeat([p[0] for p in parts], pa.int64()),
                "taxon": repeat([p[1] for p in parts], pa.int64()),
                "edge": pa.array(np.concatenate([np.arange(1, x + 1) for x in n]) if parts else [], pa.int32()),
                "cost": pa.array(np.concatenate([p[2] for p in parts]) if parts else [], pa.int64()),
            }
        )

    part = _met(trees.select("aln_id", "tree_id", "parents"), blocks(patterns, size), ["aln_id", "block"], run, "aln_id string, tree_id long, taxon long, edge int, cost long")
    return part.groupBy("aln_id", "tree_id", "taxon", "edge").agg(F.sum("cost").alias("cost"))


def best_places(costs: DataFrame) -> DataFrame:
    """Of each tree and taxon: the cheapest edge, the first of equals, and the costs' mean, variance and rank among the taxa."""
    from pyspark.sql import window as W

    found = costs.groupBy("aln_id", "tree_id", "taxon").agg(
        F.min(F.struct("cost", "edge")).alias("best"), F.avg("cost").alias("mean_cost"), F.var_pop("cost").alias("var_cost")
    )
    rank = F.dense_rank().over(W.Window.partitionBy("aln_id", "tree_id").orderBy("best.cost"))
    return found.select("aln_id", "tree_id", "taxon", "best.edge", "best.cost", "mean_cost", "var_cost", rank.alias("place"))


def _per_alignment(patterns: DataFrame, run, schema: str) -> DataFrame:
    """Runs on all patterns of one alignment at a time."""
    return blocks(patterns).groupBy("aln_id").applyInArrow(run, schema)


def greedy_trees(patterns: DataFrame) -> DataFrame:
    """Stepwise trees in taxon order, each taxon on the cheapest edge."""

    def run(key, held):
        parents, size = fitch.greedy(*_matrix(held))
        return pa.table({"aln_id": [key[0].as_py()], "parents": pa.array([parents], pa.list_(pa.int32())), "length": [size]})

    return _per_alignment(patterns, run, "aln_id string, parents array<int>, length long")


def cheapest_next_trees(patterns: DataFrame) -> DataFrame:
    """Stepwise trees that always take the cheapest taxon and edge next; ``taxa`` is the order in which they came."""

    def run(key, held):
        order, parents, size = fitch.cheapest_next(*_matrix(held))
        lists = pa.list_(pa.int32())
        return pa.table({"aln_id": [key[0].as_py()], "taxa": pa.array([order], lists), "parents": pa.array([parents], lists), "length": [size]})

    return _per_alignment(patterns.filter(F.size("states") >= 3), run, "aln_id string, taxa array<int>, parents array<int>, length long")


def reconnections(trees: DataFrame, patterns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every tree that cutting one edge and joining the sides anywhere makes of a tree: the ``cut``, edge ``below`` of the lower and
    edge ``above`` of the upper side, and the ``gain``, the changes that it saves. The tree as it was is among them, with gain 0.

    Of a cut and a block of patterns, all edges of one side meet all of the other in a task, by the sets in their middles: no tree
    is built. Blocks add up."""
    cuts = trees.select("aln_id", "tree_id", "parents", F.explode(F.sequence(F.lit(1), F.size("parents") - 1)).alias("cut"))

    def run(key, some, held):
        masks, weights = _matrix(held)
        rows = sorted(zip(some.column("tree_id").to_pylist(), some.column("parents").to_pylist(), some.column("cut").to_pylist()))
        out: list[tuple] = []
        last, down = None, None
        for tree, parents, cut in rows:
            k = newick.taxa(parents)
            if (tree, parents) != last:
                last, down = (tree, parents), fitch.views(parents, masks[:k], weights, up=False)[0]
            lower, low, upper, high = fitch.cut_views(parents, cut, down, masks[:k])
            costs = fitch.reconnection_costs(low, high, weights)
            n = costs.size
            out.append((np.full(n, tree), np.full(n, cut), np.repeat(lower, len(upper)), np.tile(upper, len(lower)), (costs[0, 0] - costs).ravel()))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array([key[0].as_py()] * len(parts[0]), pa.string()), *(pa.array(x, k) for x, k in zip(parts, kinds))], names=["aln_id", "tree_id", "cut", "below", "above", "gain"])

    schema = "aln_id string, tree_id long, cut int, below int, above int, gain long"
    part = _met(cuts, blocks(patterns, size), ["aln_id", "block"], run, schema)
    return part.groupBy("aln_id", "tree_id", "cut", "below", "above").agg(F.sum("gain").alias("gain"))


def reconnected(parents: Column, cut: Column, below: Column, above: Column) -> Column:
    """The tree that a row of ``reconnections`` stands for."""

    @F.pandas_udf("array<int>")
    def joined(p: pd.Series, c: pd.Series, b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([fitch.reconnected([int(v) for v in w], int(x), int(y), int(z)) for w, x, y, z in zip(p, c, b, a)], dtype=object)

    return joined(parents, cut, below, above)


def bisections(trees: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of each tree (aln_id, tree_id, parents, length) and each edge above a node: the shortest tree of cutting that edge and joining the
    sides anywhere, of equals the first by its edges."""
    best = reconnections(trees, patterns).groupBy("aln_id", "tree_id", "cut").agg(F.min(F.struct((-F.col("gain")).alias("less"), "below", "above")).alias("best"))
    both = best.join(trees.select("aln_id", "tree_id", "parents", "length"), ["aln_id", "tree_id"])
    tree = reconnected(F.col("parents"), F.col("cut"), F.col("best.below"), F.col("best.above"))
    return both.select("aln_id", "tree_id", "cut", (F.col("length") + F.col("best.less")).alias("length"), tree.alias("parents"))


def improved_trees(trees: DataFrame, patterns: DataFrame) -> DataFrame:
    """Trees (aln_id, tree_id, parents, length) after taking the best reconnection while one is shorter. Lengths fall in every
    round, so that rounds end; a round stores one row for each tree that still gets shorter."""
    patterns = checkpointed(patterns.select("aln_id", "site", "states", "weight"))
    trees = checkpointed(trees.select("aln_id", "tree_id", "parents", "length"))
    done = trees.limit(0)
    while True:
        gains = reconnections(trees, patterns).filter("gain > 0")
        best = gains.groupBy("aln_id", "tree_id").agg(F.min(F.struct((-F.col("gain")).alias("less"), "cut", "below", "above")).alias("best"))
        both = checkpointed(trees.join(best, ["aln_id", "tree_id"], "left"))
        done = done.unionByName(both.filter("best is null").drop("best"))
        tree = reconnected(F.col("parents"), F.col("best.cut"), F.col("best.below"), F.col("best.above"))
        trees = both.filter("best is not null").select("aln_id", "tree_id", tree.alias("parents"), (F.col("length") + F.col("best.less")).alias("length"))
        if trees.isEmpty():
            return done


def _whole(patterns: DataFrame) -> DataFrame:
    row = F.array_sort(F.collect_list(F.struct("site", "states", "weight")))
    return patterns.groupBy("aln_id").agg(row.alias("row"))


def start_trees(patterns: DataFrame) -> DataFrame:
    """The tree of the first two taxa of each alignment."""
    cost = fitch_cost(F.element_at("states", 1), F.element_at("states", 2))
    root = F.array(F.lit(-1), F.lit(0))
    return patterns.groupBy("aln_id").agg(F.sum(F.col("weight") * cost).alias("score"), (F.max(F.size("states"))).alias("taxa")).withColumn("parents", root)


def search(patterns: DataFrame, upper: DataFrame | None = None, rest: DataFrame | None = None, wave: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All shortest trees of each alignment, and counters of every level.

    A level of the search is a table of trees with the first k taxa; each grows by the next taxon on every edge, and a
    tree is kept if its length and ``rest`` (aln_id, k, bound: what the taxa after rank k must still add) stay within
    ``upper`` (aln_id, upper). Without both, every tree is enumerated. Alignments of fewer than three taxa give none.

    With ``wave``, about so many trees grow at a time, those of most taxa first, so that the tables of trees stay bounded: whole trees
    come early, and the shortest of a wave is the upper bound of the next ones. Trees longer than that are then missing from the result.

    Counters are by ``level``: places ``tried``, trees ``kept`` of them and ``pruned``, whole trees (``full``), and those as short as the shortest
    (``ties``). What is pruned is not stored: a tree of k taxa has 2k - 3 edges, which tells how many were tried."""
    held = checkpointed(_whole(patterns.filter(F.size("states") >= 3)))
    first = checkpointed(start_trees(patterns).filter("taxa >= 3"))
    upper, rest = (None if x is None else checkpointed(x) for x in (upper, rest))
    if wave is not None and upper is None:
        upper = first.select("aln_id", F.lit((1 << 62) - 1).alias("upper"))

    def run(key, some, held):
        masks, weights = _matrix(held)
        # sums of these stay whole numbers, and products with doubles are fast
        doubles = weights.astype(np.float64)
        trees, scores = [], []
        for parents, score, most in zip(*(some.column(c).to_pylist() for c in ("parents", "score", "most"))):
            k = newick.taxa(parents)
            down, up, _ = fitch.views(parents, masks[:k], None)
            costs = (((fitch.union(down[1:], up[1:]) & masks[k]) == 0).astype(np.float64) @ doubles).astype(np.int64)
            for edge in (np.flatnonzero(costs <= most - score) + 1 if most is not None else range(1, k * 2 - 2)):
                trees.append(newick.insert(parents, int(edge)))
                scores.append(score + int(costs[edge - 1]))
        return pa.table({"aln_id": pa.array([key[0].as_py()] * len(trees), pa.string()), "score": pa.array(scores, pa.int64()), "taxa": pa.array([len(masks)] * len(trees), pa.int32()), "parents": pa.array(trees, pa.list_(pa.int32()))})

    finished, counters = first.limit(0), None
    # what is still to grow: trees of k taxa, their number of parts, the part that comes next, and alignments that fill a part alone
    stack = [(2, first, 1, 0, [])]
    while stack:
        k, table, parts, part, large = stack.pop()
        if part + 1 < parts:
            stack.append((k, table, parts, part + 1, large))
        # an alignment is in one part, so that its patterns are read once, unless its trees are many
        dealt = F.when(F.col("aln_id").isin(large), F.xxhash64("aln_id", "parents")).otherwise(F.xxhash64("aln_id"))
        level = table if parts == 1 else table.filter(F.pmod(dealt, F.lit(parts)) == part)
        level = level.filter(F.col("taxa") > k)
        if upper is None:
            limited = level.withColumn("most", F.lit(None).cast("long"))
        else:
            limit = upper.select("aln_id", "upper")
            if rest is not None:
                limit = limit.join(rest.filter(F.col("k") == k).select("aln_id", "bound"), "aln_id", "left")
            most = F.col("upper") - (F.coalesce("bound", F.lit(0)) if rest is not None else F.lit(0))
            limited = level.join(limit.select("aln_id", most.alias("most")), "aln_id")
        grown = _met(limited.select("aln_id", "score", "taxa", "parents", "most"), held, ["aln_id"], run, "aln_id string, score long, taxa int, parents array<int>")
        grown = checkpointed(grown)
        counted = level.groupBy("aln_id").agg((F.count("*") * (2 * k - 3 if k > 2 else 1)).alias("tried"))
        counted = counted.join(grown.groupBy("aln_id").agg(F.count("*").alias("kept"), F.count_if(F.col("taxa") == k + 1).alias("full")), "aln_id", "left")
        counted = counted.select("aln_id", F.lit(k + 1).alias("level"), "tried", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("full", F.lit(0)).alias("full"))
        if wave is None:
            counters = counted if counters is None else counters.unionByName(counted)
        else:
            counters = checkpointed(counted if counters is None else counters.unionByName(counted).groupBy("aln_id", "level").agg(*[F.sum(c).alias(c) for c in ("tried", "kept", "full")]))
        sizes = {r["whole"]: r["n"] for r in grown.groupBy((F.col("taxa") == k + 1).alias("whole")).agg(F.count("*").alias("n")).collect()}
        if True in sizes:
            done = grown.filter(F.col("taxa") == k + 1).select(finished.columns)
            finished = finished.unionByName(done)
            if wave is not None:
                least = done.groupBy("aln_id").agg(F.min("score").alias("least"))
                upper = checkpointed(upper.join(least, "aln_id", "left").select("aln_id", F.least("upper", "least").alias("upper")))
                finished = checkpointed(finished.join(upper, "aln_id").filter("score <= upper").drop("upper"))
        if False in sizes:
            parts = -(-sizes[False] // wave) if wave else 1
            # fewer than there are parts
            many = grown.filter(F.col("taxa") > k + 1).groupBy("aln_id").agg(F.count("*").alias("n")).filter(F.col("n") > wave) if parts > 1 else None
            stack.append((k + 1, grown, parts, 0, [] if many is None else [r["aln_id"] for r in many.collect()]))
    if counters is None:
        return finished.select("aln_id", "parents", "score"), patterns.sparkSession.createDataFrame([], "aln_id string, level int, tried long, kept long, pruned long, full long, ties long")
    best = finished.groupBy("aln_id").agg(F.min("score").alias("score"))
    ties = finished.join(best, ["aln_id", "score"]).groupBy("aln_id").agg(F.count("*").alias("ties"))
    told = counters.join(ties, "aln_id", "left").withColumn("ties", F.when(F.col("full") > 0, F.col("ties")).otherwise(F.lit(0)))
    return finished.select("aln_id", "parents", "score"), told.select("aln_id", "level", "tried", "kept", (F.col("tried") - F.col("kept")).alias("pruned"), "full", "ties")


def shortest(trees: DataFrame, most: int | None = None) -> DataFrame:
    """Trees of the least ``score`` of each alignment, at most ``most`` of them, and whether some were left out (``missed``)."""
    from pyspark.sql import window as W

    best = trees.groupBy("aln_id").agg(F.min("score").alias("score"))
    ties = trees.join(best, ["aln_id", "score"])
    if most is None:
        return ties.withColumn("missed", F.lit(False))
    n = F.count("*").over(W.Window.partitionBy("aln_id"))
    rank = F.row_number().over(W.Window.partitionBy("aln_id").orderBy("parents"))
    return ties.withColumn("missed", n > most).withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def node_table(trees: DataFrame) -> DataFrame:
    """A row per node: its parent and its taxon, null for inner nodes."""
    nodes = trees.select(*[c for c in trees.columns if c != "parents"], F.posexplode("parents").alias("node", "parent"))
    taxon = F.when(F.col("node") < 2, F.col("node")).when(F.col("node") % 2 == 0, (F.col("node") / 2).cast("int") + 1)
    return nodes.withColumn("taxon", taxon)


def structure_faults(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of a node table that have a wrong number of children, or a parent that is no node."""
    below = nodes.filter("parent >= 0").groupBy(*keys, F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    both = nodes.join(below, [*keys, "node"], "full")
    expected = F.when(F.col("node") == 0, 1).when(F.col("taxon").isNotNull(), 0).otherwise(2)
    n = F.coalesce("n_children", F.lit(0))
    return both.filter(F.col("parent").isNull() | (n != expected)).select(*keys, "node", n.alias("n_children"))


def newick_text(parents: Column) -> Column:
    """Canonical Newick text, taxa counted from 1."""
    @F.pandas_udf("string")
    def told(x: pd.Series) -> pd.Series:
        return x.map(lambda p: newick.to_newick([int(v) for v in p]))

    return told(parents)


def parsed_trees(texts: DataFrame) -> DataFrame:
    """``parents`` of Newick text (columns ``newick`` and ``labels``, an array of the taxa's names); with text that is no tree of
    these taxa, null and an ``error``."""

    def run(batches):
        for batch in batches:
            trees, errors = [], []
            for text, labels in zip(batch.column("newick").to_pylist(), batch.column("labels").to_pylist()):
                try:
                    trees.append(newick.from_newick(text or "", {name: i for i, name in enumerate(labels)}))
                    errors.append(None)
                except ValueError as error:
                    trees.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.list_(pa.int32())), pa.array(errors, pa.string())], names=[*batch.schema.names, "parents", "error"])

    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema, T.StructField("parents", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())])
    return texts.mapInArrow(run, schema)


def joined_neighbours(distances: DataFrame, adjusted: bool = True) -> DataFrame:
    """Neighbour-joining trees (``newick``, taxa from 1) of each alignment's ``distances`` (aln_id, i, j, dist).

    ``adjusted``: a joined pair is as far from another as the farther of the two, instead of their mean."""

    def run(key, held):
        i, j, d = (held.column(c).to_numpy() for c in ("i", "j", "dist"))
        n = int(max(j.max(), i.max())) + 1
        matrix = np.zeros((n, n))
        matrix[i, j] = matrix[j, i] = d
        text = fitch.neighbour_joining(matrix, adjusted)
        return pa.table({"aln_id": [key[0].as_py()], "newick": [text]})

    return distances.select("aln_id", "i", "j", "dist").groupBy("aln_id").applyInArrow(run, "aln_id string, newick string")


def look_ahead(costs: DataFrame, newly: DataFrame) -> DataFrame:
    """Of each tree: the most that some absent taxon still adds, its cheapest place less the states it is the first to show
    (aln_id, taxon, n_new)."""
    least = costs.groupBy("aln_id", "tree_id", "taxon").agg(F.min("cost").alias("cost"))
    left = least.join(newly.select("aln_id", "taxon", "n_new"), ["aln_id", "taxon"])
    return left.groupBy("aln_id", "tree_id").agg(F.max(F.col("cost") - F.col("n_new")).alias("bound"))
