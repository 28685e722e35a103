"""Alignments, trees, bounds and graphs as text files, and the datasets that are cut from one alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.dna import letter_of_mask
from cladeflow.operators import prefixes


def prefix_datasets(sequences: DataFrame) -> DataFrame:
    """For each alignment and each ``k`` from 3 to its taxa: the sequences of its first ``k`` taxa."""
    sizes = sequences.groupBy("aln_id").agg(F.max("taxon").alias("last"))
    counted = sequences.join(sizes, "aln_id").filter("last >= 2")
    return counted.withColumn("k", F.explode(F.sequence(F.greatest(F.col("taxon") + 1, F.lit(3).cast("long")), F.col("last") + 1))).drop("last")


def uninformative_prefixes(cells: DataFrame) -> DataFrame:
    """For each ``k`` from 3 to one less than the taxa: the sites that are informative, but not on the first ``k`` taxa."""
    sizes = cells.groupBy("aln_id").agg(F.max("taxon").alias("last"))
    found = prefixes.onsets(cells).filter("onset > 3").join(sizes, "aln_id")
    return found.select("aln_id", "site", F.explode(F.sequence(F.lit(3).cast("long"), F.least(F.col("onset") - 1, F.col("last")))).alias("k"))


def uninformative_columns(cells: DataFrame) -> DataFrame:
    """For each ``k`` the whole columns of the sites of ``uninformative_prefixes``, as the sequence of each taxon."""
    found = cells.join(uninformative_prefixes(cells), ["aln_id", "site"])
    row = F.array_sort(F.collect_list(F.struct("site", "mask")))
    rows = found.groupBy("aln_id", "k", "taxon").agg(row.alias("row"))
    return rows.select("aln_id", "k", "taxon", F.array_join(F.transform("row", lambda c: letter_of_mask(c["mask"])), "").alias("seq"))


def phylip_lines(found: DataFrame, labels: DataFrame | None = None, repeat: bool = True) -> DataFrame:
    """``aln_id``, ``line_no`` and ``line`` of PHYLIP files of weighted patterns (aln_id, site, states, weight).

    With ``repeat`` each column is written ``weight`` times; without, once, and a line of weights follows. Labels come from
    ``labels`` (aln_id, taxon, label), else ``T`` and the taxon counted from 1."""
    times = F.col("weight").cast("int") if repeat else F.lit(1)
    cells = found.select("aln_id", "site", "weight", F.posexplode("states").alias("taxon", "mask"))
    piece = F.struct("site", F.repeat(letter_of_mask(F.col("mask")), times).alias("piece"))
    rows = cells.groupBy("aln_id", "taxon").agg(F.array_sort(F.collect_list(piece)).alias("row"))
    rows = rows.select("aln_id", F.col("taxon").cast("long").alias("taxon"), F.array_join(F.col("row.piece"), "").alias("seq"))
    own = F.concat(F.lit("T"), (F.col("taxon") + 1).cast("string"))
    rows = rows.join(labels, ["aln_id", "taxon"], "left") if labels is not None else rows.withColumn("label", F.lit(None).cast("string"))
    body = rows.select("aln_id", (F.col("taxon") + 1).alias("line_no"), F.concat(F.rpad(F.coalesce("label", own), 10, " "), "seq").alias("line"))
    head = rows.groupBy("aln_id").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("s"))
    head = head.select("aln_id", F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "n", "s").alias("line"))
    if repeat:
        return head.unionByName(body)
    weights = found.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("site", "weight"))).alias("row"), F.max(F.size("states")).alias("n"))
    line = F.array_join(F.transform("row", lambda x: x["weight"].cast("string")), " ")
    return head.unionByName(body).unionByName(weights.select("aln_id", (F.col("n") + 1).cast("long").alias("line_no"), line.alias("line")))


def write_lines(lines: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One folder of text per alignment (and other keys), its lines in order within one file."""
    by = by or ["aln_id"]
    lines.repartition(*by).sortWithinPartitions(*by, "line_no").select(*by, "line").write.partitionBy(*by).text(path)


def nexus_lines(trees: DataFrame, labels: DataFrame) -> DataFrame:
    """NEXUS blocks of scored trees (aln_id, tree_id, newick with taxa counted from 1, score), with a table of labels."""
    at = lambda n: F.lit(n).cast("long")
    trees = trees.withColumn("nr", F.row_number().over(_in_order("tree_id")).cast("long"))
    head = trees.groupBy("aln_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    opening = head.select("aln_id", at(0).alias("part"), at(0).alias("line_no"), F.concat(F.lit("#NEXUS\n[!"), F.col("n").cast("string"), F.lit(" trees of length "), F.col("score").cast("string"), F.lit("]\nBEGIN TREES;\n\tTRANSLATE")).alias("line"))
    last = labels.groupBy("aln_id").agg(F.max("taxon").alias("last"))
    names = labels.join(last, "aln_id").select("aln_id", at(1).alias("part"), F.col("taxon").alias("line_no"), F.concat(F.lit("\t\t"), (F.col("taxon") + 1).cast("string"), F.lit(" "), "label", F.when(F.col("taxon") == F.col("last"), "").otherwise(",")).alias("line"))
    names = names.join(head.select("aln_id"), "aln_id", "left_semi")
    semicolon = head.select("aln_id", at(2).alias("part"), at(0).alias("line_no"), F.lit("\t\t;").alias("line"))
    body = trees.select("aln_id", at(3).alias("part"), F.col("nr").alias("line_no"), F.concat(F.lit("TREE T_"), F.col("nr").cast("string"), F.lit(" = [&U] "), "newick", F.lit(";")).alias("line"))
    end = head.select("aln_id", at(4).alias("part"), at(0).alias("line_no"), F.lit("END;").alias("line"))
    every = opening.unionByName(names).unionByName(semicolon).unionByName(body).unionByName(end)
    return every.withColumn("line_no", F.row_number().over(_in_order("part", "line_no")).cast("long")).drop("part")


def _in_order(*keys: str):
    from pyspark.sql import window as W

    return W.Window.partitionBy("aln_id").orderBy(*keys)


def dimacs_lines(pairs: DataFrame, n_sites: DataFrame) -> DataFrame:
    """Graphs of incompatible site pairs (aln_id, p, q, onset) for each tree size ``k``: an edge per pair with onset above ``k``.

    ``n_sites`` has aln_id, sites and taxa. Sites are counted from 1."""
    edges = pairs.join(n_sites, "aln_id").filter("onset > 3")
    edges = edges.withColumn("k", F.explode(F.sequence(F.lit(3).cast("long"), F.col("onset").cast("long") - 1)))
    body = edges.select("aln_id", "k", F.row_number().over(_by_k()).cast("long").alias("line_no"), F.format_string("e %d %d", F.col("p") + 1, F.col("q") + 1).alias("line"))
    head = edges.groupBy("aln_id", "k").agg(F.count("*").alias("n"), F.max("sites").alias("sites"))
    return head.select("aln_id", "k", F.lit(0).cast("long").alias("line_no"), F.format_string("p clq %d %d", "n", "sites").alias("line")).unionByName(body)


def _by_k():
    from pyspark.sql import window as W

    return W.Window.partitionBy("aln_id", "k").orderBy("p", "q")


# fixed values: the header of a file of rest bounds
BOUND_HEADER = ("i", "Min weight added by taxa i+1, i+2, ..., n-1.")


def write_bounds(bounds: DataFrame, path: str) -> None:
    """Rest bounds as tab-separated text with a header, a folder per alignment, from k = 2 on."""
    rows = bounds.filter("k >= 2").select("aln_id", F.col("k").alias(BOUND_HEADER[0]), F.col("bound").alias(BOUND_HEADER[1]))
    rows.repartition("aln_id").sortWithinPartitions("aln_id", "i").write.partitionBy("aln_id").csv(path, sep="\t", header=True)


def read_bounds(spark, path: str) -> DataFrame:
    """Rest bounds of a folder that ``write_bounds`` wrote; the first column is k, the second the bound, whatever the header says."""
    schema = "k long, bound long, aln_id string"
    return spark.read.csv(path, sep="\t", header=True, schema=schema).select("aln_id", "k", "bound")


def part_statistics(parts: DataFrame) -> DataFrame:
    """Bounds and scores of each part and, in the row without a part, of its alignment (aln_id, part_id, width, lower, upper, additive, final)."""
    rows = parts.rollup("aln_id", "part_id").agg(
        *[F.sum(c).alias(c) for c in ("lower", "upper", "additive", "final")], F.min("width").alias("narrowest"), F.max("width").alias("widest"), F.avg("width").alias("mean_width")
    )
    return rows.filter("aln_id is not null")


def partition_lines(cells: DataFrame, part: Column) -> DataFrame:
    """A line for each taxon: its letters part by part, with a bar between parts."""
    row = F.array_sort(F.collect_list(F.struct("site", "mask")))
    parts = cells.groupBy("aln_id", "taxon", part.alias("part_id")).agg(row.alias("row"))
    parts = parts.select("aln_id", "taxon", F.struct("part_id", F.array_join(F.transform("row", lambda c: letter_of_mask(c["mask"])), "").alias("text")).alias("part"))
    lines = parts.groupBy("aln_id", "taxon").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return lines.select("aln_id", "taxon", F.array_join("parts.text", "|").alias("line"))


def partition_totals(parts: DataFrame) -> DataFrame:
    """Of the parts of each alignment (aln_id, part_id, width, lower, upper, additive, final): their number and width, the totals with raw
    scores (lower less upper) as they are and cut off at 0, and the first of the narrowest and of the widest parts."""
    raw = F.col("lower") - F.col("upper")
    found = parts.groupBy("aln_id").agg(
        F.count("*").alias("n_parts"), F.sum("width").alias("width"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper"), F.sum(raw).alias("raw"), F.sum(F.greatest(raw, F.lit(0))).alias("clipped"),
        F.sum("additive").alias("additive"), F.sum("final").alias("final"), F.min(F.struct("width", "part_id")).alias("low"), F.min(F.struct((-F.col("width")).alias("less"), "part_id")).alias("high"),
    )
    return found.select("aln_id", "n_parts", "width", "lower", "upper", "raw", "clipped", "additive", "final", F.col("low.part_id").alias("narrowest"), F.col("high.part_id").alias("widest"))
