"""What the first taxa of an order already show: running unions, onset of informativeness, suffix bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.functions.dna import BASES


def _by_site() -> W.WindowSpec:
    return W.Window.partitionBy("aln_id", "site").orderBy("taxon")


def seen_before(cells: DataFrame, inclusive: bool = False) -> DataFrame:
    """Adds ``seen``: the union of a site's states over all taxa before this one, or up to it."""
    frame = _by_site().rowsBetween(W.Window.unboundedPreceding, 0 if inclusive else -1)
    return cells.withColumn("seen", F.coalesce(F.bit_or("mask").over(frame), F.lit(0)))


def newly_shown(cells: DataFrame) -> DataFrame:
    """Of each taxon: sites whose state is disjoint from all before it (``n_new``), and sites that show some base
    never seen before (``n_additive``)."""
    seen = seen_before(cells)
    new = F.col("mask").bitwiseAND(F.col("seen")) == 0
    extra = F.col("mask").bitwiseAND(F.bitwise_not("seen")) != 0
    return seen.groupBy("aln_id", "taxon").agg(F.count_if(new).alias("n_new"), F.count_if(extra).alias("n_additive"))


def additive_scores(cells: DataFrame, part: Column, k: int) -> DataFrame:
    """Of each part of the sites: cells of taxa from rank ``k`` on that show a base not seen at any lower rank."""
    seen = seen_before(cells)
    extra = (F.col("taxon") >= k) & (F.col("mask").bitwiseAND(F.bitwise_not("seen")) != 0)
    return seen.groupBy("aln_id", part.alias("part_id")).agg(F.count_if(extra).alias("additive"))


def running_informative(cells: DataFrame) -> DataFrame:
    """Adds ``forced``: the forced weight of the site on the taxa so far, null where it is informative on them."""
    frame = _by_site().rowsBetween(W.Window.unboundedPreceding, 0)
    costs = []
    for base in BASES:
        lacks = F.col("mask").bitwiseAND(F.lit(base)) == 0
        own = F.when(lacks, F.col("mask")).otherwise(F.lit(0))
        total = F.sum(F.bit_count(own)).over(frame)
        union = F.bit_or(own).over(frame)
        costs.append(F.when(total == F.bit_count(union), F.sum(lacks.cast("long")).over(frame)))
    return cells.withColumn("forced", F.least(*costs))


def onsets(cells: DataFrame) -> DataFrame:
    """``onset`` of each site: the fewest first taxa on which it is informative; null if it is not on all."""
    return running_informative(cells).groupBy("aln_id", "site").agg(F.min(F.when(F.col("forced").isNull(), F.col("taxon") + 1)).alias("onset"))


def levels(cells: DataFrame) -> DataFrame:
    """For each number ``k`` of first taxa: informative sites, and forced weight of all others."""
    found = running_informative(cells).groupBy("aln_id", (F.col("taxon") + 1).alias("k"))
    return found.agg(F.count_if(F.col("forced").isNull()).alias("n_informative"), F.coalesce(F.sum("forced"), F.lit(0)).alias("fixed_length"))


def rest_bound(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``bound`` at ``k``: weight of unambiguous sites' bases that taxa after rank ``k`` are the first to show.

    ``weights`` (aln_id, site, weight) counts sites other than once."""
    clear = cells.groupBy("aln_id", "site").agg(F.max(F.bit_count("mask")).alias("most")).filter("most = 1")
    first = cells.join(clear.select("aln_id", "site"), ["aln_id", "site"], "left_semi").groupBy("aln_id", "site", "mask").agg(F.min("taxon").alias("first"))
    first = first.join(weights, ["aln_id", "site"]) if weights is not None else first.withColumn("weight", F.lit(1).cast("long"))
    shown = first.groupBy("aln_id", F.col("first").alias("k")).agg(F.sum("weight").alias("shown"))
    spine = cells.select("aln_id", F.col("taxon").alias("k")).distinct()
    after = W.Window.partitionBy("aln_id").orderBy(F.desc("k")).rowsBetween(W.Window.unboundedPreceding, -1)
    return spine.join(shown, ["aln_id", "k"], "left").select("aln_id", "k", F.coalesce(F.sum("shown").over(after), F.lit(0)).alias("bound"))


def held_for_fewer(bounds: DataFrame) -> DataFrame:
    """A bound for more taxa also holds for fewer: the running maximum from the right."""
    right = W.Window.partitionBy("aln_id").orderBy(F.desc("k")).rowsBetween(W.Window.unboundedPreceding, 0)
    return bounds.withColumn("bound", F.max("bound").over(right))
