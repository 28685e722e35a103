"""Sites of alignments: columns of states, canonical recoding, weighted patterns, and what each site tells.

A site is kept as one row with the array of its states in taxon order; what is asked of a site is then an expression
on the array, and only gathering the array and collapsing equal arrays shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.functions.dna import BASES, letter_of_mask, mask_of_letter


def cells_from_sequences(sequences: DataFrame) -> DataFrame:
    """A row per letter; an invalid letter has a null mask."""
    letters = sequences.select("aln_id", "taxon", F.posexplode(F.split("seq", "")).alias("site", "letter"))
    return letters.select("aln_id", F.col("site").cast("long").alias("site"), "taxon", mask_of_letter(F.col("letter")).alias("mask"))


def sequences_from_cells(cells: DataFrame) -> DataFrame:
    row = F.array_sort(F.collect_list(F.struct("site", "mask")))
    rows = cells.groupBy("aln_id", "taxon").agg(row.alias("row"))
    return rows.select("aln_id", "taxon", F.array_join(F.transform("row", lambda c: letter_of_mask(c["mask"])), "").alias("seq"))


def columns(cells: DataFrame) -> DataFrame:
    """``aln_id``, ``site``, ``states``: the masks of a site in taxon order."""
    row = F.array_sort(F.collect_list(F.struct("taxon", "mask")))
    sites = cells.groupBy("aln_id", "site").agg(row.alias("row"))
    return sites.select("aln_id", "site", F.transform("row", lambda c: c["mask"]).alias("states"))


def cells_from_columns(sites: DataFrame) -> DataFrame:
    out = sites.select("aln_id", "site", F.posexplode("states").alias("taxon", "mask"))
    return out.withColumn("taxon", F.col("taxon").cast("long"))


def site_range(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Sites ``first`` to ``last``, counted from 1, both included."""
    return cells.filter(F.col("site").between(first - 1, last - 1))


def without_ambiguous(sites: DataFrame) -> DataFrame:
    """Sites in which every state is one base."""
    return sites.filter(F.forall("states", lambda m: F.bit_count(m) == 1))


def recoded(sites: DataFrame, bits: int = 4) -> DataFrame:
    """Bases of a site are numbered by the first taxon that shows them, at equal taxa by their bit; the states are
    written with the new numbers, so that columns equal but for the names of their bases become equal."""
    values = [1 << b for b in range(bits)]
    old = F.array(*[F.lit(v) for v in values])

    def renamed(shown: Column) -> Column:
        """The new bit of each base, by the places where they are first shown."""
        before = lambda o, b: (shown[o] > 0) & ((shown[o] < shown[b]) | ((shown[o] == shown[b]) & F.lit(o < b)))
        ranks = [sum(before(o, b).cast("int") for o in range(bits) if o != b) for b in range(bits)]
        return F.array(*[F.element_at(old, r + 1) for r in ranks])

    def written(new: Column) -> Column:
        bits_of = lambda m: F.zip_with(old, new, lambda o, n: F.when(m.bitwiseAND(o) != 0, n).otherwise(0))
        return F.transform("states", lambda m: F.aggregate(bits_of(m), F.lit(0), lambda a, x: a + x))

    return sites.withColumn("states", _once(_once(F.array(*[_first(v) for v in values]), renamed), written))


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for a row, however often and deep it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _first(value: int) -> Column:
    """1-based place of the first state that holds a bit; 0 if none does."""
    return F.array_position(F.transform("states", lambda m: m.bitwiseAND(F.lit(value)) != 0), True)


def recoded_symbols(symbols: DataFrame) -> DataFrame:
    """Cells of generic characters: the symbols of a site are numbered by the first taxon that shows them, then by name;
    a cell holds the bits of all its symbols. Sites of more than 31 symbols have null masks."""
    site = ["aln_id", "site"]
    first = symbols.groupBy(*site, "symbol").agg(F.min("taxon").alias("first"))
    number = F.row_number().over(W.Window.partitionBy(*site).orderBy("first", "symbol")) - 1
    told = first.select(*site, "symbol", number.alias("number"), F.count("*").over(W.Window.partitionBy(*site)).alias("many"))
    coded = told.select(*site, "symbol", F.when(F.col("many") < 32, F.expr("shiftleft(1, number)")).alias("bit"))
    return symbols.join(coded, [*site, "symbol"]).groupBy(*site, "taxon").agg(F.bit_or("bit").alias("mask"))


def patterns(sites: DataFrame, prefix: int | None = None) -> DataFrame:
    """Equal columns collapsed to ``states``, ``weight`` and the least ``site``; by the first ``prefix`` taxa alone if given."""
    key = F.slice("states", 1, prefix) if prefix else F.col("states")
    return sites.groupBy("aln_id", key.alias("states")).agg(F.count("*").alias("weight"), F.min("site").alias("site"))


def is_constant(states: str = "states") -> Column:
    """All states share a base."""
    return F.aggregate(states, F.lit(15), lambda a, m: a.bitwiseAND(m)) != 0


def forced_weight(states: str = "states") -> Column:
    """Changes that an uninformative site needs on every tree; null for an informative site.

    With some base for which the states that lack it are pairwise disjoint, each of those states is a change of its
    own; states are disjoint when their bit counts add up to that of their union. The least such number counts.
    """
    costs = []
    for base in BASES:
        lacking = F.filter(states, lambda m: m.bitwiseAND(F.lit(base)) == 0)
        total = F.aggregate(lacking, F.lit(0), lambda a, m: a + F.bit_count(m))
        union = F.aggregate(lacking, F.lit(0), lambda a, m: a.bitwiseOR(m))
        costs.append(F.when(total == F.bit_count(union), F.size(lacking)))
    return F.least(*costs).cast("long")


def site_lower_bound(states: str = "states") -> Column:
    """Distinct unambiguous bases, less one."""
    bases = F.array_distinct(F.filter(states, lambda m: F.bit_count(m) == 1))
    return F.greatest(F.size(bases) - 1, F.lit(0)).cast("long")


def site_upper_bound(states: str = "states") -> Column:
    """Taxa less the most that hold one base: a star around that base."""
    holding = [F.size(F.filter(states, lambda m: m.bitwiseAND(F.lit(b)) != 0)) for b in BASES]
    return (F.size(states) - F.greatest(*holding)).cast("long")


def informative_patterns(found: DataFrame) -> DataFrame:
    return found.filter(forced_weight().isNull())


def site_summary(found: DataFrame) -> DataFrame:
    """Of each alignment: constant and uninformative sites, the latter's forced weight, informative sites and patterns."""
    told = found.select("aln_id", "weight", is_constant().alias("constant"), forced_weight().alias("forced"))
    kind = lambda c, x="weight": F.coalesce(F.sum(F.when(c, F.expr(x))), F.lit(0)).cast("long")
    rest = F.col("forced").isNotNull() & ~F.col("constant")
    informative = F.col("forced").isNull()
    return told.groupBy("aln_id").agg(
        kind(F.col("constant")).alias("n_const"),
        kind(rest).alias("n_nonpi"),
        kind(rest, "weight * forced").alias("nonpi_weight"),
        kind(informative).alias("n_pi"),
        F.count(F.when(informative, 1)).alias("n_patterns"),
    )


def ranked_patterns(found: DataFrame) -> DataFrame:
    """Patterns numbered by weight from the largest, at equal weights by states."""
    by = W.Window.partitionBy("aln_id").orderBy(F.desc("weight"), "states")
    return found.withColumn("pattern_id", F.row_number().over(by).cast("long") - 1)


def enough_taxa(cells: DataFrame, least: int = 4) -> DataFrame:
    """Cells of alignments with at least ``least`` taxa: a tree of fewer has one shape."""
    sizes = cells.groupBy("aln_id").agg(F.countDistinct("taxon").alias("n")).filter(F.col("n") >= least)
    return cells.join(sizes.select("aln_id"), "aln_id", "left_semi")
