"""Bases as bit masks, and the set step of parsimony, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of nucleotide sets; bit 1 is A, 2 is C, 4 is G, 8 is T. Gaps and unknowns are all four.
LETTER_MASKS = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8,
    "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12,
    "V": 7, "H": 11, "D": 13, "B": 14,
    "N": 15, "?": 15, "-": 15,
}
MASK_LETTERS = "ACMGRSVTWYHKDBN"  # of masks 1 to 15
BASES = (1, 2, 4, 8)


def mask_of_letter(letter: Column) -> Column:
    """Mask of a letter in either case; null for any other character."""
    table = F.create_map(*[F.lit(x) for kv in LETTER_MASKS.items() for x in kv])
    return F.try_element_at(table, F.upper(letter))


def letter_of_mask(mask: Column) -> Column:
    return F.when(mask.between(1, 15), F.substring(F.lit(MASK_LETTERS), mask, F.lit(1)))


def code_of_letter(letter: Column) -> Column:
    """0 to 3 for A, C, G and T; null for all else."""
    mask = mask_of_letter(letter)
    return F.when(F.bit_count(mask) == 1, F.bit_count(mask - 1))


def fitch_union(a: Column, b: Column) -> Column:
    """What two sets share, or all they hold if they share nothing."""
    both = a.bitwiseAND(b)
    return F.when(both != 0, both).otherwise(a.bitwiseOR(b))


def fitch_cost(a: Column, b: Column) -> Column:
    return (a.bitwiseAND(b) == 0).cast("long")


def spread_bits(subset: Column, into: Column) -> Column:
    """Puts the bits of ``subset`` on the places of the set bits of ``into``, from the lowest."""
    def step(acc: Column, k: Column) -> Column:
        there = _bit(into, k) != 0
        out = acc["out"] + F.when(there & (_bit(subset, acc["used"]) != 0), _bit_value(k)).otherwise(F.lit(0).cast("long"))
        return F.struct(out.alias("out"), (acc["used"] + there.cast("int")).alias("used"))

    start = F.struct(F.lit(0).cast("long").alias("out"), F.lit(0).alias("used"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step)["out"]


def _bit_value(place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), place + 1)


def _bit(value: Column, place: Column) -> Column:
    return value.cast("long").bitwiseAND(_bit_value(place))


def tree_count(on_tree: Column, total: Column) -> Column:
    """Unrooted binary trees that grow from one of ``on_tree`` taxa to ``total``: the product of 2i - 3."""
    steps = F.when(on_tree < total, F.sequence(on_tree, total - 1)).otherwise(F.array().cast("array<int>"))
    one = F.lit(1).cast("decimal(38,0)")
    return F.aggregate(steps, one, lambda acc, i: (acc * (2 * i - 3).cast("decimal(9,0)")).cast("decimal(38,0)"))


def part_score(strategy: str, lower: Column, upper: Column, additive: Column) -> Column:
    """Score of a part of a site partition by ``strategy``: ``additive``, ``clipped`` or ``lower``."""
    if strategy == "additive":
        return F.greatest(additive, lower - upper)
    if strategy == "clipped":
        return F.greatest(F.lit(0).cast("long"), lower - upper)
    if strategy == "lower":
        return lower
    raise ValueError(f"unknown strategy {strategy}")
