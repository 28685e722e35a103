"""Alignments made from tables that hold no sequences: long tables ``aln_id``, ``site``, ``taxon``, ``mask``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

QUARTILES = (-0.085, 0.0, 0.085)
UNEVEN = (-0.2, 0.15, 0.2)
EVENT_MASKS = {"click": 1, "purchase": 2, "signup": 4, "view": 8, "error": 15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(x: Column, cuts: tuple[float, float, float]) -> Column:
    return F.when(x < cuts[0], 1).when(x < cuts[1], 2).when(x < cuts[2], 4).otherwise(8)


def from_embeddings(spark: SparkSession, sf_dir: str, cuts: tuple[float, float, float] = QUARTILES, chunk: int | None = None) -> DataFrame:
    """A taxon per vector, a site per component, an alignment per label; with ``chunk``, alignments of so many
    vectors of a label each, in the order of their ids."""
    rank = F.row_number().over(W.Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    vectors = table(spark, sf_dir, "embeddings").select("label", "embedding", rank.alias("rank"))
    name, taxon = F.col("label").cast("string"), F.col("rank")
    if chunk:
        name = F.concat_ws("-", name, F.floor(F.col("rank") / chunk).cast("string"))
        taxon = F.col("rank") % chunk
    cells = vectors.select(name.alias("aln_id"), taxon.alias("taxon"), F.posexplode("embedding").alias("site", "x"))
    return cells.select("aln_id", F.col("site").cast("long").alias("site"), "taxon", _state(F.col("x").cast("double"), cuts).cast("int").alias("mask"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxon per user, a site per day of the month, three alignments; a day without events is unknown (15)."""
    events = table(spark, sf_dir, "events")
    known = F.coalesce(*[F.when(F.col("event_type") == k, m) for k, m in EVENT_MASKS.items()])
    seen = events.groupBy((F.col("user_id") % 3).cast("string").alias("aln_id"), F.dayofmonth("ts").cast("long").alias("site"), F.col("user_id").alias("taxon"))
    seen = seen.agg(F.bit_or(known.cast("int")).alias("mask"))
    sites, taxa = seen.select("aln_id", "site").distinct(), seen.select("aln_id", "taxon").distinct()
    # every cell of a small rectangle: users times days of a month
    grid = sites.join(taxa, "aln_id")
    return grid.join(seen, ["aln_id", "site", "taxon"], "left").select("aln_id", "site", "taxon", F.coalesce("mask", F.lit(15)).cast("int").alias("mask"))


def sequences_from_documents(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    """All of ``letters`` in each whole text, in either case, as a sequence; an alignment per language, whose sequences
    differ in length. Texts without such a letter give none."""
    lower = "".join(c for c in letters.lower() if c.isalpha())
    found = F.upper(F.regexp_replace("text", f"[^{lower}{letters}]", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("aln_id"), found.alias("seq")).filter("seq <> ''")
    return docs.select("aln_id", F.col("doc_id").alias("taxon"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"), "seq")


def symbols_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic characters: a taxon per supplier, a site per part, the symbols are flag and status."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("li").alias("aln_id"),
        F.col("l_partkey").cast("long").alias("site"),
        F.col("l_suppkey").cast("long").alias("taxon"),
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
    )
