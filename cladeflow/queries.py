"""Registered queries of the alignment operators, and the SQL that they equal. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow import bound_sql
from cladeflow.functions import dna
from cladeflow.operators import bounds, growing, pairs, prefixes, sites, trees
from cladeflow.plans.storage import checkpointed, scratch
from cladeflow.sources import phylip, tables, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def states_text(states: str = "states"):
    """An array of states as text, for results that both engines write alike."""
    return F.array_join(F.transform(states, lambda m: m.cast("string")), ",")


# --- the alignments, in SQL ---

EMB = """emb AS (SELECT CAST(label AS VARCHAR) AS label, vec_id, embedding,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rnk FROM embeddings),
  emb_x AS (SELECT label, rnk, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS site FROM emb),
  cells AS (SELECT label AS aln_id, rnk AS taxon, site, CASE WHEN CAST(x AS DOUBLE) < -0.085 THEN 1 WHEN CAST(x AS DOUBLE) < 0.0 THEN 2
    WHEN CAST(x AS DOUBLE) < 0.085 THEN 4 ELSE 8 END AS mask FROM emb_x)"""
CHUNK = EMB.replace("label AS aln_id, rnk AS taxon", "label || '-' || CAST(rnk // 12 AS VARCHAR) AS aln_id, rnk % 12 AS taxon").replace("-0.085", "-0.2").replace("0.085", "0.2").replace("< 0.0 ", "< 0.15 ")
EVT = """seen AS (SELECT CAST(user_id % 3 AS VARCHAR) AS aln_id, CAST(day(ts) AS BIGINT) AS site, user_id AS taxon, bit_or(CASE event_type
    WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 WHEN 'view' THEN 8 WHEN 'error' THEN 15 END) AS mask FROM events GROUP BY 1, 2, 3),
  grid AS (SELECT DISTINCT s.aln_id, s.site, t.taxon FROM seen s JOIN (SELECT DISTINCT aln_id, taxon FROM seen) t USING (aln_id)),
  cells AS (SELECT aln_id, site, taxon, coalesce(mask, 15) AS mask FROM grid LEFT JOIN seen USING (aln_id, site, taxon))"""
IUPAC = "ACGTURYSWKMBDHVN?-"
SEQS = "seqs AS (SELECT lang AS aln_id, doc_id AS taxon, upper(regexp_replace(text, '[^{0}]', '', 'g')) AS seq FROM documents)"
DOC = SEQS.format("ACGTacgt")
#: Letters of whole texts, for each language.
LETTERS = SEQS.format(IUPAC[:-2].lower() + IUPAC) + ", l AS (SELECT aln_id, unnest(string_split(seq, '')) AS letter FROM seqs WHERE seq <> '')"
COLS = "cols AS (SELECT aln_id, site, list(mask ORDER BY taxon) AS states FROM cells GROUP BY 1, 2)"
#: Canonically recoded columns: bits by first taxon that shows them, then by base.
RECODED = """bits AS (SELECT aln_id, site, taxon, b FROM cells, (VALUES (1), (2), (4), (8)) t(b) WHERE mask & b <> 0),
  firsts AS (SELECT aln_id, site, b, row_number() OVER (PARTITION BY aln_id, site ORDER BY min(taxon), b) - 1 AS nr FROM bits GROUP BY aln_id, site, b),
  rcells AS (SELECT aln_id, site, taxon, CAST(sum(1 << CAST(nr AS INTEGER)) AS INTEGER) AS mask FROM bits JOIN firsts USING (aln_id, site, b) GROUP BY 1, 2, 3),
  rcols AS (SELECT aln_id, site, list(mask ORDER BY taxon) AS states FROM rcells GROUP BY 1, 2),
  pats AS (SELECT aln_id, states, count(*) AS weight, min(site) AS site FROM rcols GROUP BY 1, 2)"""
#: Forced weight of a site; null where it is informative.
FORCED = """per_base AS (SELECT aln_id, site, b, sum(CASE WHEN mask & b = 0 THEN bit_count(mask) ELSE 0 END) AS total,
    bit_count(bit_or(CASE WHEN mask & b = 0 THEN mask ELSE 0 END)) AS united, count(*) FILTER (mask & b = 0) AS lacking
    FROM cells, (VALUES (1), (2), (4), (8)) t(b) GROUP BY 1, 2, 3),
  forced AS (SELECT aln_id, site, min(CASE WHEN total = united THEN lacking END) AS forced FROM per_base GROUP BY 1, 2)"""


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.from_embeddings(spark, sf_dir)


def chunked(spark: SparkSession, sf_dir: str, size: int = 12) -> DataFrame:
    """Alignments of ``size`` vectors of a label each, so that all vectors take part in work that grows fast with the taxa."""
    return tables.from_embeddings(spark, sf_dir, tables.UNEVEN, size)


def found_patterns(cells: DataFrame) -> DataFrame:
    return sites.patterns(sites.recoded(sites.columns(cells)))


# --- projections and filters ---


@register("p1_letter_to_mask", f"WITH {LETTERS} SELECT aln_id, letter, CASE letter WHEN '?' THEN 15 WHEN '-' THEN 15 WHEN 'U' THEN 8 ELSE CAST(strpos('ACMGRSVTWYHKDBN', letter) AS INTEGER) END AS mask, count(*) AS n FROM l GROUP BY 1, 2, 3")
def p1(spark, sf_dir):
    letters = tables.sequences_from_documents(spark, sf_dir, IUPAC).select("aln_id", F.explode(F.split("seq", "")).alias("letter"))
    return letters.groupBy("aln_id", "letter", dna.mask_of_letter(F.col("letter")).alias("mask")).agg(F.count("*").alias("n"))


@register("p2_mask_to_letter", f"WITH {EVT} SELECT aln_id, mask, substr('ACMGRSVTWYHKDBN', CAST(mask AS INTEGER), 1) AS letter, count(*) AS n FROM cells GROUP BY 1, 2, 3")
def p2(spark, sf_dir):
    return tables.from_events(spark, sf_dir).groupBy("aln_id", "mask", dna.letter_of_mask(F.col("mask")).alias("letter")).agg(F.count("*").alias("n"))


@register("p3_letter_to_code", f"WITH {DOC}, l AS (SELECT aln_id, unnest(string_split(seq, '')) AS letter FROM seqs WHERE seq <> '') SELECT aln_id, CASE letter WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END AS code, count(*) AS n FROM l GROUP BY 1, 2")
def p3(spark, sf_dir):
    letters = tables.sequences_from_documents(spark, sf_dir).select("aln_id", F.explode(F.split("seq", "")).alias("letter"))
    return letters.groupBy("aln_id", dna.code_of_letter(F.col("letter")).cast("int").alias("code")).agg(F.count("*").alias("n"))


@register("p4_cells_to_sequences", f"WITH {EMB} SELECT aln_id, taxon, string_agg(CASE mask WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END, '' ORDER BY site) AS seq FROM cells GROUP BY 1, 2")
def p4(spark, sf_dir):
    return sites.sequences_from_cells(emb(spark, sf_dir))


@register("p4_sequences_to_cells", f"WITH {DOC}, l AS (SELECT aln_id, taxon, unnest(string_split(seq, '')) AS letter, unnest(generate_series(0, length(seq) - 1)) AS site FROM seqs WHERE seq <> '') SELECT aln_id, site, taxon, CASE letter WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 END AS mask FROM l")
def p4b(spark, sf_dir):
    return sites.cells_from_sequences(tables.sequences_from_documents(spark, sf_dir))


@register("p5_site_range", f"WITH {EMB} SELECT aln_id, site, CAST(sum(mask) AS BIGINT) AS total FROM cells WHERE site BETWEEN 9 AND 39 GROUP BY 1, 2")
def p5(spark, sf_dir):
    return sites.site_range(emb(spark, sf_dir), 10, 40).groupBy("aln_id", "site").agg(F.sum("mask").alias("total"))


@register(
    "p6_without_ambiguous",
    f"WITH every_cell AS (SELECT * FROM (WITH {EVT} SELECT * FROM cells) UNION ALL SELECT * FROM (WITH {CHUNK} SELECT aln_id, site, taxon, mask FROM cells)) "
    "SELECT aln_id, site, count(*) AS n_taxa, CAST(sum(mask) AS BIGINT) AS total FROM every_cell GROUP BY 1, 2 HAVING max(bit_count(mask)) = 1",
)
def p6(spark, sf_dir):
    both = tables.from_events(spark, sf_dir).unionByName(chunked(spark, sf_dir))
    kept = sites.without_ambiguous(sites.columns(both))
    total = F.aggregate("states", F.lit(0).cast("long"), lambda a, m: a + m)
    return kept.select("aln_id", "site", F.size("states").cast("long").alias("n_taxa"), total.alias("total"))


@register("p7_fitch_step", f"WITH {EVT}, nxt AS (SELECT aln_id, site, taxon, mask, lead(mask) OVER (PARTITION BY aln_id, site ORDER BY taxon) AS other FROM cells) SELECT aln_id, mask, other, CASE WHEN mask & other <> 0 THEN mask & other ELSE mask | other END AS united, CAST(sum(CASE WHEN mask & other = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cost FROM nxt WHERE other IS NOT NULL GROUP BY 1, 2, 3, 4")
def p7(spark, sf_dir):
    other = F.lead("mask").over(W.Window.partitionBy("aln_id", "site").orderBy("taxon"))
    met = tables.from_events(spark, sf_dir).withColumn("other", other).filter("other is not null")
    united = dna.fitch_union(F.col("mask"), F.col("other"))
    return met.groupBy("aln_id", "mask", "other", united.alias("united")).agg(F.sum(dna.fitch_cost(F.col("mask"), F.col("other"))).alias("cost"))


@register("p8_changed_step", f"WITH {EVT}, nxt AS (SELECT aln_id, site, taxon, mask, lead(mask) OVER (PARTITION BY aln_id, site ORDER BY taxon) AS other FROM cells), u AS (SELECT *, CASE WHEN mask & other <> 0 THEN mask & other ELSE mask | other END AS united FROM nxt WHERE other IS NOT NULL) SELECT aln_id, taxon, bool_or(united <> mask) AS changed FROM u GROUP BY 1, 2")
def p8(spark, sf_dir):
    other = F.lead("mask").over(W.Window.partitionBy("aln_id", "site").orderBy("taxon"))
    met = tables.from_events(spark, sf_dir).withColumn("other", other).filter("other is not null")
    united = dna.fitch_union(F.col("mask"), F.col("other"))
    return met.groupBy("aln_id", "taxon").agg(F.bool_or(united != F.col("mask")).alias("changed"))


@register("p9_bits", f"WITH {EVT} SELECT aln_id, mask, CAST(bit_count(mask) AS INTEGER) AS n_bits, count(*) AS n FROM cells GROUP BY 1, 2, 3")
def p9(spark, sf_dir):
    return tables.from_events(spark, sf_dir).groupBy("aln_id", "mask", F.bit_count("mask").cast("int").alias("n_bits")).agg(F.count("*").alias("n"))


@register("p10_tree_count", f"WITH {CHUNK}, n AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1) SELECT aln_id, CAST(n AS BIGINT) AS n_taxa, CAST(CASE WHEN n > 3 THEN list_product(list_transform(generate_series(3, n - 1), lambda i: 2 * i - 3)) ELSE 1 END AS BIGINT) AS trees FROM n WHERE n >= 3")
def p10(spark, sf_dir):
    n = chunked(spark, sf_dir).groupBy("aln_id").agg(F.countDistinct("taxon").alias("n_taxa")).filter("n_taxa >= 3")
    return n.select("aln_id", "n_taxa", dna.tree_count(F.lit(3), F.col("n_taxa").cast("int")).cast("long").alias("trees"))


# --- sites ---


@register("a1_collapse", f"WITH {EMB}, {RECODED} SELECT aln_id, array_to_string(states, ',') AS states, weight, site FROM pats")
def a1(spark, sf_dir):
    return found_patterns(emb(spark, sf_dir)).select("aln_id", states_text().alias("states"), "weight", "site")


@register("a1_collapse_prefix", f"WITH {EMB}, {RECODED} SELECT aln_id, array_to_string(states[1:4], ',') AS states, count(*) AS weight, min(site) AS site FROM rcols GROUP BY 1, 2")
def a1_prefix(spark, sf_dir):
    found = sites.patterns(sites.recoded(sites.columns(emb(spark, sf_dir))), 4)
    return found.select("aln_id", states_text().alias("states"), "weight", "site")


@register("a2_constant_sites", f"WITH {CHUNK} SELECT aln_id, site, bit_and(mask) <> 0 AS constant FROM cells GROUP BY 1, 2")
def a2(spark, sf_dir):
    return sites.columns(chunked(spark, sf_dir)).select("aln_id", "site", sites.is_constant().alias("constant"))


@register("a3_forced_weight", f"WITH {EVT}, {FORCED} SELECT aln_id, site, CAST(forced AS BIGINT) AS forced FROM forced UNION ALL SELECT * FROM (WITH {CHUNK}, {FORCED} SELECT aln_id, site, CAST(forced AS BIGINT) AS forced FROM forced)")
def a3(spark, sf_dir):
    both = sites.columns(tables.from_events(spark, sf_dir)).unionByName(sites.columns(chunked(spark, sf_dir)))
    return both.select("aln_id", "site", sites.forced_weight().alias("forced"))


SUMMARY = """SELECT aln_id, CAST(coalesce(sum(weight) FILTER (constant), 0) AS BIGINT) AS n_const,
  CAST(coalesce(sum(weight) FILTER (NOT constant AND forced IS NOT NULL), 0) AS BIGINT) AS n_nonpi,
  CAST(coalesce(sum(weight * forced) FILTER (NOT constant AND forced IS NOT NULL), 0) AS BIGINT) AS nonpi_weight,
  CAST(coalesce(sum(weight) FILTER (forced IS NULL), 0) AS BIGINT) AS n_pi, count(*) FILTER (forced IS NULL) AS n_patterns
  FROM pats JOIN forced USING (aln_id, site) JOIN (SELECT aln_id, site, bit_and(mask) <> 0 AS constant FROM cells GROUP BY 1, 2) c USING (aln_id, site) GROUP BY 1"""


@register("a4_site_summary", f"WITH {CHUNK}, {RECODED}, {FORCED} {SUMMARY}")
def a4(spark, sf_dir):
    return sites.site_summary(found_patterns(chunked(spark, sf_dir)))


@register("a4_site_summary_ambiguous", f"WITH {EVT}, {RECODED}, {FORCED} {SUMMARY}")
def a4b(spark, sf_dir):
    return sites.site_summary(found_patterns(tables.from_events(spark, sf_dir)))


@register("a5_site_lower_bound", f"WITH {EVT} SELECT aln_id, site, CAST(greatest(count(DISTINCT mask) FILTER (bit_count(mask) = 1) - 1, 0) AS BIGINT) AS lower FROM cells GROUP BY 1, 2")
def a5(spark, sf_dir):
    return sites.columns(tables.from_events(spark, sf_dir)).select("aln_id", "site", sites.site_lower_bound().alias("lower"))


@register("a6_site_upper_bound", f"WITH {EVT} SELECT aln_id, site, CAST(count(*) - greatest(count(*) FILTER (mask & 1 <> 0), count(*) FILTER (mask & 2 <> 0), count(*) FILTER (mask & 4 <> 0), count(*) FILTER (mask & 8 <> 0)) AS BIGINT) AS upper FROM cells GROUP BY 1, 2")
def a6(spark, sf_dir):
    return sites.columns(tables.from_events(spark, sf_dir)).select("aln_id", "site", sites.site_upper_bound().alias("upper"))


@register("a7_state_histogram", f"WITH {EVT} SELECT aln_id, site, mask, count(*) AS n FROM cells GROUP BY 1, 2, 3")
def a7(spark, sf_dir):
    return tables.from_events(spark, sf_dir).groupBy("aln_id", "site", "mask").agg(F.count("*").alias("n"))


@register("a8_sites_by_bases", f"WITH {CHUNK}, {RECODED}, per AS (SELECT aln_id, site, count(DISTINCT mask) FILTER (bit_count(mask) = 1) AS n_distinct FROM cells GROUP BY 1, 2) SELECT aln_id, n_distinct, count(*) AS n_patterns, CAST(sum(weight) AS BIGINT) AS weight FROM pats JOIN per USING (aln_id, site) GROUP BY 1, 2")
def a8(spark, sf_dir):
    n = F.size(F.array_distinct(F.filter("states", lambda m: F.bit_count(m) == 1))).cast("long")
    return found_patterns(chunked(spark, sf_dir)).groupBy("aln_id", n.alias("n_distinct")).agg(F.count("*").alias("n_patterns"), F.sum("weight").alias("weight"))


@register("a10_distinct_rows", f"WITH {CHUNK}, part AS (SELECT aln_id, site // 4 AS part_id, taxon, list(mask ORDER BY site) AS states FROM cells GROUP BY 1, 2, 3) SELECT aln_id, part_id, count(DISTINCT states) AS n_rows FROM part GROUP BY 1, 2")
def a10(spark, sf_dir):
    row = F.array_sort(F.collect_list(F.struct("site", "mask")))
    rows = chunked(spark, sf_dir).groupBy("aln_id", F.floor(F.col("site") / 4).alias("part_id"), "taxon").agg(row.alias("row"))
    return rows.groupBy("aln_id", "part_id").agg(F.countDistinct("row").alias("n_rows"))


@register("a11_part_upper_bound", f"WITH {CHUNK}, u AS (SELECT aln_id, site, count(*) - greatest(count(*) FILTER (mask & 1 <> 0), count(*) FILTER (mask & 2 <> 0), count(*) FILTER (mask & 4 <> 0), count(*) FILTER (mask & 8 <> 0)) AS upper FROM cells GROUP BY 1, 2) SELECT aln_id, site // 4 AS part_id, CAST(sum(upper) AS BIGINT) AS upper FROM u GROUP BY 1, 2")
def a11(spark, sf_dir):
    bound = sites.columns(chunked(spark, sf_dir)).select("aln_id", F.floor(F.col("site") / 4).alias("part_id"), sites.site_upper_bound().alias("upper"))
    return bound.groupBy("aln_id", "part_id").agg(F.sum("upper").alias("upper"))


SEEN = "seen_ AS (SELECT aln_id, site, taxon, mask, coalesce(bit_or(mask) OVER (PARTITION BY aln_id, site ORDER BY taxon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM cells)"


@register("a12_additive_score", f"WITH {EMB}, {SEEN} SELECT aln_id, site // 4 AS part_id, count(*) FILTER (taxon >= 3 AND (mask & ~seen) <> 0) AS additive FROM seen_ GROUP BY 1, 2")
def a12(spark, sf_dir):
    return prefixes.additive_scores(emb(spark, sf_dir), F.floor(F.col("site") / 4), 3)


@register("a13_newly_shown", f"WITH {EVT}, {SEEN} SELECT aln_id, taxon, count(*) FILTER (mask & seen = 0) AS n_new, count(*) FILTER ((mask & ~seen) <> 0) AS n_additive FROM seen_ GROUP BY 1, 2")
def a13(spark, sf_dir):
    return prefixes.newly_shown(tables.from_events(spark, sf_dir))


@register("p14_part_scores", f"WITH {EMB}, {SEEN}, u AS (SELECT aln_id, site, count(*) - greatest(count(*) FILTER (mask = 1), count(*) FILTER (mask = 2), count(*) FILTER (mask = 4), count(*) FILTER (mask = 8)) AS upper, greatest(count(DISTINCT mask) - 1, 0) AS lower FROM cells GROUP BY 1, 2), b AS (SELECT aln_id, site // 4 AS part_id, sum(upper) AS upper, sum(lower) AS lower FROM u GROUP BY 1, 2), a AS (SELECT aln_id, site // 4 AS part_id, count(*) FILTER (taxon >= 3 AND (mask & ~seen) <> 0) AS additive FROM seen_ GROUP BY 1, 2) SELECT aln_id, part_id, CAST(greatest(additive, lower - upper) AS BIGINT) AS by_additive, CAST(greatest(0, lower - upper) AS BIGINT) AS by_clipped, CAST(lower AS BIGINT) AS by_lower FROM b JOIN a USING (aln_id, part_id)")
def p14(spark, sf_dir):
    cells, part = emb(spark, sf_dir), F.floor(F.col("site") / 4)
    bound = sites.columns(cells).groupBy("aln_id", part.alias("part_id")).agg(F.sum(sites.site_upper_bound()).alias("upper"), F.sum(sites.site_lower_bound()).alias("lower"))
    both = bound.join(prefixes.additive_scores(cells, part, 3), ["aln_id", "part_id"])
    score = lambda s: dna.part_score(s, F.col("lower"), F.col("upper"), F.col("additive")).alias(f"by_{s}")
    return both.select("aln_id", "part_id", score("additive"), score("clipped"), score("lower"))


# --- windows ---


@register("w1_canonical_recoding", f"WITH {EVT}, {RECODED} SELECT aln_id, site, array_to_string(states, ',') AS states FROM rcols")
def w1(spark, sf_dir):
    return sites.recoded(sites.columns(tables.from_events(spark, sf_dir))).select("aln_id", "site", states_text().alias("states"))


LI = """sym AS (SELECT 'li' AS aln_id, CAST(l_partkey AS BIGINT) AS site, CAST(l_suppkey AS BIGINT) AS taxon, l_returnflag || l_linestatus AS symbol FROM lineitem),
  num AS (SELECT site, symbol, row_number() OVER (PARTITION BY site ORDER BY min(taxon), symbol) - 1 AS nr FROM sym GROUP BY site, symbol),
  cells AS (SELECT aln_id, site, taxon, bit_or(1 << CAST(nr AS INTEGER)) AS mask FROM sym JOIN num USING (site, symbol) GROUP BY 1, 2, 3)"""


@register("w2_symbol_recoding", f"WITH {LI} SELECT aln_id, site, taxon, CAST(mask AS INTEGER) AS mask FROM cells")
def w2(spark, sf_dir):
    return sites.recoded_symbols(tables.symbols_from_lineitem(spark, sf_dir))


@register("w3_prefix_union", f"WITH {EVT}, {SEEN} SELECT aln_id, site, taxon, seen FROM seen_")
def w3(spark, sf_dir):
    return prefixes.seen_before(tables.from_events(spark, sf_dir)).select("aln_id", "site", "taxon", "seen")


RUNNING = """run_b AS (SELECT aln_id, site, taxon, b, sum(CASE WHEN mask & b = 0 THEN bit_count(mask) ELSE 0 END) OVER w AS total,
    bit_count(bit_or(CASE WHEN mask & b = 0 THEN mask ELSE 0 END) OVER w) AS united, sum(CASE WHEN mask & b = 0 THEN 1 ELSE 0 END) OVER w AS lacking
    FROM cells, (VALUES (1), (2), (4), (8)) t(b) WINDOW w AS (PARTITION BY aln_id, site, b ORDER BY taxon ROWS UNBOUNDED PRECEDING)),
  running AS (SELECT aln_id, site, taxon, min(CASE WHEN total = united THEN lacking END) AS forced FROM run_b GROUP BY 1, 2, 3)"""


@register("w4_onset", f"WITH {EMB}, {RUNNING} SELECT aln_id, site, CAST(min(CASE WHEN forced IS NULL THEN taxon + 1 END) AS BIGINT) AS onset FROM running GROUP BY 1, 2")
def w4(spark, sf_dir):
    return prefixes.onsets(emb(spark, sf_dir))


@register("w4_levels", f"WITH {EVT}, {RUNNING} SELECT aln_id, CAST(taxon + 1 AS BIGINT) AS k, count(*) FILTER (forced IS NULL) AS n_informative, CAST(coalesce(sum(forced), 0) AS BIGINT) AS fixed_length FROM running GROUP BY 1, 2")
def w4b(spark, sf_dir):
    return prefixes.levels(tables.from_events(spark, sf_dir))


REST = """clear AS (SELECT aln_id, site FROM cells GROUP BY 1, 2 HAVING max(bit_count(mask)) = 1),
  shown AS (SELECT aln_id, first AS k, count(*) AS n FROM (SELECT aln_id, site, mask, min(taxon) AS first FROM cells JOIN clear USING (aln_id, site) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  spine AS (SELECT DISTINCT aln_id, taxon AS k FROM cells),
  rest AS (SELECT aln_id, k, CAST(coalesce(sum(n) OVER (PARTITION BY aln_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bound FROM spine LEFT JOIN shown USING (aln_id, k))"""


@register("w5_rest_bound", f"WITH {EMB}, {REST} SELECT * FROM rest")
def w5(spark, sf_dir):
    return prefixes.rest_bound(emb(spark, sf_dir))


@register("w6_running_maximum", f"WITH {EVT}, {SEEN}, raw AS (SELECT aln_id, taxon AS k, count(*) FILTER (mask & seen = 0) AS bound FROM seen_ GROUP BY 1, 2) SELECT aln_id, k, max(bound) OVER (PARTITION BY aln_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS bound FROM raw")
def w6(spark, sf_dir):
    raw = prefixes.newly_shown(tables.from_events(spark, sf_dir)).select("aln_id", F.col("taxon").alias("k"), F.col("n_new").alias("bound"))
    return prefixes.held_for_fewer(raw)


@register("w7_pattern_rank", f"WITH {CHUNK}, {RECODED} SELECT aln_id, array_to_string(states, ',') AS states, weight, row_number() OVER (PARTITION BY aln_id ORDER BY weight DESC, states) - 1 AS pattern_id FROM pats")
def w7(spark, sf_dir):
    return sites.ranked_patterns(found_patterns(chunked(spark, sf_dir))).select("aln_id", states_text().alias("states"), "weight", "pattern_id")


HITS = "up AS (SELECT aln_id, site, count(*) - greatest(count(*) FILTER (mask & 1 <> 0), count(*) FILTER (mask & 2 <> 0), count(*) FILTER (mask & 4 <> 0), count(*) FILTER (mask & 8 <> 0)) AS upper FROM cells GROUP BY 1, 2), hit AS (SELECT a.aln_id, a.site, count(*) AS hits FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon WHERE a.mask & b.mask = 0 GROUP BY 1, 2)"


@register("w8_best_site_by_bound", f"WITH {CHUNK}, {HITS} SELECT aln_id, CAST(upper AS BIGINT) AS upper, site, hits FROM (SELECT *, row_number() OVER (PARTITION BY aln_id, upper ORDER BY hits DESC, site) AS nr FROM up JOIN hit USING (aln_id, site)) WHERE nr = 1")
def w8(spark, sf_dir):
    cells = chunked(spark, sf_dir)
    hits = pairs.distinguishing_sites(cells).groupBy("aln_id", "site").agg(F.count("*").alias("hits"))
    bound = sites.columns(cells).select("aln_id", "site", sites.site_upper_bound().alias("upper"))
    best = F.min(F.struct((-F.col("hits")).alias("less"), "site", "hits")).alias("best")
    return bound.join(hits, ["aln_id", "site"]).groupBy("aln_id", "upper").agg(best).select("aln_id", "upper", "best.site", "best.hits")


# --- pairs ---

PAIR = "pr AS (SELECT a.aln_id, a.taxon AS i, b.taxon AS j, CAST(sum(CASE WHEN a.mask & b.mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dist, CAST(sum(CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END) AS BIGINT) AS strict FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon GROUP BY 1, 2, 3)"


@register("j1_distances", f"WITH {EVT}, {PAIR} SELECT aln_id, i, j, dist, strict, dist AS sites FROM pr")
def j1(spark, sf_dir):
    # every cell of the grid is there, with a weight of one
    return pairs.blocked_distances(tables.from_events(spark, sf_dir)).withColumn("sites", F.col("dist"))


@register("j1_weighted_distances", f"WITH {CHUNK}, {RECODED}, wc AS (SELECT c.aln_id, c.site, c.taxon, c.mask, weight FROM rcells c JOIN pats USING (aln_id, site)) SELECT a.aln_id, a.taxon AS i, b.taxon AS j, CAST(sum(CASE WHEN a.mask & b.mask = 0 THEN a.weight ELSE 0 END) AS BIGINT) AS dist, CAST(sum(CASE WHEN a.mask <> b.mask THEN a.weight ELSE 0 END) AS BIGINT) AS strict, count(*) FILTER (a.mask & b.mask = 0) AS sites FROM wc a JOIN wc b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon GROUP BY 1, 2, 3")
def j1w(spark, sf_dir):
    found = found_patterns(chunked(spark, sf_dir))
    cells = found.select("aln_id", "site", "weight", F.posexplode("states").alias("taxon", "mask")).withColumn("taxon", F.col("taxon").cast("long"))
    return pairs.fitch_distances(cells)


@register("j2_blocked_distances", f"WITH {EMB}, {PAIR} SELECT * FROM pr")
def j2(spark, sf_dir):
    return pairs.blocked_distances(emb(spark, sf_dir))


@register("j4_distinguishing_sites", f"WITH {CHUNK} SELECT a.aln_id, a.taxon AS i, b.taxon AS j, a.site FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon WHERE a.mask & b.mask = 0")
def j4(spark, sf_dir):
    return pairs.distinguishing_sites(chunked(spark, sf_dir))


SITE_PAIR = "coded AS (SELECT aln_id, taxon, site, bit_count(mask - 1) AS c FROM cells WHERE bit_count(mask) = 1), sp AS (SELECT a.aln_id, a.site AS p, b.site AS q, CAST(bit_or(1 << CAST(4 * a.c + b.c AS INTEGER)) AS INTEGER) AS mask16 FROM coded a JOIN coded b ON a.aln_id = b.aln_id AND a.taxon = b.taxon AND a.site < b.site GROUP BY 1, 2, 3)"


@register("j5_site_pairs", f"WITH {CHUNK}, {SITE_PAIR} SELECT * FROM sp")
def j5(spark, sf_dir):
    return pairs.site_pairs(chunked(spark, sf_dir))


@register("j5_blocked_site_pairs", f"WITH {EMB}, {SITE_PAIR} SELECT * FROM sp")
def j5b(spark, sf_dir):
    return pairs.blocked_site_pairs(emb(spark, sf_dir))


@register("j11_cross_minimum", f"WITH {EVT}, {PAIR}, r AS (SELECT DISTINCT aln_id, taxon AS r FROM cells) SELECT aln_id, r, min(dist) AS min_dist FROM pr JOIN (SELECT aln_id AS a2, r FROM r) x ON aln_id = a2 AND i < r AND r <= j GROUP BY 1, 2")
def j11(spark, sf_dir):
    return pairs.blocked_cross_minimum(tables.from_events(spark, sf_dir))


@register("a9_o1_farthest_pair", f"WITH {EMB}, {PAIR}, b AS (SELECT aln_id, max(dist) AS dist FROM pr GROUP BY 1), t AS (SELECT pr.* FROM pr JOIN b USING (aln_id, dist)) SELECT aln_id, first.i AS i, first.j AS j, dist, n_ties FROM (SELECT aln_id, dist, min({{'i': i, 'j': j}}) AS first, count(*) AS n_ties FROM t GROUP BY 1, 2)")
def a9(spark, sf_dir):
    return pairs.blocked_farthest_pair(emb(spark, sf_dir))


@register("a14_pair_surplus", f"WITH {CHUNK}, own AS (SELECT aln_id, site, count(DISTINCT mask) AS n FROM cells GROUP BY 1, 2), bt AS (SELECT a.aln_id, a.site AS p, b.site AS q, count(DISTINCT a.mask * 16 + b.mask) AS n FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.taxon = b.taxon AND a.site < b.site GROUP BY 1, 2, 3) SELECT bt.aln_id, p, q, bt.n - x.n - y.n + 1 AS surplus FROM bt JOIN own x ON x.aln_id = bt.aln_id AND x.site = p JOIN own y ON y.aln_id = bt.aln_id AND y.site = q")
def a14(spark, sf_dir):
    return pairs.pair_surplus(chunked(spark, sf_dir))


@register("o6_sites_by_states", f"WITH {EMB}, {FORCED}, n AS (SELECT aln_id, site, count(DISTINCT mask) AS n_states FROM cells GROUP BY 1, 2) SELECT aln_id, site, n_states, row_number() OVER (PARTITION BY aln_id ORDER BY n_states DESC, site) - 1 AS place FROM n JOIN forced USING (aln_id, site) WHERE forced IS NULL")
def o6(spark, sf_dir):
    told = sites.informative_patterns(sites.columns(emb(spark, sf_dir)))
    told = told.select("aln_id", "site", F.size(F.array_distinct("states")).cast("long").alias("n_states"))
    return told.withColumn("place", F.row_number().over(W.Window.partitionBy("aln_id").orderBy(F.desc("n_states"), "site")).cast("long") - 1)


@register("s9_prefix_datasets", f"WITH {CHUNK}, n AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1), ks AS (SELECT aln_id, unnest(generate_series(3, n)) AS k FROM n WHERE n >= 3) SELECT cells.aln_id, k, count(*) AS n_cells, CAST(sum(mask) AS BIGINT) AS total FROM cells JOIN ks ON cells.aln_id = ks.aln_id AND taxon < k GROUP BY 1, 2")
def s9(spark, sf_dir):
    found = writers.prefix_datasets(sites.sequences_from_cells(chunked(spark, sf_dir)))
    cells = sites.cells_from_sequences(found.select(F.struct("aln_id", "k").alias("aln_id"), "taxon", "seq"))
    return cells.groupBy("aln_id.aln_id", "aln_id.k").agg(F.count("*").alias("n_cells"), F.sum("mask").alias("total"))


@register("s10_uninformative_prefixes", f"WITH {CHUNK}, {RUNNING}, o AS (SELECT aln_id, site, min(CASE WHEN forced IS NULL THEN taxon + 1 END) AS onset FROM running GROUP BY 1, 2), n AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1), ks AS (SELECT aln_id, unnest(generate_series(3, n - 1)) AS k FROM n WHERE n >= 4) SELECT aln_id, k, site FROM o JOIN ks USING (aln_id) WHERE onset > k")
def s10(spark, sf_dir):
    return writers.uninformative_prefixes(chunked(spark, sf_dir)).select("aln_id", "k", "site")


LETTER = "CASE mask WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END"


@register("s10_uninformative_columns", f"WITH {CHUNK}, {RUNNING}, o AS (SELECT aln_id, site, min(CASE WHEN forced IS NULL THEN taxon + 1 END) AS onset FROM running GROUP BY 1, 2), n AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1), ks AS (SELECT aln_id, unnest(generate_series(3, n - 1)) AS k FROM n WHERE n >= 4) SELECT cells.aln_id, k, taxon, string_agg({LETTER}, '' ORDER BY cells.site) AS seq FROM o JOIN ks USING (aln_id) JOIN cells ON cells.aln_id = o.aln_id AND cells.site = o.site WHERE onset > k GROUP BY 1, 2, 3")
def s10b(spark, sf_dir):
    return writers.uninformative_columns(chunked(spark, sf_dir))


# --- trees ---


def small(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Recoded patterns of alignments of ``size`` taxa; those that come out with fewer than four have one tree and are left out."""
    return checkpointed(found_patterns(sites.enough_taxa(chunked(spark, sf_dir, size))))


def chunk_sql(size: int) -> str:
    return CHUNK.replace("rnk // 12", f"rnk // {size}").replace("rnk % 12", f"rnk % {size}")


QUARTET = f"""WITH {chunk_sql(4)}, q AS (SELECT a.aln_id, a.site, a.mask AS a, b.mask AS b, c.mask AS c, d.mask AS d FROM cells a
  JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND b.taxon = 1 JOIN cells c ON a.aln_id = c.aln_id AND a.site = c.site AND c.taxon = 2
  JOIN cells d ON a.aln_id = d.aln_id AND a.site = d.site AND d.taxon = 3 WHERE a.taxon = 0),
  t AS (SELECT aln_id, '(1,2,(3,4))' AS newick, a AS w, b AS x, c AS y, d AS z FROM q UNION ALL SELECT aln_id, '(1,(2,4),3)', a, c, b, d FROM q UNION ALL SELECT aln_id, '(1,(2,3),4)', a, d, b, c FROM q),
  u AS (SELECT aln_id, newick, CASE WHEN w & x <> 0 THEN w & x ELSE w | x END AS l, CASE WHEN y & z <> 0 THEN y & z ELSE y | z END AS r,
    CASE WHEN w & x = 0 THEN 1 ELSE 0 END + CASE WHEN y & z = 0 THEN 1 ELSE 0 END AS inner_cost FROM t),
  scored AS (SELECT aln_id, newick, CAST(sum(inner_cost + CASE WHEN l & r = 0 THEN 1 ELSE 0 END) AS BIGINT) AS score FROM u GROUP BY 1, 2)"""


def quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three trees of every alignment of four taxa, with their lengths."""
    return trees.search(small(spark, sf_dir, 4))[0]


@register("t7_enumeration", QUARTET + " SELECT * FROM scored")
def t7(spark, sf_dir):
    return quartets(spark, sf_dir).select("aln_id", trees.newick_text(F.col("parents")).alias("newick"), "score")


@register("t1_tree_scores", QUARTET + " SELECT aln_id, newick, score AS length FROM scored")
def t1(spark, sf_dir):
    patterns = small(spark, sf_dir, 4)
    shapes = trees.search(patterns)[0].select("aln_id", "parents").withColumn("tree_id", F.xxhash64("parents"))
    text = shapes.select("aln_id", "tree_id", trees.newick_text(F.col("parents")).alias("newick"))
    return trees.score_trees(shapes, patterns).join(text, ["aln_id", "tree_id"]).select("aln_id", "newick", "length")


@register("u2_o7_shortest_trees", QUARTET + ", b AS (SELECT * FROM scored QUALIFY score = min(score) OVER (PARTITION BY aln_id)) SELECT aln_id, newick, score, count(*) OVER (PARTITION BY aln_id) AS n_ties FROM b")
def u2(spark, sf_dir):
    best = trees.shortest(quartets(spark, sf_dir)).withColumn("n_ties", F.count("*").over(W.Window.partitionBy("aln_id")))
    return best.select("aln_id", trees.newick_text(F.col("parents")).alias("newick"), "score", "n_ties")


@register("o7_kept_trees", QUARTET + ", b AS (SELECT aln_id, score, count(*) AS n FROM scored GROUP BY 1, 2 QUALIFY score = min(score) OVER (PARTITION BY aln_id)) SELECT aln_id, score, least(n, 1) AS n_kept, n > 1 AS missed FROM b")
def o7(spark, sf_dir):
    kept = trees.shortest(quartets(spark, sf_dir), 1)
    return kept.groupBy("aln_id", "score").agg(F.count("*").alias("n_kept"), F.bool_or("missed").alias("missed"))


@register("u1_union_of_trees", QUARTET + " SELECT aln_id, count(*) AS n_trees, min(score) AS least FROM scored GROUP BY 1")
def u1(spark, sf_dir):
    found = quartets(spark, sf_dir)
    both = found.unionByName(trees.shortest(found).select(found.columns)).dropDuplicates(["aln_id", "parents"])
    return both.groupBy("aln_id").agg(F.count("*").alias("n_trees"), F.min("score").alias("least"))


@register("t14_three_taxon_length", f"WITH {CHUNK}, q AS (SELECT a.aln_id, a.mask AS a, b.mask AS b, c.mask AS c FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND b.taxon = 1 JOIN cells c ON a.aln_id = c.aln_id AND a.site = c.site AND c.taxon = 2 WHERE a.taxon = 0) SELECT aln_id, CAST(sum(CASE WHEN a & b = 0 THEN 1 ELSE 0 END + CASE WHEN (CASE WHEN a & b <> 0 THEN a & b ELSE a | b END) & c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS length FROM q GROUP BY 1")
def t14(spark, sf_dir):
    return trees.three_taxon_lengths(found_patterns(chunked(spark, sf_dir)))


THREE = f"""WITH {CHUNK}, q AS (SELECT a.aln_id, a.site, a.mask AS a, b.mask AS b, c.mask AS c FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND b.taxon = 1
  JOIN cells c ON a.aln_id = c.aln_id AND a.site = c.site AND c.taxon = 2 WHERE a.taxon = 0),
  e AS (SELECT aln_id, site, 1 AS edge, b AS own, CASE WHEN a & c <> 0 THEN a & c ELSE a | c END AS others FROM q
    UNION ALL SELECT aln_id, site, 2, c, CASE WHEN a & b <> 0 THEN a & b ELSE a | b END FROM q
    UNION ALL SELECT aln_id, site, 3, a, CASE WHEN b & c <> 0 THEN b & c ELSE b | c END FROM q),
  m AS (SELECT aln_id, site, edge, CASE WHEN own & others <> 0 THEN own & others ELSE own | others END AS mid FROM e),
  places AS (SELECT m.aln_id, taxon, edge, CAST(sum(CASE WHEN mid & mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cost FROM m JOIN cells USING (aln_id, site) WHERE taxon > 2 GROUP BY 1, 2, 3)"""


def three_taxon_costs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    patterns = small(spark, sf_dir, 12)
    begin = patterns.select("aln_id").distinct().select("aln_id", F.lit(0).cast("long").alias("tree_id"), F.array(*[F.lit(x) for x in (-1, 3, 3, 0)]).alias("parents"))
    return begin, patterns, trees.placements(begin, patterns)


@register("t3_placements", THREE + " SELECT aln_id, taxon, edge, cost FROM places")
def t3(spark, sf_dir):
    return three_taxon_costs(spark, sf_dir)[2].select("aln_id", "taxon", "edge", "cost")


@register("w9_best_places", THREE + ", b AS (SELECT aln_id, taxon, min({'cost': cost, 'edge': edge}) AS best, round(avg(cost), 6) AS mean_cost, round(var_pop(cost), 6) AS var_cost FROM places GROUP BY 1, 2) SELECT aln_id, taxon, best.edge AS edge, best.cost AS cost, mean_cost, var_cost, dense_rank() OVER (PARTITION BY aln_id ORDER BY best.cost) AS place FROM b")
def w9(spark, sf_dir):
    best = trees.best_places(three_taxon_costs(spark, sf_dir)[2])
    return best.select("aln_id", "taxon", "edge", "cost", F.round("mean_cost", 6).alias("mean_cost"), F.round("var_cost", 6).alias("var_cost"), F.col("place").cast("long").alias("place"))


@register("t2_edge_views", THREE + ", v AS (SELECT aln_id, edge, site, mid FROM m) SELECT v.aln_id, edge, CAST(sum(CASE WHEN bit_count(mid) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_open FROM v JOIN cells USING (aln_id, site) WHERE taxon = 3 GROUP BY 1, 2")
def t2(spark, sf_dir):
    begin, patterns, _ = three_taxon_costs(spark, sf_dir)
    seen = trees.edge_views(begin, patterns)
    weights = patterns.groupBy("aln_id", F.floor(F.col("site") / trees.BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("site", "weight"))).alias("held"))
    met = seen.join(weights, ["aln_id", "block"])
    byte = lambda i: F.conv(F.hex(F.substring("mid", i + 1, F.lit(1))), 16, 10).cast("int")
    open_ = F.aggregate("held", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda a, h: F.struct((a["i"] + 1).alias("i"), (a["n"] + F.when(F.bit_count(byte(a["i"])) > 1, h["weight"]).otherwise(F.lit(0))).alias("n")))["n"]
    return met.groupBy("aln_id", "edge").agg(F.sum(open_).alias("n_open"))


@register("t13_look_ahead", THREE + f", {SEEN.replace('seen_ AS', 'shown AS')}, nw AS (SELECT aln_id, taxon, CAST(count(*) FILTER (mask & seen = 0) AS BIGINT) AS n_new FROM shown GROUP BY 1, 2), lb AS (SELECT aln_id, taxon, min(cost) AS cost FROM places GROUP BY 1, 2) SELECT aln_id, max(cost - n_new) AS bound FROM lb JOIN nw USING (aln_id, taxon) GROUP BY 1")
def t13(spark, sf_dir):
    newly = prefixes.newly_shown(chunked(spark, sf_dir))
    return trees.look_ahead(three_taxon_costs(spark, sf_dir)[2], newly).select("aln_id", "bound")


@register("p11_p12_newick_round_trip", QUARTET + " SELECT aln_id, newick, true AS same FROM scored")
def p12(spark, sf_dir):
    told = quartets(spark, sf_dir).select("aln_id", F.col("parents").alias("old"), trees.newick_text(F.col("parents")).alias("newick"))
    back = trees.parsed_trees(told.withColumn("labels", F.array(*[F.lit(str(i + 1)) for i in range(4)])))
    return back.select("aln_id", "newick", (F.col("old") == F.col("parents")).alias("same"))


@register("p13_structure_check", QUARTET + " SELECT aln_id, count(*) * 6 AS n_nodes, CAST(0 AS BIGINT) AS n_faults FROM scored GROUP BY 1")
def p13(spark, sf_dir):
    found = quartets(spark, sf_dir).withColumn("tree_id", F.xxhash64("parents"))
    nodes = trees.node_table(found.select("aln_id", "tree_id", "parents"))
    faults = trees.structure_faults(nodes, ["aln_id", "tree_id"]).groupBy("aln_id").agg(F.count("*").alias("n_faults"))
    return nodes.groupBy("aln_id").agg(F.count("*").alias("n_nodes")).join(faults, "aln_id", "left").select("aln_id", "n_nodes", F.coalesce("n_faults", F.lit(0).cast("long")).alias("n_faults"))


def six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir, 6)


def with_text(found: DataFrame, *columns: str) -> DataFrame:
    return found.select("aln_id", trees.newick_text(F.col("parents")).alias("newick"), *columns)


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    patterns = six(spark, sf_dir)
    weights = patterns.select("aln_id", "site", "weight")
    cells = sites.cells_from_columns(patterns)
    rest = bounds.combined(prefixes.rest_bound(cells, weights), None, None, [bounds.spanning_rest_bounds(patterns)])
    return trees.search(patterns, bounds.swapped_upper_bounds(patterns), rest)


@register("t6_exact_search")
def t6(spark, sf_dir):
    return with_text(trees.shortest(searched(spark, sf_dir)[0]), "score")


@register("a15_search_counters")
def a15(spark, sf_dir):
    return searched(spark, sf_dir)[1]


@register("a15_t6_counters")
def a15b(spark, sf_dir):
    """Counters of a search within the length of the greedy tree, with the bound of distinct bases."""
    patterns = six(spark, sf_dir)
    rest = prefixes.rest_bound(sites.cells_from_columns(patterns), patterns.select("aln_id", "site", "weight"))
    upper = growing.grown_trees(patterns).select("aln_id", F.col("length").alias("upper"))
    counted = trees.search(patterns, upper, rest)[1]
    return counted.select("aln_id", F.col("level").cast("int").alias("level"), "tried", "kept", "pruned", "full", "ties")


@register("t6_waves_exact_search")
def t6b(spark, sf_dir):
    """The same trees as ``t6_exact_search``, in waves of about twenty thousand trees, whose whole trees lower the bound."""
    patterns = six(spark, sf_dir)
    rest = prefixes.rest_bound(sites.cells_from_columns(patterns), patterns.select("aln_id", "site", "weight"))
    return with_text(trees.shortest(trees.search(patterns, None, rest, wave=20_000)[0]), "score")


@register("t4_rounds_greedy_trees")
def t4b(spark, sf_dir):
    return with_text(growing.grown_trees(six(spark, sf_dir)), "length")


@register("t4_large_alignments")
def t4c(spark, sf_dir):
    """Greedy trees of whole labels, a taxon a round over blocks of their patterns."""
    return with_text(growing.grown_trees(found_patterns(emb(spark, sf_dir)), size=16), "length")


@register("t5_rounds_cheapest_next")
def t5b(spark, sf_dir):
    return with_text(growing.grown_trees(small(spark, sf_dir, 12), "cheapest"), "taxa", "length")


@register("o4_rank_orders_within_bound")
def o4b(spark, sf_dir):
    patterns = small(spark, sf_dir, 12)
    return growing.placement_orders(patterns, "max_rank", bounds.upper_bounds(patterns))


@register("t4_greedy_trees")
def t4(spark, sf_dir):
    return with_text(trees.greedy_trees(small(spark, sf_dir, 12)), "length")


@register("t5_cheapest_next_trees")
def t5(spark, sf_dir):
    return with_text(trees.cheapest_next_trees(small(spark, sf_dir, 12)), "taxa", "length")


@register("o5_heaviest_three", f"WITH {CHUNK}, q AS (SELECT a.aln_id, a.taxon AS i, b.taxon AS j, c.taxon AS k, a.mask AS a, b.mask AS b, c.mask AS c FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon JOIN cells c ON a.aln_id = c.aln_id AND a.site = c.site AND b.taxon < c.taxon), s AS (SELECT aln_id, i, j, k, CAST(sum(CASE WHEN a & b = 0 THEN 1 ELSE 0 END + CASE WHEN (CASE WHEN a & b <> 0 THEN a & b ELSE a | b END) & c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS length FROM q GROUP BY 1, 2, 3, 4), big AS (SELECT aln_id FROM cells GROUP BY 1 HAVING count(DISTINCT taxon) >= 4) SELECT aln_id, i, j, k, length FROM s JOIN big USING (aln_id) QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY length DESC, i, j, k) = 1")
def o5(spark, sf_dir):
    return growing.heaviest_threes(growing.packed_blocks(small(spark, sf_dir, 12)))


@register("t8_j10_reconnections")
def t8b(spark, sf_dir):
    """All trees one cut away from the comb of each alignment's taxa, with what they gain."""
    patterns = six(spark, sf_dir)
    sizes = patterns.select("aln_id", F.size("states").alias("n")).distinct()
    combs = F.create_map(*[x for n in (4, 5, 6) for x in (F.lit(n), F.array(*map(F.lit, bound_sql.comb(n))))])
    begin = sizes.select("aln_id", F.lit(0).cast("long").alias("tree_id"), F.element_at(combs, F.col("n")).alias("parents"))
    found = trees.reconnections(begin, patterns).join(begin.select("aln_id", "parents"), "aln_id")
    tree = trees.reconnected(F.col("parents"), F.col("cut"), F.col("below"), F.col("above"))
    return found.select("aln_id", "cut", "below", "above", trees.newick_text(tree).alias("newick"), "gain")


@register("t8_bisections")
def t8(spark, sf_dir):
    patterns = six(spark, sf_dir)
    begin = trees.greedy_trees(patterns).withColumn("tree_id", F.lit(0).cast("long"))
    return with_text(trees.bisections(begin, patterns), "cut", "length")


@register("t9_improved_trees")
def t9(spark, sf_dir):
    patterns = six(spark, sf_dir)
    begin = trees.greedy_trees(patterns).withColumn("tree_id", F.lit(0).cast("long"))
    return with_text(trees.improved_trees(begin, patterns), "length")


@register("t10_swapped_upper_bound")
def t10(spark, sf_dir):
    return bounds.swapped_upper_bounds(six(spark, sf_dir))


@register("t11_neighbour_joining")
def t11(spark, sf_dir):
    return trees.joined_neighbours(pairs.blocked_distances(emb(spark, sf_dir)).select("aln_id", "i", "j", F.col("strict").alias("dist")))


@register("t12_rest_upper_bound")
def t12(spark, sf_dir):
    cells = sites.enough_taxa(chunked(spark, sf_dir))
    return bounds.rest_upper_bounds(found_patterns(cells), pairs.fitch_distances(cells))


# --- bounds and orders ---


@register("h1_spanning_tree")
def h1(spark, sf_dir):
    return bounds.spanning_tree_weights(found_patterns(emb(spark, sf_dir)))


@register("h2_upper_bound")
def h2(spark, sf_dir):
    return bounds.upper_bounds(found_patterns(emb(spark, sf_dir)))


@register("h3_spanning_rest_bound")
def h3(spark, sf_dir):
    return bounds.spanning_rest_bounds(small(spark, sf_dir, 12))


@register("h4_j6_j7_incompatible_pairs")
def h4(spark, sf_dir):
    return bounds.incompatible_pairs(chunked(spark, sf_dir))


@register("j7_incompatible_ambiguous")
def j7(spark, sf_dir):
    return pairs.blocked_incompatible(tables.from_events(spark, sf_dir))


@register("h5_incompatibility_bound")
def h5(spark, sf_dir):
    cells = chunked(spark, sf_dir)
    return bounds.incompatibility_bounds(cells, found_patterns(cells))


@register("h6_part_bounds")
def h6(spark, sf_dir):
    return bounds.part_bounds(found_patterns(chunked(spark, sf_dir)), F.floor(F.col("site") / 4), 3)


@register("h7_two_way_scores")
def h7(spark, sf_dir):
    return bounds.two_way_scores(found_patterns(chunked(spark, sf_dir)), F.floor(F.col("site") / 4))


@register("h8_partition_bound")
def h8(spark, sf_dir):
    return bounds.partition_bounds(sites.informative_patterns(six(spark, sf_dir)))


@register("h9_uninformative_bound")
def h9(spark, sf_dir):
    return bounds.uninformative_bounds(six(spark, sf_dir))


@register("h10_corrected_bound")
def h10(spark, sf_dir):
    return bounds.corrected_bounds(six(spark, sf_dir))


@register("h11_hitting_set_bound")
def h11(spark, sf_dir):
    return bounds.hitting_set_bounds(six(spark, sf_dir))


@register("h12_surplus_bound")
def h12(spark, sf_dir):
    return bounds.surplus_bounds(chunked(spark, sf_dir))


COMBINED = f"WITH {EMB}, {REST}, {SEEN}, raw AS (SELECT aln_id, taxon AS k, count(*) FILTER (mask & seen = 0) AS bound FROM seen_ GROUP BY 1, 2), held AS (SELECT aln_id, k, max(bound) OVER (PARTITION BY aln_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS bound FROM raw)"


@register("h13_combined_bounds", COMBINED + " SELECT rest.aln_id, rest.k, greatest(CASE WHEN rest.k = 2 THEN raw.bound ELSE rest.bound + raw.bound END, held.bound) AS bound FROM rest JOIN raw USING (aln_id, k) JOIN held USING (aln_id, k)")
def h13(spark, sf_dir):
    cells = emb(spark, sf_dir)
    raw = prefixes.newly_shown(cells).select("aln_id", F.col("taxon").alias("k"), F.col("n_new").alias("bound"))
    return bounds.combined(prefixes.rest_bound(cells), raw, raw.filter("k = 2"), [prefixes.held_for_fewer(raw)])


@register("h14_whole_lower_bound")
def h14(spark, sf_dir):
    return bounds.whole_lower_bounds(small(spark, sf_dir, 12))


@register("h14_partition_lower_bound")
def h14b(spark, sf_dir):
    return bounds.partitioned_lower_bounds(small(spark, sf_dir, 12))


@register("h12_surplus_orders")
def h12b(spark, sf_dir):
    return growing.surplus_orders(small(spark, sf_dir, 12))


@register("h13_s7_real_bounds")
def h13b(spark, sf_dir):
    """Distinct bases and incompatible pairs added, spanning trees where they say more, and the file of rest bounds as written and
    read again, which takes its place at rank 2."""
    cells = sites.enough_taxa(chunked(spark, sf_dir))
    patterns = checkpointed(found_patterns(cells))
    weights = patterns.select("aln_id", "site", "weight")
    distinct = prefixes.rest_bound(cells.join(weights.select("aln_id", "site"), ["aln_id", "site"], "left_semi"), weights)
    incompatible = bounds.incompatibility_bounds(cells, patterns)
    path = scratch(spark)
    writers.write_bounds(distinct, path)
    loaded = writers.read_bounds(spark, path).filter("k = 2")
    return bounds.combined(distinct, incompatible, loaded, [bounds.spanning_rest_bounds(patterns)])


@register("o2_max_min_order")
def o2(spark, sf_dir):
    return bounds.addition_orders_of_cells(emb(spark, sf_dir))


@register("o2_rounds_max_min_order")
def o2b(spark, sf_dir):
    return growing.distance_orders(pairs.blocked_distances(emb(spark, sf_dir)))


@register("o3_max_sum_order")
def o3(spark, sf_dir):
    return bounds.addition_orders_of_cells(emb(spark, sf_dir), "max_sum")


@register("o3_rounds_max_sum_order")
def o3b(spark, sf_dir):
    return growing.distance_orders(pairs.blocked_distances(emb(spark, sf_dir)), "max_sum")


@register("o4_placement_orders")
def o4(spark, sf_dir):
    patterns = small(spark, sf_dir, 12)
    every = [bounds.placement_orders(patterns, rule).withColumn("rule", F.lit(rule)) for rule in bounds.RULES]
    out = every[0]
    for other in every[1:]:
        out = out.unionByName(other)
    return out


# --- set operations, labels, files ---


@register("u3_uncovered_pairs", f"WITH {CHUNK}, hit AS (SELECT a.aln_id, a.taxon AS i, b.taxon AS j, a.site FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon WHERE a.mask & b.mask = 0), best AS (SELECT aln_id, site FROM (SELECT aln_id, site, row_number() OVER (PARTITION BY aln_id ORDER BY count(*) DESC, site) AS nr FROM hit GROUP BY 1, 2) WHERE nr = 1) SELECT DISTINCT aln_id, i, j FROM hit WHERE (aln_id, i, j) NOT IN (SELECT (aln_id, i, j) FROM hit JOIN best USING (aln_id, site))")
def u3(spark, sf_dir):
    hits = pairs.distinguishing_sites(chunked(spark, sf_dir))
    best = hits.groupBy("aln_id", "site").agg(F.count("*").alias("n")).groupBy("aln_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "site")).alias("best"))
    covered = hits.join(best.select("aln_id", F.col("best.site").alias("site")), ["aln_id", "site"], "left_semi")
    return hits.select("aln_id", "i", "j").distinct().join(covered, ["aln_id", "i", "j"], "left_anti")


@register("u4_pairs_without_used_sites", f"WITH {CHUNK}, {SITE_PAIR}, first AS (SELECT aln_id, min({{'p': p, 'q': q}}) AS f FROM sp GROUP BY 1) SELECT sp.aln_id, count(*) AS n_left FROM sp JOIN first USING (aln_id) WHERE p NOT IN (f.p, f.q) AND q NOT IN (f.p, f.q) GROUP BY 1")
def u4(spark, sf_dir):
    found = pairs.site_pairs(chunked(spark, sf_dir)).select("aln_id", "p", "q")
    first = found.groupBy("aln_id").agg(F.min(F.struct("p", "q")).alias("f"))
    used = first.select("aln_id", F.explode(F.array("f.p", "f.q")).alias("site"))
    for side in ("p", "q"):
        found = found.join(used.withColumnRenamed("site", side), ["aln_id", side], "left_anti")
    return found.groupBy("aln_id").agg(F.count("*").alias("n_left"))


@register("j8_relabelled", f"WITH {EMB}, n AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1), {SEEN}, shown AS (SELECT aln_id, taxon, count(*) FILTER (mask & seen = 0) AS n_new FROM seen_ GROUP BY 1, 2) SELECT aln_id, n - 1 - taxon AS taxon, n_new FROM shown JOIN n USING (aln_id)")
def j8(spark, sf_dir):
    cells = emb(spark, sf_dir)
    order = cells.select("aln_id", "taxon").distinct()
    order = order.withColumn("rank", F.row_number().over(W.Window.partitionBy("aln_id").orderBy(F.desc("taxon"))).cast("long") - 1)
    ranked = prefixes.newly_shown(cells).select("aln_id", F.col("taxon").alias("rank"), "n_new")
    return pairs.relabelled(ranked, order).select("aln_id", "taxon", "n_new")


@register("s1_s3_phylip_round_trip", f"WITH {EMB} SELECT aln_id, taxon, 'T' || CAST(taxon + 1 AS VARCHAR) AS label, string_agg(CASE mask WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END, '' ORDER BY site) AS seq FROM cells GROUP BY 1, 2")
def s1(spark, sf_dir):
    lines = writers.phylip_lines(sites.patterns(sites.columns(emb(spark, sf_dir))))
    files = lines.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    files = files.select(F.col("aln_id").alias("path"), F.array_join(F.col("lines.line"), "\n").alias("value"))
    return phylip.parsed(files).filter("error is null").select(F.col("path").alias("aln_id"), "taxon", "label", "seq")


@register(
    "s2_rejected_texts",
    "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(CASE WHEN doc_id % 6 = 0 THEN 1 WHEN doc_id % 6 = 5 THEN 3 ELSE 2 END AS INTEGER) AS line, CASE doc_id % 6 WHEN 0 THEN 'no header of two numbers' "
    "WHEN 1 THEN 'invalid character ' || chr(39) || '!' || chr(39) WHEN 2 THEN 'too few sites' WHEN 3 THEN 'too many characters' WHEN 4 THEN 'lines are missing' ELSE 'rows of a group differ in length' END AS error FROM documents",
)
def s2(spark, sf_dir):
    """Whole texts as they are, and alignments of their letters with one fault each."""
    letters = F.coalesce(F.regexp_replace("text", "[^ACGTacgt]", ""), F.lit(""))
    name, n = "taxon     ", F.length(letters)
    kinds = [
        F.col("text"),
        F.concat(F.lit("1 "), n + 1, F.lit("\n" + name), letters, F.lit("!")),
        F.concat(F.lit("1 "), n + 1, F.lit("\n" + name), letters),
        F.concat(F.lit("1 "), n, F.lit("\n" + name), letters, F.lit("A")),
        F.concat(F.lit("2 "), n + 1, F.lit("\n" + name), letters),
        F.concat(F.lit("2 "), n + 5, F.lit("\n" + name), letters, F.lit("\n" + name), letters, F.lit("A")),
    ]
    text = F.element_at(F.array(*kinds), F.pmod(F.col("doc_id"), F.lit(6)).cast("int") + 1)
    files = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("value"))
    return phylip.parsed(files).filter("error is not null").select("path", "line", "error")


@register("s4_weighted_phylip", f"WITH {CHUNK}, {RECODED} SELECT aln_id, string_agg(CAST(weight AS VARCHAR), ' ' ORDER BY site) AS line FROM pats GROUP BY 1")
def s4(spark, sf_dir):
    lines = writers.phylip_lines(found_patterns(chunked(spark, sf_dir)), repeat=False)
    last = F.row_number().over(W.Window.partitionBy("aln_id").orderBy(F.desc("line_no")))
    return lines.withColumn("last", last).filter("last = 1").select("aln_id", "line")


@register("s5_s6_nexus_round_trip", QUARTET + " SELECT aln_id, newick || ';' AS newick FROM scored")
def s5(spark, sf_dir):
    found = quartets(spark, sf_dir)
    told = found.select("aln_id", F.xxhash64("parents").alias("tree_id"), trees.newick_text(F.col("parents")).alias("newick"), "score")
    labels = sites.enough_taxa(chunked(spark, sf_dir, 4)).select("aln_id", "taxon").distinct().withColumn("label", F.concat(F.lit("t"), F.col("taxon").cast("string")))
    lines = writers.nexus_lines(told, labels).select("aln_id", F.explode(F.split("line", "\n")).alias("value"))
    return phylip.newick_of_nexus(lines).select("aln_id", "newick")


@register("s8_incompatibility_graph")
def s8(spark, sf_dir):
    cells = chunked(spark, sf_dir)
    n = cells.groupBy("aln_id").agg(F.countDistinct("site").alias("sites"))
    return writers.dimacs_lines(bounds.incompatible_pairs(cells), n)


@register("s7_bound_lines", f"WITH {EMB}, {REST} SELECT aln_id, CAST(k AS VARCHAR) || chr(9) || CAST(bound AS VARCHAR) AS line FROM rest WHERE k >= 2")
def s7(spark, sf_dir):
    found = prefixes.rest_bound(emb(spark, sf_dir)).filter("k >= 2")
    return found.select("aln_id", F.concat_ws("\t", "k", "bound").alias("line"))


PARTS = f"""WITH {EMB}, {SEEN}, u AS (SELECT aln_id, site, count(*) - greatest(count(*) FILTER (mask = 1), count(*) FILTER (mask = 2), count(*) FILTER (mask = 4), count(*) FILTER (mask = 8)) AS upper, greatest(count(DISTINCT mask) - 1, 0) AS lower FROM cells GROUP BY 1, 2),
  p AS (SELECT aln_id, site // 5 AS part_id, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper, count(*) AS width FROM u GROUP BY 1, 2),
  a AS (SELECT aln_id, site // 5 AS part_id, count(*) FILTER (taxon >= 3 AND (mask & ~seen) <> 0) AS additive FROM seen_ GROUP BY 1, 2),
  parts AS (SELECT p.*, additive, greatest(additive, lower - upper) AS final FROM p JOIN a USING (aln_id, part_id))"""


@register("s11_partition_statistics", PARTS + " SELECT aln_id, part_id, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper, CAST(sum(additive) AS BIGINT) AS additive, CAST(sum(final) AS BIGINT) AS final, min(width) AS narrowest, max(width) AS widest, round(avg(width), 6) AS mean_width FROM parts GROUP BY ROLLUP (aln_id, part_id) HAVING aln_id IS NOT NULL")
def s11(spark, sf_dir):
    cells, part = emb(spark, sf_dir), F.floor(F.col("site") / 5)
    bound = sites.columns(cells).groupBy("aln_id", part.alias("part_id")).agg(F.sum(sites.site_lower_bound()).alias("lower"), F.sum(sites.site_upper_bound()).alias("upper"), F.count("*").alias("width"))
    parts = bound.join(prefixes.additive_scores(cells, part, 3), ["aln_id", "part_id"])
    parts = parts.withColumn("final", dna.part_score("additive", F.col("lower"), F.col("upper"), F.col("additive")))
    return writers.part_statistics(parts).withColumn("mean_width", F.round("mean_width", 6))


@register("s11_partition_lines", f"WITH {EMB}, p AS (SELECT aln_id, taxon, site // 5 AS part_id, string_agg({LETTER}, '' ORDER BY site) AS text FROM cells GROUP BY 1, 2, 3) SELECT aln_id, taxon, string_agg(text, '|' ORDER BY part_id) AS line FROM p GROUP BY 1, 2")
def s11b(spark, sf_dir):
    return writers.partition_lines(emb(spark, sf_dir), F.floor(F.col("site") / 5))


@register("s11_partition_totals")
def s11c(spark, sf_dir):
    """Totals of the parts of ``h6_part_bounds``."""
    return writers.partition_totals(h6(spark, sf_dir))


@register("p13_broken_trees", QUARTET + """, shapes(newick, v, parent) AS (SELECT newick, unnest(range(6)), unnest(p) FROM (VALUES ('(1,2,(3,4))', [-1, 3, 5, 0, 5, 3]), ('(1,(2,4),3)', [-1, 5, 3, 0, 5, 3]), ('(1,(2,3),4)', [-1, 3, 3, 5, 5, 0])) t(newick, p)),
  bent AS (SELECT newick, d AS bent, v, CASE WHEN v = d THEN (parent + 1) % 6 ELSE parent END AS parent FROM shapes, generate_series(1, 5) t(d)),
  kids AS (SELECT a.newick, a.bent, a.v, count(b.v) AS n FROM bent a LEFT JOIN bent b ON b.newick = a.newick AND b.bent = a.bent AND b.parent = a.v GROUP BY 1, 2, 3),
  faults AS (SELECT newick, bent, count(*) FILTER (n <> CASE WHEN v = 0 THEN 1 WHEN v IN (3, 5) THEN 2 ELSE 0 END) AS n_faults FROM kids GROUP BY 1, 2)
  SELECT aln_id, newick, CAST(bent AS INTEGER) AS bent, n_faults FROM scored JOIN faults USING (newick)""")
def p13b(spark, sf_dir):
    """Every tree of four taxa with one node at a time hung on the next node."""
    found = quartets(spark, sf_dir).withColumn("newick", trees.newick_text(F.col("parents"))).withColumn("bent", F.explode(F.sequence(F.lit(1), F.lit(5))))
    parents = F.transform("parents", lambda p, v: F.when(v == F.col("bent"), (p + 1) % 6).otherwise(p))
    keys = ["aln_id", "newick", "bent"]
    faults = trees.structure_faults(trees.node_table(found.select(*keys, parents.alias("parents"))), keys).groupBy(*keys).agg(F.count("*").alias("n_faults"))
    return found.select(*keys).join(faults, keys, "left").select(*keys, F.coalesce("n_faults", F.lit(0).cast("long")).alias("n_faults"))


ORACLE |= bound_sql.oracles(EMB, EVT, CHUNK, chunk_sql(6), FORCED, RECODED, RUNNING, SITE_PAIR, PAIR, SEEN)
ORACLE["o2_rounds_max_min_order"], ORACLE["o3_rounds_max_sum_order"] = ORACLE["o2_max_min_order"], ORACLE["o3_max_sum_order"]
ORACLE["t6_waves_exact_search"] = ORACLE["t6_exact_search"]
ORACLE["h13_s7_real_bounds"] = (
    f"WITH added AS ({ORACLE['h5_incompatibility_bound']}), tied AS ({ORACLE['h3_spanning_rest_bound']}), "
    f"shown AS (WITH {CHUNK}, {REST}, big AS (SELECT aln_id FROM cells GROUP BY 1 HAVING count(DISTINCT taxon) >= 4) SELECT rest.* FROM rest JOIN big USING (aln_id)) "
    "SELECT shown.aln_id, shown.k, CAST(greatest(shown.bound + CASE WHEN shown.k = 2 THEN 0 ELSE coalesce(added.bound, 0) END, coalesce(tied.bound, 0)) AS BIGINT) AS bound FROM shown "
    "LEFT JOIN added ON added.aln_id = shown.aln_id AND added.k = shown.k LEFT JOIN tied ON tied.aln_id = shown.aln_id AND tied.k = shown.k"
)
ORACLE["s11_partition_totals"] = (
    f"WITH parts AS ({ORACLE['h6_part_bounds']}) SELECT aln_id, count(*) AS n_parts, CAST(sum(width) AS BIGINT) AS width, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper, CAST(sum(lower - upper) AS BIGINT) AS raw, "
    "CAST(sum(greatest(lower - upper, 0)) AS BIGINT) AS clipped, CAST(sum(additive) AS BIGINT) AS additive, CAST(sum(final) AS BIGINT) AS final, min({'w': width, 'p': part_id}).p AS narrowest, min({'w': -width, 'p': part_id}).p AS widest FROM parts GROUP BY 1"
)
