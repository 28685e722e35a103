"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm.decontaminate import contaminated, decontaminate
from cladeflow.llm.jaccard_join import similar_documents
from cladeflow.llm.language import detect_language, fit_languages
from cladeflow.llm.mixing import mix_sources
from cladeflow.llm.packing import pack
from cladeflow.llm.paragraphs import sized_paragraphs
from cladeflow.llm.quality import score_quality
from cladeflow.llm.secrets import find_secrets
from cladeflow.llm.sharding import shard_by_bytes
from cladeflow.llm.spelling import spelling_variants
from cladeflow.llm.suffixes import repeated_passages
from cladeflow.llm.vectors import similar_vectors
from cladeflow.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def held_out():
    """One document in four is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~held_out()))
    found = detect_language(docs, model, ["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score", "ambiguous").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("row.doc_id", "p_text", "p_meta", "score", "good")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(c)
    return found.select("doc_id", "n_repeated", "n_removed", told("repeated"), told("removed"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_paragraphs(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), ["doc_id"])
    law = F.lit("bytes").alias("law")
    return placed.select("row.doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_mixing": op13_mixing,
}

WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Queries that plain SQL expresses. The others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_decontamination": f"""WITH d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS ws FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
  k AS (SELECT item, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
  windows AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM k)),
  widths AS (SELECT DISTINCT k FROM windows),
  places AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, widths WHERE len(ws) >= k)),
  hits AS (SELECT doc_id, i, places.k AS k, item FROM places JOIN windows ON places.k = windows.k AND places.win = windows.win),
  words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS w FROM hits) GROUP BY 1),
  items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY 1)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.format("text")}, []) AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS sh FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
    FROM (SELECT *, least(5, len(ws)) AS k FROM d WHERE len(ws) > 0))),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
  reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN links ON other = a)
  SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM d JOIN reach ON id = doc_id GROUP BY doc_id""",
    "op5_suffix_dedup": f"""WITH d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, i - 1 AS start, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
  ends AS (SELECT h, min(doc_id) AS low FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
  f AS (SELECT doc_id, start, doc_id > low AS later FROM p JOIN ends USING (h)),
  kinds AS (SELECT 'repeated' AS kind, doc_id, start FROM f UNION SELECT 'removed', doc_id, start FROM f WHERE later),
  marked AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY kind, doc_id ORDER BY start) <= 50 THEN 0 ELSE 1 END AS fresh FROM kinds),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, doc_id ORDER BY start) AS nr FROM marked),
  spans AS (SELECT kind, doc_id, min(start) AS a, max(start) + 50 AS b FROM numbered GROUP BY kind, doc_id, nr),
  told AS (SELECT kind, doc_id, CAST(sum(b - a) AS BIGINT) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS t FROM spans GROUP BY 1, 2)
  SELECT r.doc_id, r.n AS n_repeated, coalesce(x.n, 0) AS n_removed, r.t AS repeated, coalesce(x.t, '') AS removed
  FROM (SELECT * FROM told WHERE kind = 'repeated') r LEFT JOIN (SELECT * FROM told WHERE kind = 'removed') x USING (doc_id)""",
    "op7_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN links ON other = a)
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept FROM v JOIN reach ON id = vec_id GROUP BY vec_id""",
    # the checksum is made byte by byte; words within one edit share a word with one code point less at one place
    "op11_spelling": """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  g AS (SELECT doc_id, run, count(*) AS n, lower(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run))) AS x FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
  h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: 16 * (strpos('0123456789abcdef', x[2 * i + 1]) - 1) + strpos('0123456789abcdef', x[2 * i + 2]) - 1)), lambda c, b: xor(c >> 8, t.t[xor(c & 255, b) + 1]))) AS h FROM g, t),
  d AS (SELECT n, CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
  less AS (SELECT DISTINCT word, n, i, word[1:i - 1] || word[i + 1:] AS w FROM (SELECT *, unnest(generate_series(1, length(word))) AS i FROM v)),
  one AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM less a JOIN less b ON a.w = b.w AND a.i = b.i AND a.word <> b.word
    UNION SELECT v.word, less.word, less.n FROM v JOIN less ON v.word = less.w UNION SELECT less.word, v.word, v.n FROM v JOIN less ON v.word = less.w),
  best AS (SELECT x AS word, count(*) AS n_near, min({'less': -m, 'y': y}) AS b FROM one GROUP BY 1),
  f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.y END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
  walk(word, last, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.last WHERE f.form IS NOT NULL),
  root AS (SELECT word, max({'step': step, 'last': last}).last AS root FROM walk GROUP BY 1)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)""",
}
