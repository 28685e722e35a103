"""Spelling variants: words within one edit of each other, and the frequent form that a rare one stands for.

Asymmetric q-chunks. Of two words one contributes disjoint chunks, its two halves, and the other all grams of that
length within shift one of the place of a chunk. One insertion, deletion or replacement leaves a half whole. A half
alone is shared by too many words of a language, so that the rule is applied once more to what the edit can have
touched: of the other half, one of its two halves is whole too. A key is therefore a word without one of its quarters:
four keys a word in place of two, and far fewer words for each. The shorter word of a pair gives the chunks, of words of
one length the first; a pair that meets under several keys counts under the first of them that it shares, so that no
pair has to be made distinct.

All steps are Spark functions. Words, not their occurrences, are joined: their number grows with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.shared_files import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the shortest word; occurrences of the rarest.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form stands for words that occur at most once for so many of its own occurrences.
RATIO = 10
#: One in so many runs of a document loses a letter.
DELETED = 31


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and its occurrences ``n`` over whole texts: runs of letters, A-Z in lower case, of which those whose checksum
    with the document's id is divisible by 31 lose one code point. Null texts have no words; a null id counts as empty."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    # a document's repeats of a run go the same way
    code = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("code") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("code", code).select(F.when(F.col("code") % DELETED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


def _cut(length: Column, quarter: int) -> Column:
    """Where a quarter of a word begins."""
    return F.floor(length * quarter / 4).cast("int")


def _without(word: Column, length: Column, quarter: int, shift: int) -> list[Column]:
    """What is left and right of a quarter of a word of ``length`` code points, in a word that is longer by ``shift``."""
    left, right = _cut(length, quarter), _cut(length, quarter + 1)
    return [F.substring(word, F.lit(1), left), F.substring(word, right + 1 + shift, length + 1)]


def _keys(words: DataFrame, shift: int, name: str) -> DataFrame:
    """The four keys of each word as one of a pair whose shorter word has ``shift`` code points less."""
    length = F.length("word") - shift
    keys = F.array(*[F.xxhash64(length, F.lit(q), *_without(F.col("word"), length, q, shift)) for q in range(4)])
    return words.filter(length >= LEAST_LENGTH).select(F.posexplode(keys).alias("quarter", "key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))


def near_words(words: DataFrame) -> DataFrame:
    """Every two of the distinct ``words`` (word, n) that differ by exactly one inserted, deleted or replaced code point, once:
    ``x``, ``n_x``, ``y``, ``n_y``, the shorter one first."""
    chunks = _keys(words, 0, "x")
    grams = [_keys(words, shift, "y").withColumn("shift", F.lit(shift)) for shift in (0, 1)]
    met = chunks.join(grams[0].unionByName(grams[1]), ["key", "quarter"]).filter((F.col("shift") == 1) | (F.col("x") < F.col("y")))
    near = met.filter(F.levenshtein("x", "y", 1) == 1)
    length = F.length("x")
    shares = []
    for q in range(4):
        one = _without(F.col("x"), length, q, 0)
        two = [F.when(F.col("shift") == s, F.concat_ws("\n", *_without(F.col("y"), length, q, s))) for s in (0, 1)]
        shares.append(F.concat_ws("\n", *one) == F.coalesce(*two))
    # a key is a hash: its quarter must be one that both share, and the first such
    first = F.when(shares[0], 0).when(shares[1], 1).when(shares[2], 2).when(shares[3], 3)
    return near.filter(F.col("quarter") == first).select("x", "n_x", "y", "n_y")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Of each word of ``docs`` (doc_id, text): its ``form``, the ``root`` at the end of its forms, its count ``n``, the number of
    near words ``n_near``, and the form's count ``form_n``.

    A word's form is its near word of largest count, of equals the first in code-point order, if it occurs at least ten times as
    often; null otherwise. Words with no form are their own root. An empty table, and null, empty or wordless texts, give no rows;
    repeated rows count as often as they stand there; other columns are not read."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    words = tables.store(word_counts(docs))
    pairs = near_words(words)
    sides = F.inline(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("m")), F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("n_x").alias("m"))))
    best = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    clear = -F.col("best.less") >= RATIO * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(clear, F.col("best.other")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n")
    )
    found = tables.store(found)
    tables.drop(words)
    # each form occurs ten times as often as the word before it, so that their number is that of a count's digits
    most = found.agg(F.max("n")).first()[0] or 0
    links, steps = 0, LEAST_COUNT * RATIO
    while steps <= most:
        links, steps = links + 1, steps * RATIO
    top = found.filter("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < links:
        after = top.select(F.col("word").alias("root"), F.col("root").alias("further"))
        top = top.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    whole = found.join(top, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
