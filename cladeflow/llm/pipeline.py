"""Stages of the corpus pipeline. Every stage but the last returns the columns of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm.decontaminate import contaminated, decontaminate
from cladeflow.llm.jaccard_join import similar_documents
from cladeflow.llm.language import UNDETERMINED, detect_language, fit_languages
from cladeflow.llm.packing import pack
from cladeflow.llm.queries import held_out, table, tokenizer_path
from cladeflow.llm.secrets import mask_secrets
from cladeflow.llm.shared_files import Tables


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: null texts and texts without a letter, and those for which no language gets half of the score. Repeated rows
    are decided alike; without a labelled document all go, as nothing can be told."""
    model = fit_languages(docs.filter(~held_out()))
    found = detect_language(docs, model, docs.columns)
    return _rows(found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; of rows with one id and text, one.

    Texts without words, null ones too, are copies of nothing. Documents that share an id, or have none, stay together
    or go together. An empty table stays empty.
    """
    tables = Tables(spark)
    found = similar_documents(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    kept = tables.store(kept)
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column's name can clash with another
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    # the kept ids grow with the documents: no broadcast at any size
    told = renamed.join(kept.hint("merge"), renamed[doc_id].eqNullSafe(kept["_kept"]))
    lone = told.filter("_rows = 1").select(*renamed.columns)
    several = told.filter("_rows > 1").select(*renamed.columns).dropDuplicates([doc_id, text])
    return lone.unionByName(several).toDF(*names)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: some word lies in a window of the benchmark, and at least one in twenty. Null and empty
    texts stay, repeated rows are decided alike; an empty benchmark or table takes nothing away."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return _rows(found.filter(~contaminated()), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; ``n_chars`` follows the text. No document goes; a null text stays null."""
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null or empty text is the end id alone; repeated rows are
    packed as often as they stand there; an empty table gives no pieces."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for at, (_, stage) in enumerate(STAGES[:-1]):
        kept = tables.store(stage(spark, docs, sf_dir))
        if at:
            tables.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
