"""What is promised of the driver's tables: held-out accuracy, and plans without Python."""

import os

import pytest
from pyspark.sql import functions as F

from cladeflow.llm.quality import score_quality
from cladeflow.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_languages_of_held_out_documents(spark):
    found = QUERIES["op3_language_id"](spark, SF).filter("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right >= 0.99 * n


def test_quality_of_labelled_documents(spark):
    found = QUERIES["op4_quality"](spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("quality is not null")
    n, right, most = found.agg(F.count("*"), F.count_if(F.col("good") == (F.col("quality") == 1)), F.count_if(F.col("quality") == 1)).first()
    assert n > 100 and right >= max(most, 0.95 * n)


@pytest.fixture(scope="module")
def told(spark):
    """Shares of right answers on labels not learnt from, by view, before and after rounds of co-training on 40 labels."""
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    kept = labels.filter("quality is not null").orderBy(F.xxhash64(F.lit(1), "doc_id")).limit(40).collect()
    kept = spark.createDataFrame(kept, labels.schema)
    asked = labels.filter("quality is not null").join(kept.select("doc_id"), "doc_id", "left_anti")

    def shares(rounds):
        found = score_quality(docs, kept, ["doc_id"], rounds).select("row.doc_id", "p_text", "p_meta", "score").join(asked, "doc_id")
        right = [F.avg(((F.col(c) >= 0.5) == (F.col("quality") == 1)).cast("int")).alias(c) for c in ("p_text", "p_meta", "score")]
        return found.agg(F.avg("quality").alias("most"), *right).first()

    return shares(0), shares(2)


def test_metadata_alone_beat_the_majority(told):
    for found in told:
        assert found["p_meta"] > found["most"] + 0.03


def test_views_teach_each_other(told):
    before, after = told
    print(before, after)
    assert after["p_text"] >= before["p_text"] and after["p_meta"] >= before["p_meta"] and after["score"] >= before["score"]
    assert after["p_text"] + after["p_meta"] > before["p_text"] + before["p_meta"]


def test_sharding_runs_without_python(spark):
    plan = QUERIES["op10_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))
