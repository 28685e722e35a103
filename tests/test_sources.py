import glob

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import sites
from cladeflow.sources import phylip, writers
from cladeflow.sources.phylip import BadLine, newick_of_nexus, parse, read_phylip

GOOD = "4 5\r\nT1        ACG\r\nT2        ACG\r\nT3        ACG\r\nT 4       acg\r\n\r\nTA\r\nTC\r\nTG\r\nTT"


def test_interleaved_with_odd_line_ends_and_labels():
    assert parse(GOOD) == [("T1", "ACGTA"), ("T2", "ACGTC"), ("T3", "ACGTG"), ("T 4", "acgTT")]
    assert parse("2 4\na\t\t\t\t\t\t\t\t\t1 A C\tG2T\nbbbbbbbbbb  AC GT\nnext one") == [("a", "ACGT"), ("bbbbbbbbbb", "ACGT")]


@pytest.mark.parametrize(
    "text, error",
    [
        ("", "header"), ("x y\n", "header"), ("2 4\na         ACGT\n", "missing"), ("2 4\na         ACGTA\n", "too many"), ("2 4\na         ACXT\n", "invalid"),
        ("2 4\na         ACG\nb         AC\n", "differ"), ("2 4\na         AC\nb         AC\n", "too few"), ("2 4\na         AC\nb         AC\nGT\n", "missing"),
    ],
)
def test_what_is_rejected(text, error):
    with pytest.raises(BadLine, match=error):
        parse(text)


def test_read_write_and_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.phy").write_text(GOOD)
    (tmp_path / "in/b.phy").write_text("2 4\na         ACXT\n")
    sequences, rejects = read_phylip(spark, str(tmp_path / "in"))
    assert [(r["path"][-5:], r["line"]) for r in rejects.collect()] == [("b.phy", 2)]
    cells = sites.cells_from_sequences(sequences.withColumnRenamed("path", "aln_id").withColumn("aln_id", F.lit("a")))
    found = sites.patterns(sites.columns(cells)).withColumn("weight", F.when(F.col("site") == 1, 3).otherwise(1).cast("long"))
    labels = sequences.select(F.lit("a").alias("aln_id"), "taxon", "label")
    lines = [r["line"] for r in writers.phylip_lines(found, labels).orderBy("line_no").collect()]
    assert lines == ["4 7", "T1        ACCCGTA", "T2        ACCCGTC", "T3        ACCCGTG", "T 4       ACCCGTT"]
    once = [r["line"] for r in writers.phylip_lines(found, None, repeat=False).orderBy("line_no").collect()]
    assert once[0] == "4 5" and once[1] == "T1        ACGTA" and once[-1] == "1 3 1 1 1"
    writers.write_lines(writers.phylip_lines(found, labels), str(tmp_path / "out"))
    (name,) = glob.glob(f"{tmp_path}/out/aln_id=a/*.txt")
    assert parse(open(name).read()) == [("T1", "ACCCGTA"), ("T2", "ACCCGTC"), ("T3", "ACCCGTG"), ("T 4", "ACCCGTT")]


def test_nexus_there_and_back(spark):
    trees = spark.createDataFrame([("a", 5, "(1,2,(3,4))", 7), ("a", 9, "(1,3,(2,4))", 7)], "aln_id string, tree_id long, newick string, score long")
    labels = spark.createDataFrame([("a", i, f"t{i}") for i in range(4)], "aln_id string, taxon long, label string")
    text = "\n".join(r["line"] for r in writers.nexus_lines(trees, labels).orderBy("line_no").collect())
    assert text.startswith("#NEXUS") and "\t\t4 t3\n\t\t;" in text and "1 t0," in text and text.endswith("END;")
    lines = spark.createDataFrame([(x,) for x in text.split("\n") + ["tree 'PAUP 1' = [&U] ((1,2),3,4);\r", "TREEFARM = no;"]], "value string")
    assert [tuple(r) for r in newick_of_nexus(lines).collect()] == [("T_1", "(1,2,(3,4));"), ("T_2", "(1,3,(2,4));"), ("'PAUP 1'", "((1,2),3,4);")]


def test_bounds_and_graphs(spark, tmp_path):
    bounds = spark.createDataFrame([("a", k, 10 - k) for k in range(5)], "aln_id string, k long, bound long")
    writers.write_bounds(bounds, str(tmp_path / "bounds"))
    back = writers.read_bounds(spark, str(tmp_path / "bounds"))
    assert sorted((r["aln_id"], r["k"], r["bound"]) for r in back.collect()) == [("a", 2, 8), ("a", 3, 7), ("a", 4, 6)]
    pairs = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 2, 4), ("a", 1, 2, 3)], "aln_id string, p long, q long, onset long")
    n = spark.createDataFrame([("a", 3)], "aln_id string, sites long")
    lines = {k: [r["line"] for r in writers.dimacs_lines(pairs, n).filter(F.col("k") == k).orderBy("line_no").collect()] for k in (3, 4)}
    assert lines == {3: ["p clq 2 3", "e 1 2", "e 1 3"], 4: ["p clq 1 3", "e 1 2"]}


def test_prefixes_and_statistics(spark):
    rows = [("a", t, "ACGT"[t]) for t in range(4)] + [("b", t, "A") for t in range(2)]
    found = writers.prefix_datasets(spark.createDataFrame(rows, "aln_id string, taxon long, seq string"))
    assert {(r["aln_id"], r["k"]): r["count"] for r in found.groupBy("aln_id", "k").count().collect()} == {("a", 3): 3, ("a", 4): 4}
    parts = spark.createDataFrame([("a", 1, 3, 1, 2, 2, 4), ("a", 2, 1, 1, 0, 0, 2)], "aln_id string, part_id long, lower long, upper long, additive long, final long, width long")
    total = writers.part_statistics(parts).filter("part_id is null").first()
    assert (total["lower"], total["narrowest"], total["widest"], total["mean_width"]) == (4, 2, 4, 3.0)


def test_headers_that_are_no_plain_numbers(spark):
    texts = [("a", "² 3\nx         ACG"), ("b", "1000000000 5\nx         ACGTA"), ("c", "9" * 30 + " 2\nx         AC"), ("d", None)]
    rows = {r["path"]: (r["line"], r["error"]) for r in phylip.parsed(spark.createDataFrame(texts, "path string, value string")).collect()}
    none = (1, "no header of two numbers")
    assert rows == {"a": none, "b": (2, "lines are missing"), "c": none, "d": none}


def test_many_symbols_at_a_site(spark):
    rows = [("x", 0, t, "s%02d" % t) for t in range(12)] + [("x", 1, t, "s%02d" % t) for t in range(40)]
    found = {(r["site"], r["taxon"]): r["mask"] for r in sites.recoded_symbols(spark.createDataFrame(rows, "aln_id string, site long, taxon long, symbol string")).collect()}
    assert [found[0, t] for t in range(12)] == [1 << t for t in range(12)] and all(found[1, t] is None for t in range(40))


def test_two_long_rows_of_digits_are_no_header(spark, tmp_path):
    """Whole texts may begin with two card numbers; ``s2_rejected_texts`` holds them against its SQL."""
    import duckdb

    from cladeflow.queries import ORACLE, QUERIES

    texts = ["4703443633947811 4451718024887799 Achverber auf", "2147483648 4\na         ACGT", None, "1 4", "Acg", "", "4539578519535923 4251825953533393"]
    rows = [(6 * i if i in (0, 1, 6) else 6 * i + 1, text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["s2_rejected_texts"](spark, str(tmp_path)).select("path", "line", "error").collect()
    assert sorted(map(tuple, found)) == sorted(db.execute(ORACLE["s2_rejected_texts"]).fetchall())
