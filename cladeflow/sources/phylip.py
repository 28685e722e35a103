"""Reading PHYLIP alignments and tree files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.dna import LETTER_MASKS

LABEL = 10
#: The largest number of a header: taxa and sites are counted in 32 bits. Longer rows of digits, such as card numbers, are no header.
MOST = (1 << 31) - 1
SKIPPED = dict.fromkeys(map(ord, " \t\r0123456789"))
LETTERS = set(LETTER_MASKS) | {c.lower() for c in LETTER_MASKS}
SCHEMA = "path string, taxon long, label string, seq string, line int, error string"


class BadLine(ValueError):
    def __init__(self, line: int, error: str):
        super().__init__(error)
        self.line = line


def parse(text: str) -> list[tuple[str, str]]:
    """Labels and letters of the first alignment in a PHYLIP text, sequential or interleaved; what follows is not read.

    A label fills the first ten columns and may hold blanks. Blanks, tabs and digits among the letters, blank lines, either
    case and any line ends are taken. Raises BadLine for what is no alignment."""
    lines = text.split("\n")
    head = lines[0].split()
    if len(head) < 2 or not all(x.isascii() and x.isdigit() and len(x) < 19 and int(x) <= MOST for x in head[:2]) or int(head[0]) < 1:
        raise BadLine(1, "no header of two numbers")
    n, length = int(head[0]), int(head[1])
    labels: list[str] = []
    rows: list[list[str]] = []  # grows with the labels, whatever the header says
    sizes: list[int] = []
    taxon = 0
    for number, line in enumerate(lines[1:], 2):
        if len(labels) == n and min(sizes) >= length:
            break
        line = line.rstrip("\r")
        if not line.strip():
            continue
        if len(labels) < n:
            labels.append(line[:LABEL].strip())
            rows.append([])
            sizes.append(0)
            line = line[LABEL:]
        letters = line.translate(SKIPPED)
        if not LETTERS.issuperset(letters):
            raise BadLine(number, f"invalid character {next(c for c in letters if c not in LETTERS)!r}")
        rows[taxon].append(letters)
        sizes[taxon] += len(letters)
        if sizes[taxon] > length:
            raise BadLine(number, "too many characters")
        if taxon and sizes[taxon] != sizes[0]:
            raise BadLine(number, "rows of a group differ in length")
        taxon = (taxon + 1) % n
    if len(labels) < n or taxon:
        raise BadLine(len(lines), "lines are missing")
    if min(sizes) < length:
        raise BadLine(len(lines), "too few sites")
    return [(label, "".join(row)) for label, row in zip(labels, rows)]


def read_phylip(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``sequences`` (path, taxon, label, seq) of all good files and ``rejects`` (path, line, error) of all others.

    A file is a row of a task's input and is parsed there; a bad file does not stop the others."""
    found = parsed(spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value"))
    return found.filter("error is null").select("path", "taxon", "label", "seq"), found.filter("error is not null").select("path", "line", "error")


def parsed(files: DataFrame) -> DataFrame:
    """Sequences and errors of texts (path, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, t, label, seq, None, None) for t, (label, seq) in enumerate(parse(text or ""))]
                except BadLine as bad:
                    rows = [(path, None, None, None, bad.line, str(bad))]
                columns = list(zip(*rows))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "taxon", "label", "seq", "line", "error"])

    return files.select("path", "value").mapInArrow(run, SCHEMA)


def newick_of_nexus(lines: DataFrame) -> DataFrame:
    """Name and Newick text of the tree lines among lines of NEXUS text (column ``value``)."""
    line = r"(?i)^\s*U?TREE\s+\*?\s*('[^']*'|[^\s=]+)\s*=\s*(?:\[&[RU]\]\s*)?(.*;)\s*$"
    trees = lines.filter(F.col("value").rlike(line))
    others = [c for c in lines.columns if c != "value"]
    return trees.select(*others, F.regexp_extract("value", line, 1).alias("name"), F.regexp_extract("value", line, 2).alias("newick"))
