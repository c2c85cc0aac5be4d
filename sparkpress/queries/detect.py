"""Document types and code symbols, on literal fixtures (the shared documents have neither fences nor code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, doctype, lines
from .registry import fixture, query, table, values

MIXED = [
    (1, "The service accepts requests from clients and answers them quickly."), (1, "It runs on three machines in one region today."), (1, "def load(path):"), (1, "    return open(path).read()"), (1, "if ready: start();"),
    (2, "2024-01-01 10:00:00 INFO started"), (2, "2024-01-01 10:00:01 ERROR failed to open"), (2, "2024-01-01 10:00:02 INFO done"), (3, "user: hello there"), (3, "assistant: hi"), (3, "user: open ticket"), (3, "Some words"),
    (4, "{"), (4, '"a": 1,'), (4, '"b": [2]'), (4, "}"), (5, "# Title"), (5, "- item one"), (5, "- item two"), (5, "Text of the page goes here, and it ends."), (6, "SELECT a FROM t"), (6, "WHERE b = 1"), (7, "| a | b |"), (7, "| 1 | 2 |"),
]
ROWS = [(d, i, line) for i, (d, line) in enumerate(MIXED, 1)]
REGION = [(1, 1, "prose", 10), (1, 2, "prose", 12), (1, 3, "code", 8), (1, 4, "code", 5), (1, 5, "prose", 9), (2, 1, "prose", 50), (2, 2, "conversation", 30), (3, 1, "prose", 60), (3, 2, "markdown", 25), (4, 1, "logs", 7)]
_G = f"(SELECT * FROM ({values(REGION)}) t(doc_id, n, label, chars))"
FILES = [
    (1, "import os\n\ndef area(w, h):\n    if w < 0:\n        return 0\n    return w * h\n\nclass Box:\n    \"\"\"A box.\"\"\"\n    def size(self):\n        return area(self.w, self.h)\n"),
    (2, "def surface(a, b):\n    if a < 0:\n        return 0\n    return a * b\n\ndef other(x):\n    return surface(x, x)\n"),
    (3, "this is not code at all"), (4, "def broken(:\n    return\nif x\n"),
]


@query("line_scores")
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctype.line_scores(fixture(spark, ROWS, "doc_id long, n long, line string"))


@query("line_labels")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctype.labelled(doctype.line_scores(fixture(spark, ROWS, "doc_id long, n long, line string")))


@query("document_types")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.line_offsets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("line_no").alias("n"), "line")
    return doctype.document_type(doctype.regions(doctype.labelled(doctype.line_scores(rows))))


@query("regions", f"WITH f AS (SELECT *, CASE WHEN label <> coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY n), '') THEN 1 ELSE 0 END AS fresh FROM {_G}), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS region FROM f) SELECT doc_id, CAST(region AS BIGINT) AS region, label, min(n) AS first_line, max(n) AS last_line, CAST(sum(chars) AS BIGINT) AS chars, avg(0.5::DOUBLE) AS confidence FROM r GROUP BY doc_id, region, label")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctype.regions(fixture(spark, REGION, "doc_id long, n long, label string, chars long").withColumn("confidence", F.lit(0.5)))


@query("doctype_of_regions", f"WITH m AS (SELECT doc_id, label, sum(chars) AS m FROM {_G} GROUP BY doc_id, label), s AS (SELECT *, m / sum(m) OVER (PARTITION BY doc_id) AS share FROM m), a AS (SELECT doc_id, max_by(label, struct_pack(share, label)) AS top, max(share) AS share, coalesce(max(share) FILTER (label = 'conversation'), 0) AS c, coalesce(max(share) FILTER (label = 'markdown'), 0) AS d FROM s GROUP BY doc_id) SELECT doc_id, CASE WHEN top = 'prose' AND c >= 0.3 THEN 'conversation' WHEN top = 'prose' AND d >= 0.25 THEN 'markdown' ELSE top END AS doctype, round(share, 6) AS share FROM a")
def doctype_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctype.document_type(fixture(spark, REGION, "doc_id long, n long, label string, chars long")).withColumn("share", F.round("share", 6))


@query("code_symbols")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(fixture(spark, FILES, "file_id long, text string"))


@query("code_dependencies")
def code_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.dependencies(code.symbols(fixture(spark, FILES, "file_id long, text string")))


@query("code_duplicates")
def code_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.structural_duplicates(code.symbols(fixture(spark, FILES, "file_id long, text string")))
