"""Lines, blocks, fences, sentences and budgets, as windows over exploded text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def line_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, start, stop, line): each line with its character offsets."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    through = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(key, (F.col("line_no") + 1).cast("long").alias("line_no"), (through - F.length("line") - 1).alias("start"), (through - 1).alias("stop"), "line")


def blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, first_line, last_line, chars) of runs of lines that aren't blank."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    blank = F.trim("line") == ""
    rows = rows.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("n")))
    number = lambda c: (c + 1).cast("long")
    return rows.where(~blank).groupBy(key, "block").agg(number(F.min("n")).alias("first_line"), number(F.max("n")).alias("last_line"), F.sum(F.length("line")).cast("long").alias("chars"))


def truncate(docs: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, head, tokens): the longest run of pieces from the start that costs at most the budget."""
    pieces = docs.select(key, F.posexplode(T.matches(F.col("text"), T.PIECES)).alias("n", "piece"))
    used = F.sum(T.piece_cost(F.col("piece"))).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = pieces.withColumn("used", used).where(F.col("used") <= budget)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("head"), F.max("used").cast("long").alias("tokens"))


def flags(rows: DataFrame, patterns: dict[str, str], column: str = "line") -> DataFrame:
    """One Boolean column for each pattern."""
    return rows.select("*", *[T.has(F.col(column), p).alias(name) for name, p in patterns.items()])


def simple_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, sentence) of the rule in ``text.sentence_array``."""
    parts = docs.select(key, F.posexplode(T.sentence_array(F.col("text"))).alias("n", "sentence"))
    return parts.select(key, (F.col("n") + 1).cast("long").alias("n"), F.trim("sentence").alias("sentence")).where("sentence <> ''")


def sentence_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, start, stop, sentence): trimmed sentences with their character offsets, each document's by a running sum inside its own array."""
    s = T.sentence_array(F.col("text"))
    ends = F.aggregate(F.transform(s, F.length), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    parts = docs.where("text IS NOT NULL").select(key, F.posexplode(F.arrays_zip(s.alias("s"), ends.alias("at"))).alias("n", "x")).where("x.s IS NOT NULL")
    lead = F.length("x.s") - F.length(F.regexp_replace("x.s", r"^\s+", ""))
    body = F.regexp_replace("x.s", r"^\s+|\s+$", "")
    found = parts.select(key, (F.col("n") + 1).cast("long").alias("n"), (F.col("x.at") + lead).cast("long").alias("start"), body.alias("sentence")).where("sentence <> ''")
    return found.select(key, "n", "start", (F.col("start") + F.length("sentence")).alias("stop"), "sentence")


def fences(rows: DataFrame) -> DataFrame:
    """Label lines (doc_id, n, line): fence lines are markdown, lines inside a fence have its language or 'code', others are 'open'."""
    order = Window.partitionBy("doc_id").orderBy("n")
    mark = F.col("line").rlike(r"^[ ]*(~~~|```)")
    language = F.last(F.when(F.col("mark"), F.regexp_extract("line", r"^[ ]*(~~~|```)([a-z]*)", 2)), ignorenulls=True).over(order)
    marked = rows.withColumn("mark", mark).withColumn("opened", F.sum(F.when(F.col("mark"), 1).otherwise(0)).over(order)).withColumn("language", language)
    label = F.when(F.col("mark"), "markdown").when(F.col("opened") % 2 == 1, F.when(F.col("language") == "", "code").otherwise(F.col("language"))).otherwise("open")
    return marked.select("doc_id", "n", "line", label.alias("label"))
