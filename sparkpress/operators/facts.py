"""Atomic facts ("obligations"): literal and phrase classes, overlap resolution, merging, audit."""

from __future__ import annotations

from collections.abc import Iterator
from re import compile as pattern_of

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T

WEIGHTS = {name: weight for name, _, weight, _ in lexicon.LITERALS} | {"constraint": 2.6, "negation": 2.2, "security": 3.0}
#: Classes that every output must keep; the rest is kept where the budget allows.
ENFORCED = ["security", "constraint", "negation", "number", "money", "percent", "quantity", "date", "json_key", "identifier", "uuid", "url", "email", "version", "path"]
CRITICAL = ["security", "constraint", "negation", "number", "money", "percent", "quantity", "date"]


def literals(units: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """(key, class, literal) of one literal class, one row for each match."""
    pattern = {c: p for c, _, _, p in lexicon.LITERALS}[name]
    return units.select(key, F.lit(name).alias("class"), F.explode(T.matches(F.col("text"), pattern)).alias("literal"))


def fact_key(name: Column, literal: Column) -> Column:
    """Class prefix and canonical literal; null for the numbers 0, 1 and 2 and identifiers under three characters, which carry too little."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for c, p, _, _ in lexicon.LITERALS for x in (c, p)]), name)
    canonical = F.regexp_replace(T.canonical(literal), "[/]+$", "")
    dull = (name.isin("number") & canonical.isin("0", "1", "2")) | (name.isin("identifier") & (F.length(canonical) < 3))
    return F.when(~dull, F.concat(prefix, F.lit(":"), canonical))


def clauses(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, clause) between sentence and clause punctuation."""
    parts = units.select(key, F.posexplode(F.split("text", "[.;!?\n]+")).alias("n", "clause"))
    return parts.select(key, (F.col("n") + 1).cast("long").alias("n"), F.trim("clause").alias("clause")).where("clause <> ''")


def phrases(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, class, literal, fact): clauses with a constraint, negation or security cue; a quantity cue counts beside a digit, in four words or more."""
    c = clauses(units, key)
    bound = T.has(F.col("clause"), lexicon.QUANTITY) & F.col("clause").rlike("[0-9]") & (F.size(T.words(F.col("clause"))) >= 4)
    classes = F.array_compact(F.array(F.when(T.has(F.col("clause"), lexicon.STRONG) | bound, "constraint"), F.when(T.has(F.col("clause"), lexicon.NEGATION), "negation"), F.when(T.has(F.col("clause"), lexicon.SECURITY), "security")))
    rows = c.select(key, F.explode(classes).alias("class"), F.col("clause").alias("literal"))
    return rows.select(key, "class", "literal", F.concat(F.substring("class", 1, 1), F.lit("c:"), F.substring(F.md5(T.canonical(F.col("literal"))), 1, 16)).alias("fact"))


def facts(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, class, literal, fact, weight) of all classes."""
    # all classes in one pass over the text: an array of matches for each, flattened and exploded once
    def of(name: str, pattern: str) -> Column:
        return F.transform(T.matches(F.col("text"), pattern), lambda m: F.struct(F.lit(name).alias("class"), m.alias("literal")))

    every = units.where("text IS NOT NULL").select(key, F.explode(F.flatten(F.array(*[of(name, p) for name, _, _, p in lexicon.LITERALS]))).alias("x")).select(key, "x.*")
    found = every.withColumn("fact", fact_key(F.col("class"), F.col("literal"))).where("fact IS NOT NULL").unionByName(phrases(units, key))
    return found.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("class")))


def merge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fact, class, literal, weight, n_owners): one row a fact, with the number of units that hold it."""
    return found.groupBy("fact").agg(F.min("class").alias("class"), F.min_by("literal", F.struct(key, "literal")).alias("literal"), F.max("weight").alias("weight"), F.count_distinct(key).alias("n_owners"))


def missing(source: DataFrame, output: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts of the source that the output lacks, within the same request."""
    return source.select(key, "fact", "class", "weight").distinct().join(output.select(key, "fact").distinct(), [key, "fact"], "left_anti")


def audit(source: DataFrame, output: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, kept, critical_total, critical_kept, retention): a ratio without facts is 1."""
    held = output.select(key, "fact").distinct().withColumn("held", F.lit(True))
    rows = source.select(key, "fact", "class").distinct().join(held, [key, "fact"], "left")
    critical, kept = F.col("class").isin(CRITICAL), F.col("held").isNotNull()
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(critical).alias("critical_total"), F.count_if(critical & kept).alias("critical_kept"))
    return agg.withColumn("retention", F.when(F.col("total") == 0, 1.0).otherwise(F.col("kept") / F.col("total")))


def provenance(source: DataFrame, output: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word): words of an output text that its source doesn't have."""
    words = lambda df: df.select(key, F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return words(output).join(words(source), [key, "word"], "left_anti")


def spans(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, stop, class, literal): matches of all literal classes without overlaps.

    Matches are swept from left to right; at one start the longest wins, then the
    earlier class.  The sweep depends on what was kept before, so it runs per row in Arrow batches.
    """
    patterns = [(name, pattern_of(p)) for name, _, _, p in lexicon.LITERALS]
    names = [key, "start", "stop", "class", "literal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted((m.start(), -m.end(), rank, name) for rank, (name, p) in enumerate(patterns) for m in p.finditer(text or ""))
                stop = 0
                for start, end, _, name in found:
                    if start >= stop:
                        stop = -end
                        rows.append((unit, start, stop, name, text[start:stop]))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return units.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, start long, stop long, class string, literal string")


def merge_spans(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, stop): overlapping or touching spans merged, by a running maximum of ends."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(order)
    return rows.select(key, "start", "stop", before.alias("before")).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def coverage(queries: DataFrame, units: DataFrame, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query key, key, coverage): share of a query's distinct words that a text has, for pairs that share one; an equi-join on words."""
    words = lambda df, name: df.select(name, F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    asked = queries.select(query_key, "text").withColumn("size", F.size(F.array_distinct(T.words(F.col("text")))))
    q = asked.select(query_key, "size", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return words(units, key).join(q, "word").groupBy(query_key, key, "size").agg(F.count(F.lit(1)).alias("n")).select(query_key, key, (F.col("n") / F.col("size")).alias("coverage"))


def answerable(gold: DataFrame, texts: DataFrame, gold_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(key, gold key) of texts that contain a gold span, in canonical form.

    A span of three words or more is joined on its longest inner word, which a text that contains it must have
    as a whole word, and then looked up; shorter ones have no such word and are compared with every text.
    """
    g = gold.select(gold_key, T.canonical(F.col("text")).alias("gold")).withColumn("w", F.split("gold", " "))
    body = texts.select(key, T.canonical(F.col("text")).alias("body"))
    anchored = g.where(F.size("w") >= 3).select(gold_key, "gold", F.array_max(F.transform(F.expr("slice(w, 2, size(w) - 2)"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("word"))
    words = body.select(key, "body", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    # only the words are moved to the spans; the texts of candidates follow
    near = words.select(key, "word").join(anchored, "word").select(key, gold_key, "gold").join(body, key).where(F.contains("body", "gold")).select(key, gold_key)
    few = g.where(F.size("w") < 3).select(gold_key, "gold")
    return near.unionByName(body.join(few, F.contains("body", "gold")).select(key, gold_key))
