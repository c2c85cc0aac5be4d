"""The compressor: documents in, compressed documents with their audit out.

Compression is one pass of a kernel over rows; units, salience, audits and
residuals are relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import lexicon, shared
from ..config import Config
from ..functions import text as T
from ..operators import facts, lines
from . import kernel


def units_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, text, tokens, critical): sentence units with their cost and whether they state a constraint, a negation, a security cue or a number."""
    s = lines.simple_sentences(docs, key).withColumnRenamed("sentence", "text")
    critical = T.has(F.col("text"), lexicon.STRONG) | T.has(F.col("text"), lexicon.NEGATION) | T.has(F.col("text"), lexicon.SECURITY) | F.col("text").rlike(r"[0-9]")
    return s.select(key, "n", "text", (T.token_count(F.col("text")) + 1).alias("tokens"), critical.alias("critical"))


def salience(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, salience, terms): z of information, recency and filler, scaled to 0..1 within the request; terms carry the request's own idf."""
    parts = units.select(key, "n", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("term"))
    df = parts.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"))
    count = units.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    weight = F.when(F.col("total") <= 1, 1.0).otherwise(F.greatest(F.lit(0.05), F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)))
    weighted = parts.join(df, [key, "term"]).join(count, key).select(key, "n", "term", weight.alias("w"))
    held = weighted.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"), F.sum("w").alias("mass"))
    place = F.col("n") / F.max("n").over(Window.partitionBy(key))
    z = 0.95 * F.coalesce("mass", F.lit(0.0)) / F.pow(F.greatest(F.lit(1), F.col("tokens")), F.lit(0.35)) + 0.7 * F.col("critical").cast("double") + 0.25 * 0.55 * place - 0.64 * T.filler_ratio(F.col("text"))
    scored = units.join(held, [key, "n"], "left").withColumn("z", z)
    low, high = F.min("z").over(Window.partitionBy(key)), F.max("z").over(Window.partitionBy(key))
    return scored.withColumn("salience", F.when(high == low, 0.0).otherwise((F.col("z") - low) / (high - low)))


def compress(docs: DataFrame, config: Config | None = None, key: str = "doc_id", query: str | None = None) -> DataFrame:
    """(key, text, tokens_in, tokens_out, kept_units, units, fallback): each request's text under its budget; the source itself where the output would be no smaller.

    One pass without a shuffle: a request is one row, of any key type.  With a query, sentences that share its
    terms, and the terms themselves, weigh more.  A null or blank text gives an empty output with no units.
    """
    kinds = [docs.schema[key], *StructType.fromDDL("text string, tokens_in long, tokens_out long, kept_units long, units long, fallback boolean")]
    return shared.spread(docs.select(key, "text")).mapInArrow(kernel.compress(config or Config(), query), StructType(kinds))


def residuals(docs: DataFrame, compressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, handle, text): the sentences that an output lacks, recoverable by handle."""
    words = lambda df: lines.simple_sentences(df.select(key, "text"), key)
    kept = words(compressed).select(key, "sentence").groupBy(key, "sentence").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(Window.partitionBy(key, "sentence").orderBy("n"))
    gone = words(docs).withColumn("r", place).join(kept, [key, "sentence"], "left").where(F.col("r") > F.coalesce("held", F.lit(0)))
    return gone.select(key, F.concat(F.col(key).cast("string"), F.lit(":"), F.col("n").cast("string")).alias("handle"), F.col("sentence").alias("text"))


def verify(docs: DataFrame, compressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, kept, critical_total, critical_kept, retention, foreign_words) of outputs against their sources."""
    audit = facts.audit(facts.facts(docs.select(key, "text"), key), facts.facts(compressed.select(key, "text"), key), key)
    foreign = facts.provenance(docs.select(key, "text"), compressed.select(key, "text"), key).groupBy(key).agg(F.count(F.lit(1)).alias("foreign_words"))
    return audit.join(foreign, key, "left").withColumn("foreign_words", F.coalesce("foreign_words", F.lit(0)))


def confidence(verified: DataFrame, compressed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, confidence): logistic of retention, critical retention, foreign words and how much was removed."""
    rows = compressed.join(verified, key, "left")
    critical = F.when(F.coalesce("critical_total", F.lit(0)) == 0, 1.0).otherwise(F.col("critical_kept") / F.col("critical_total"))
    removed = F.when(F.col("tokens_in") == 0, 0.0).otherwise(1 - F.col("tokens_out") / F.col("tokens_in"))
    z = -1.0 + 2.0 * F.coalesce("retention", F.lit(1.0)) + 2.4 * critical - 0.8 * removed - 1.5 * F.least(F.lit(1.0), F.coalesce("foreign_words", F.lit(0)) / 5.0)
    return rows.select(key, (1 / (1 + F.exp(-z))).alias("confidence"))
