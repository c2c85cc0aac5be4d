"""Dialogue memory: typed records, belief revision, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T


def record_type(sentence: Column) -> Column:
    """The first cue that matches; small talk first if short, then questions, else an answer."""
    kind = F.when((F.length(F.trim(sentence)) == 0) | (T.has(sentence, lexicon.SMALL_TALK) & (F.length(sentence) < 80)), "smalltalk")
    for name, pattern in lexicon.RECORD_CUES:
        kind = kind.when(T.has(sentence, pattern), name)
    return kind.when(T.has(sentence, lexicon.QUESTION), "question").otherwise("answer")


def records(sentences: DataFrame) -> DataFrame:
    """Add rtype, terms, subject to (conv, idx, turn, role, sentence): the subject is the type with its first three long terms, sorted."""
    terms = F.array_distinct(T.content_terms(F.col("sentence")))
    head = F.array_sort(F.slice(F.filter("terms", lambda t: F.length(t) > 2), 1, 3))
    typed = sentences.withColumn("rtype", record_type(F.col("sentence"))).withColumn("terms", terms)
    return typed.withColumn("subject", F.concat_ws(":", "rtype", F.when(F.size(head) > 0, F.array_join(head, "|")).otherwise("~")))


def overlap(a: Column, b: Column) -> Column:
    """Common terms over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def same_subject(recs: DataFrame) -> DataFrame:
    """(conv, idx, superseded_by): a fact, preference or decision superseded by the next of its subject whose terms overlap by half."""
    order = Window.partitionBy("conv", "subject").orderBy("idx")
    held = recs.where(F.col("rtype").isin("fact", "preference", "decision"))
    after = held.withColumn("next", F.lead(F.struct("idx", "terms")).over(order))
    return after.where((F.col("next").isNotNull()) & (overlap(F.col("terms"), F.col("next.terms")) >= 0.5)).select("conv", "idx", F.col("next.idx").alias("superseded_by"))


def corrections(recs: DataFrame, least: float = 0.45) -> DataFrame:
    """(conv, idx, superseded_by): the earlier record that each correction fits best, by overlap x (0.6 + 0.4 e^(-turns / 40)).

    Single pass: whether a record was superseded before isn't looked at, so the result doesn't depend on an order of evaluation.
    """
    c = recs.where("rtype = 'correction'").select("conv", F.col("idx").alias("c_idx"), F.col("turn").alias("c_turn"), F.col("terms").alias("c_terms"))
    earlier = recs.where(~F.col("rtype").isin("smalltalk", "question", "correction"))
    score = overlap(F.col("terms"), F.col("c_terms")) * (0.6 + 0.4 * F.exp(-(F.col("c_turn") - F.col("turn")) / 40.0))
    pairs = earlier.join(c, "conv").where("idx < c_idx").withColumn("score", F.round(score, 9)).where(F.col("score") >= least)
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("conv", "c_idx").orderBy(F.desc("score"), F.desc("idx")))).where("r = 1")
    return best.select("conv", "idx", F.col("c_idx").alias("superseded_by"))


def recency(turns: DataFrame, window: int = 4) -> DataFrame:
    """Add recency = (place + 1) / turns and verbatim (one of the last ``window``) to (conv_id, turn, ...)."""
    part = Window.partitionBy("conv_id")
    n, place = F.count(F.lit(1)).over(part), F.row_number().over(part.orderBy("turn"))
    return turns.select("*", (place / n).alias("recency"), (place > n - window).alias("verbatim"))


def turn_value(recs: DataFrame) -> DataFrame:
    """(conv, turn, value): the sum of a turn's record weights."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in lexicon.RECORD_WEIGHTS.items() for x in kv]), F.col("rtype"))
    return recs.groupBy("conv", "turn").agg(F.sum(weight).alias("value"))


def answers_to_dead(recs: DataFrame, dead: DataFrame, window: int = 4) -> DataFrame:
    """(conv, turn) of assistant turns right after a turn all of whose records are superseded, outside the last turns."""
    gone = recs.join(dead.select("conv", "idx").distinct().withColumn("gone", F.lit(1)), ["conv", "idx"], "left")
    turns = gone.groupBy("conv", "turn").agg(F.first("role").alias("role"), F.min(F.coalesce("gone", F.lit(0))).alias("all_dead"))
    order = Window.partitionBy("conv").orderBy("turn")
    placed = turns.withColumn("before", F.lag("all_dead").over(order)).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("conv")) - F.row_number().over(order))
    return placed.where((F.col("role") == "assistant") & (F.col("before") == 1) & (F.col("left") >= window)).select("conv", "turn")


def turns_of(lines: DataFrame) -> DataFrame:
    """(doc_id, turn, role, text) of transcripts (doc_id, n, line): a turn begins with a role marker; lines before the first belong to none."""
    role = F.lower(F.regexp_extract("line", lexicon.ROLE_MARKER, 1))
    marked = lines.withColumn("role", F.when(role != "", role))
    turn = F.count("role").over(Window.partitionBy("doc_id").orderBy("n"))
    body = F.trim(F.regexp_replace("line", lexicon.ROLE_MARKER, ""))
    inside = marked.withColumn("turn", turn).where("turn > 0")
    return inside.groupBy("doc_id", "turn").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("body")))), lambda x: x["body"]), "\n").alias("text"))
