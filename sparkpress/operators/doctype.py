"""Document types: evidence of each line, a Viterbi path over a document's lines, regions, and the type by mass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T

LABELS = ["prose", "markdown", "code", "logs", "conversation", "sql", "table", "json"]
SWITCH, STAY = 3.2, {"table": 1.0, "logs": 1.0, "json": 1.8, "code": 1.4}


def line_scores(rows: DataFrame) -> DataFrame:
    """Add one additive score for each label to (doc_id, n, line)."""
    line, words = F.col("line"), F.size(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0)))
    letters = F.length(F.regexp_replace("line", "[^A-Za-z ]", "")) / F.greatest(F.lit(1), F.length("line"))
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    previous = F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))
    pair = line.rlike(r'^\s*"[^"]+"\s*:')
    before = F.coalesce(F.col("previous").rlike(r'^\s*("[^"]+"\s*:|[{\[])'), F.lit(False))
    scores = {
        "prose": 1.0 + when((words >= 6) & line.rlike("[.!?]$"), 1.6) + when(letters > 0.75, 1.2),
        "markdown": when(line.rlike(r"^#{1,6}\s+\S"), 2.6) + when(line.rlike(r"^\s*([-*+]|[0-9]+[.)])\s+\S"), 1.4) + when(line.rlike(r"\[[^\]\n]*\]\(\S+\)"), 1.2),
        "code": when(line.rlike(r"^\s*(def|class|import|from|func|fn|public|private|const|let|var|return|if|for|while)\b.*([:({;]|$)"), 2.4) + when(line.rlike(r"[;{}]\s*$"), 1.4) + when(line.rlike(r"[A-Za-z_]\w*\([^)]*\)"), 0.8),
        "logs": when(F.substring("line", 1, 40).rlike(lexicon.TIMESTAMP), 2.6) + when(T.has(F.substring("line", 1, 60), lexicon.LOG_LEVEL), 2.2),
        "conversation": when(line.rlike(lexicon.ROLE_MARKER), 3.2),
        "sql": when(line.rlike(r"(?i)^\s*(select|insert into|update|delete from|create table|alter table|drop table)\b"), 3.0) + when(line.rlike(r"(?i)^\s*(from|where|join|group by|order by)\b"), 1.5),
        "table": when(line.rlike(r"^\s*[|].*[|]\s*$"), 2.8) + when(line.rlike("\t.*\t"), 1.8),
        "json": when(pair, 2.4) + when(line.rlike(r"^\s*[{}\[\]],?\s*$"), 1.6) + when(pair & before, 0.8),
    }
    return rows.withColumn("previous", previous).select("doc_id", "n", "line", *[F.round(scores[name], 6).alias(name) for name in LABELS])


def viterbi(scores: np.ndarray) -> np.ndarray:
    """Best label of each line: scores less the price of leaving a label."""
    leave = np.array([SWITCH + STAY.get(name, 0.0) for name in LABELS])
    best, back = scores[0].copy(), np.zeros(scores.shape, np.int64)
    for t in range(1, len(scores)):
        moved = best[:, None] - leave[:, None] * (1 - np.eye(len(LABELS)))
        back[t] = moved.argmax(0)
        best = moved.max(0) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def labelled(scores: DataFrame) -> DataFrame:
    """(doc_id, n, label, confidence, chars): the Viterbi path; order-dependent, so a kernel on one document's lines."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        values = np.stack([group[name].to_numpy() for name in LABELS], 1)
        top = np.sort(values, 1)
        sure = np.where(top[:, -1] > 0, (top[:, -1] - top[:, -2]) / np.maximum(top[:, -1], 1e-9), 0.0)
        return pa.table({"doc_id": group["doc_id"], "n": group["n"], "label": pa.array([LABELS[k] for k in viterbi(values)]), "confidence": pa.array(sure), "chars": group["chars"]})

    return scores.withColumn("chars", F.length("line").cast("long")).groupBy("doc_id").applyInArrow(run, "doc_id long, n long, label string, confidence double, chars long")


def regions(lines: DataFrame) -> DataFrame:
    """(doc_id, region, label, first_line, last_line, chars, confidence) of neighbouring lines with one label."""
    order = Window.partitionBy("doc_id").orderBy("n")
    fresh = F.when(F.col("label") != F.coalesce(F.lag("label").over(order), F.lit("")), 1).otherwise(0)
    marked = lines.withColumn("fresh", fresh).withColumn("region", F.sum("fresh").over(order))
    return marked.groupBy("doc_id", "region", "label").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.sum("chars").alias("chars"), F.avg("confidence").alias("confidence"))


def document_type(found: DataFrame) -> DataFrame:
    """(doc_id, doctype, share): label of the greatest mass; conversation or markdown where prose wins but they reach 30 or 25 percent."""
    mass = found.groupBy("doc_id", "label").agg(F.sum("chars").alias("m"))
    share = mass.withColumn("share", F.col("m") / F.greatest(F.lit(1), F.sum("m").over(Window.partitionBy("doc_id"))))
    of = lambda name: F.coalesce(F.max(F.when(F.col("label") == name, F.col("share"))), F.lit(0.0))
    agg = share.groupBy("doc_id").agg(F.max_by("label", F.struct("share", "label")).alias("top"), F.max("share").alias("share"), of("conversation").alias("c"), of("markdown").alias("d"))
    kind = F.when((F.col("top") == "prose") & (F.col("c") >= 0.3), "conversation").when((F.col("top") == "prose") & (F.col("d") >= 0.25), "markdown").otherwise(F.col("top"))
    return agg.select("doc_id", kind.alias("doctype"), "share")
