"""Operator 10, sharding: Hilbert-curve order over document metadata, cut into runs.

Three dimensions are quantised to ``bits`` bits each: length (position of the
highest set bit of the characters, in half steps), source and language (rank
among the sorted distinct values, scaled to the grid).  The curve index is
Skilling's transposed form of the cell; it is tabulated once over the grid, whose
size is fixed by ``bits``, and joined to the rows.  The SQL twin computes it by
expressions instead.

Runs are cut at about ``target_chars`` characters.  A cell that holds more than
an eighth of a run is first split by a hash of the id into as many slices as it
holds eighths, so the table of slices has at most (cells + 8 x runs) rows
however many documents there are; the running total over it is the only
computation that isn't spread over the cluster.  Lookup tables are broadcast only
after their rows have been counted.  Texts move once, to the range
partition of their run.

Defined cases: a null text counts as empty; a null source or language gets grid
value 0, below all others; a null id hashes as 0 and orders first; repeated rows
stay, next to each other in one run; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

BITS = 5
TARGET_CHARS = 16_000_000
SLICES = 8


def _xor(a: str, b: str | int) -> str:
    return f"(({a} | {b}) - ({a} & {b}))"


def hilbert_steps(axes: list[str], bits: int) -> list[tuple[str, str]]:
    """(name, SQL expression) steps, each using names of earlier steps, that end in ``hilbert`` (Skilling 2004)."""
    x, steps = list(axes), []

    def let(expression: str) -> str:
        steps.append((f"h{len(steps)}", expression))
        return steps[-1][0]

    masks = [1 << b for b in range(bits - 1, 0, -1)]
    for q in masks:
        low = q - 1
        x[0] = let(f"CASE WHEN ({x[0]} & {q}) <> 0 THEN {_xor(x[0], low)} ELSE {x[0]} END")
        for i in range(1, len(x)):
            swap = let(f"CASE WHEN ({x[i]} & {q}) <> 0 THEN 0 ELSE ({_xor(x[0], x[i])} & {low}) END")
            flip = let(f"CASE WHEN ({x[i]} & {q}) <> 0 THEN {low} ELSE 0 END")
            x[0], x[i] = let(_xor(let(_xor(x[0], flip)), swap)), let(_xor(x[i], swap))
    for i in range(1, len(x)):
        x[i] = let(_xor(x[i], x[i - 1]))
    t = "0"
    for q in masks:
        t = let(f"CASE WHEN ({x[-1]} & {q}) <> 0 THEN {_xor(t, q - 1)} ELSE {t} END")
    x = [let(_xor(v, t)) for v in x]
    digits = [f"((({x[i]} >> {b}) & 1) * {1 << (b * len(x) + len(x) - 1 - i)})" for b in range(bits) for i in range(len(x))]
    return [*steps, ("hilbert", " + ".join(digits))]


def _length_steps(bits: int) -> list[tuple[str, str]]:
    top = "CAST(length(bin(chars + 1)) AS INT)"
    return [("top", top), ("g_length", f"least({(1 << bits) - 1}, 2 * (top - 1) + CAST((chars + 1) >> greatest(top - 2, 0) & 1 AS INT))")]


_HASH = "((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296"


def _grid(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, grid value): as many rows as the column has distinct values."""
    side = (1 << bits) - 1
    values = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"v_{column}")).agg(F.lit(1).alias("one"))
    rank = F.row_number().over(Window.orderBy(f"v_{column}"))
    count = F.count("one").over(Window.orderBy("one"))
    return values.select(f"v_{column}", rank.alias("r"), count.alias("n")).select(f"v_{column}", F.expr(f"CAST((r * {side} + n - 1) div n AS INT)").alias(f"g_{column}"))


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of (cells, dimensions) grid values."""
    x = axes.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, 0)
            if i:
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= t
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for row in x:
            index = index << 1 | (row >> b) & 1
    return index


def _curve(spark: SparkSession, bits: int) -> DataFrame:
    """The curve over the whole grid, 2 ** (3 * bits) rows: expressions of this depth would be copied wherever Catalyst pushes a filter on them."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    table = pd.DataFrame(cells.astype(np.int32), columns=["g_length", "g_source", "g_lang"]).assign(hilbert=curve_index(cells, bits))
    return spark.createDataFrame(table, "g_length int, g_source int, g_lang int, hilbert long")


def hilbert_shards(docs: DataFrame, bits: int = BITS, target_chars: int = TARGET_CHARS) -> DataFrame:
    """(doc_id, text, lang, source, hilbert, shard), each run whole in one partition and sorted along the curve."""
    keyed = docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    for column in ("source", "lang"):
        table = storage.small(_grid(docs.select(column), column, bits), "grid")
        keyed = keyed.join(table, keyed[column] == table[f"v_{column}"], "left").drop(f"v_{column}").withColumn(f"g_{column}", F.coalesce(f"g_{column}", F.lit(0)))
    for name, expression in _length_steps(bits):
        keyed = keyed.withColumn(name, F.expr(expression))
    keyed = keyed.join(F.broadcast(_curve(docs.sparkSession, bits)), ["g_length", "g_source", "g_lang"])
    keyed = keyed.select("doc_id", "text", "lang", "source", "chars", F.col("hilbert").cast("long").alias("hilbert"), F.expr(_HASH).alias("hash"))
    narrow = keyed.select("hilbert", "hash", "chars")
    # as many rows as the grid has cells, so always small enough to send to every task
    cells = narrow.groupBy("hilbert").agg(F.expr(f"greatest(1, CAST(sum(chars) div {max(1, target_chars // SLICES)} AS BIGINT))").alias("slices"))
    cells = F.broadcast(storage.written(cells, "cells"))
    sliced = lambda df: df.join(cells, "hilbert").withColumn("slice", F.expr("(hash * slices) >> 32"))
    sums = sliced(narrow).groupBy("hilbert", "slice").agg(F.sum("chars").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("hilbert", "slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.select("hilbert", "slice", before.alias("s0")).select("hilbert", "slice", F.expr(f"CAST(s0 div {target_chars} AS BIGINT)").alias("shard"))
    runs = storage.small(runs, "runs")
    placed = sliced(keyed).join(runs, ["hilbert", "slice"])
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "hilbert", "slice", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return placed.repartitionByRange(count, "shard").sortWithinPartitions(*order).select("doc_id", "text", "lang", "source", "hilbert", "shard")


def oracle_sql(bits: int = BITS, target_chars: int = TARGET_CHARS) -> str:
    side = (1 << bits) - 1
    grids = ", ".join(f"g{c} AS (SELECT {c} AS v_{c}, CAST((row_number() OVER (ORDER BY {c}) * {side} + count(*) OVER () - 1) // count(*) OVER () AS INT) AS g_{c} FROM (SELECT DISTINCT {c} FROM documents WHERE {c} IS NOT NULL))" for c in ("source", "lang"))
    inner = "(SELECT d.doc_id, d.text, d.lang, d.source, CAST(coalesce(length(d.text), 0) AS BIGINT) AS chars, coalesce(g_source, 0) AS g_source, coalesce(g_lang, 0) AS g_lang FROM documents d LEFT JOIN gsource ON d.source = v_source LEFT JOIN glang ON d.lang = v_lang)"
    for name, expression in _length_steps(bits) + hilbert_steps(["g_length", "g_source", "g_lang"], bits):
        inner = f"(SELECT *, {expression} AS {name} FROM {inner})"
    return f"""WITH {grids}, keyed AS (SELECT doc_id, text, lang, source, chars, CAST(hilbert AS BIGINT) AS hilbert, {_HASH} AS hash FROM {inner}),
cells AS (SELECT hilbert, greatest(1, CAST(sum(chars) // {max(1, target_chars // SLICES)} AS BIGINT)) AS slices FROM keyed GROUP BY hilbert),
sliced AS (SELECT keyed.*, (hash * slices) >> 32 AS slice FROM keyed JOIN cells USING (hilbert)),
sums AS (SELECT hilbert, slice, sum(chars) AS c FROM sliced GROUP BY hilbert, slice),
runs AS (SELECT hilbert, slice, CAST((sum(c) OVER (ORDER BY hilbert, slice) - c) // {target_chars} AS BIGINT) AS shard FROM sums)
SELECT doc_id, text, lang, source, hilbert, shard FROM sliced JOIN runs USING (hilbert, slice)"""
