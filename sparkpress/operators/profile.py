"""Column profiles, JSON statistics and schemas, log templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T

#: Masks in order; each replaces what the ones before it left.
MASKS = [
    (r"[A-Fa-f0-9]{8}(-[A-Fa-f0-9]{4}){3}-[A-Fa-f0-9]{12}", "<uuid>"),
    (r"\b[0-9]{1,3}([.][0-9]{1,3}){3}\b", "<ip>"),
    (r"\b0[xX][A-Fa-f0-9]+\b", "<hex>"),
    (r"\"[^\"]*\"", "<str>"),
    (r"[0-9]+([.][0-9]+)?", "<num>"),
]
SEVERITY = dict.fromkeys(["CRITICAL", "FATAL", "PANIC", "SEVERE"], 5) | dict.fromkeys(["ERR", "ERROR"], 4) | dict.fromkeys(["WARN", "WARNING"], 3) | dict.fromkeys(["INFO", "NOTICE"], 2) | {"DEBUG": 1, "TRACE": 0}


def column_profile(df: DataFrame, columns: list[str], enum_limit: int = 6) -> DataFrame:
    """(column, rows, distinct, kind, low, high, sample) of each column in one pass: kind is numeric, enum (at most enum_limit values) or text."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), (F.lit(dict(df.dtypes)[c] in ("int", "bigint", "double", "float"))).alias("numeric")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL AND v <> ''")
    # distinct values first, so that the counts and the small enumerations come from one shuffle of distinct pairs
    pairs = long.groupBy("column", "numeric", "v").agg(F.count(F.lit(1)).alias("n"))
    agg = pairs.groupBy("column", "numeric").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.min(F.expr("try_cast(v AS double)")).alias("low"), F.max(F.expr("try_cast(v AS double)")).alias("high"), F.min("v").alias("first"), F.max("v").alias("last"))
    kind = F.when(F.col("numeric"), "numeric").when(F.col("distinct") <= enum_limit, "enum").otherwise("text")
    numeric = lambda c: F.when(F.col("numeric"), F.col(c))
    return agg.select("column", "rows", "distinct", kind.alias("kind"), numeric("low").alias("low"), numeric("high").alias("high"), F.when(~F.col("numeric"), F.col("first")).alias("sample"))


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, type, present, optional) of the top-level keys of JSON objects."""
    keys = df.select(column, F.explode(F.json_object_keys(column)).alias("path"))
    value = keys.withColumn("v", F.expr(f"get_json_object({column}, concat('$.', path))"))
    kind = F.when(F.col("v").isNull(), "null").when(F.col("v").rlike("^-?[0-9]+$"), "int").when(F.col("v").rlike("^-?[0-9]+[.][0-9]+$"), "float").when(F.col("v").isin("true", "false"), "bool").when(F.col("v").rlike(r"^\["), "array").when(F.col("v").rlike(r"^\{"), "object").otherwise("str")
    total = df.agg(F.count(F.lit(1)).alias("n"))
    agg = value.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("type"), F.count(F.lit(1)).alias("present"))
    return agg.crossJoin(F.broadcast(total)).select("path", "type", "present", (F.col("present") < F.col("n")).alias("optional"))


def string_format(value: Column) -> Column:
    """Type of a scalar string: uuid, datetime, date, email, url, enum?, long or str."""
    return (
        F.when(value.rlike("^[A-Fa-f0-9]{8}(-[A-Fa-f0-9]{4}){3}-[A-Fa-f0-9]{12}$"), "str<uuid>")
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), "str<datetime>")
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "str<date>")
        .when(value.rlike("^[^@ ]+@[^@ ]+[.][A-Za-z]+$"), "str<email>")
        .when(value.rlike("^[a-z]+://"), "str<url>")
        .when(value.rlike("^[A-Z][A-Z_]{1,24}$"), "str<enum?>")
        .when(F.length(value) > 200, "str<long>")
        .otherwise("str")
    )


def parse_logs(lines: DataFrame) -> DataFrame:
    """Add ts, level, mask to lines (idx, line)."""
    ts = F.nullif(F.regexp_extract("line", lexicon.TIMESTAMP, 0), F.lit(""))
    level = F.nullif(F.regexp_extract("line", T.java(lexicon.LOG_LEVEL), 1), F.lit(""))
    body = T.replaced(F.regexp_replace("line", lexicon.TIMESTAMP, ""), lexicon.LOG_LEVEL, "")
    for pattern, tag in MASKS:
        body = T.replaced(body, pattern, tag)
    mask = F.trim(F.regexp_replace(F.regexp_replace(body, r"^[ \[\]|:-]+", ""), r"\s+", " "))
    return lines.select("*", ts.alias("ts"), level.alias("level"), mask.alias("mask"))


def log_templates(lines: DataFrame) -> DataFrame:
    """(mask, level, lines, first_idx, last_idx, first_ts, last_ts, severity, anomalous) by exact mask."""
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("level")), F.lit(2))
    agg = parse_logs(lines).groupBy("mask", "level").agg(F.count(F.lit(1)).alias("lines"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("ts", "idx").alias("first_ts"), F.max_by("ts", "idx").alias("last_ts"))
    return agg.select("*", severity.cast("long").alias("severity")).withColumn("anomalous", (F.col("lines") == 1) | (F.col("severity") >= 4))


def attach_frames(lines: DataFrame, stream: str = "source") -> DataFrame:
    """(idx, owner) within each stream of lines: stack frames belong to the last error line before them, if nothing but frames stands between."""
    order = Window.partitionBy(stream).orderBy("idx")
    frame = F.col("line").rlike(lexicon.STACK_FRAME)
    error = F.col("level").isin("ERROR", "ERR", "FATAL", "CRITICAL", "SEVERE", "PANIC")
    parsed = parse_logs(lines).withColumn("frame", frame)
    # the last line that is no frame, and whether it is an error
    last = F.last(F.when(~F.col("frame"), F.struct("idx", F.coalesce(error, F.lit(False)).alias("error"))), ignorenulls=True).over(order)
    return parsed.withColumn("last", last).where("frame AND last.error").select("idx", F.col("last.idx").alias("owner"))
