"""Sources: requests and their documents, chats, files, question-answering JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROLES = ["system", "tool", "instruction", "history", "document", "main", "query"]


def chat_text(turns: DataFrame) -> DataFrame:
    """(conv_id, text): "role: content" lines in turn order."""
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def request_docs(requests: DataFrame) -> DataFrame:
    """(request_id, doc_ord, doc_id, role, text) of requests (request_id, system, instruction, query, text, documents array): fixed role order, blank texts dropped."""
    parts = []
    for column, role in (("system", "system"), ("instruction", "instruction"), ("documents", "document"), ("text", "main"), ("query", "query")):
        if column == "documents":
            rows = requests.select("request_id", F.posexplode("documents").alias("i", "text"))
            parts.append(rows.select("request_id", F.lit(ROLES.index(role)).alias("rank"), "i", F.concat(F.lit("doc"), F.col("i").cast("string")).alias("doc_id"), F.lit(role).alias("role"), "text"))
        else:
            parts.append(requests.select("request_id", F.lit(ROLES.index(role)).alias("rank"), F.lit(0).alias("i"), F.lit(role).alias("doc_id"), F.lit(role).alias("role"), F.col(column).alias("text")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = F.row_number().over(Window.partitionBy("request_id").orderBy("rank", "i")).cast("long")
    return every.where("trim(text) <> ''").select("request_id", order.alias("doc_ord"), "doc_id", "role", "text")


def guard(docs: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """(request_id, chars, status): 200, 400 for an empty request, 413 beyond the limit."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long")
    agg = docs.groupBy("request_id").agg(chars.alias("chars"))
    return agg.withColumn("status", F.when(F.col("chars") == 0, 400).when(F.col("chars") > limit, 413).otherwise(200).cast("long"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_qa(spark: SparkSession, path: str, rows: int = 200) -> DataFrame:
    """(file, context, question, answers) of JSON lines with either spelling of the fields; the first ``rows`` of each file, in order of line number."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    field = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    parsed = raw.select("file", "n", field("context", "input", "documents", "contexts").alias("context"), field("question", "query").alias("question"), field("answers", "answer").alias("answers"))
    kept = parsed.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("r") <= rows)
    return kept.select("file", "context", "question", "answers")


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results as parquet, json or text (a single string column)."""
    df.write.format(kind).save(path)
