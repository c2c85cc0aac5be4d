"""Written tables that cut lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The local folder of each session of one machine, where no shared one is named.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL:
        _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="sparkpress-core-")
    return _LOCAL[name]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df for a kernel that costs much more than moving its rows: the rows of a single file, which may stand in one split however many are cut, are dealt out over the session's cores; any other input is left as it is."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df
