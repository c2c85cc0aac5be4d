"""Written tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The local folder of each session of one machine.
_LOCAL: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one in a session of one machine (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = "file://" + tempfile.mkdtemp(prefix="sparkpress-")
        folder = _LOCAL[name]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside; its former value comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a write inside are removed once it has ended: what it wrote no longer needs them."""
    return setting(spark, _FREE, "true")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: no later stage recomputes it, and no executor's loss costs it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that is no longer needed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, name: str, rows: int = 200_000) -> DataFrame:
    """df, written and counted: marked for broadcast if it has at most so many (narrow) rows, else left to a shuffle join."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= rows else table
