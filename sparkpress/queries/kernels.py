"""Queries over the order-dependent kernels (rows only: SQL can't express their order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..plans import engine
from .aggregates import _docs, event_logs
from .registry import query


@query("content_chunks")
def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.content_chunks(_docs(spark, sf_dir))


@query("log_template_merge")
def log_template_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.log_template_merge(event_logs(spark, sf_dir))


@query("baseline_mmr")
def baseline_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.mmr(engine.units_of(_docs(spark, sf_dir).where(F.col("doc_id") % 5 == 0)), 80)
