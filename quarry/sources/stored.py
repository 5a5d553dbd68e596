"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/{uuid4().hex}"


def saved(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written and read again: what made them runs once, and a lost executor costs no more than a read."""
    path = path or scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
