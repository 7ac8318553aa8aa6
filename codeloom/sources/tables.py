"""A keyed table of Parquet files: upsert, delete and clear as DataFrame jobs that overwrite it.

Rows lie in ranges of the key, so that file statistics prune a look-up. A table that is read while it is replaced is
written to the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.io import stored
from codeloom.operators import vectors as V


def save(df: DataFrame, path: str, key: str) -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def upsert_into(spark: SparkSession, path: str, delta: DataFrame, key: str) -> None:
    save(stored(V.upsert(spark.read.parquet(path), delta, key), "table"), path, key)


def delete_from(spark: SparkSession, path: str, ids: DataFrame, key: str) -> None:
    save(stored(V.delete(spark.read.parquet(path), ids, key), "table"), path, key)


def clear(spark: SparkSession, path: str) -> None:
    """Leaves the table empty, with its columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
