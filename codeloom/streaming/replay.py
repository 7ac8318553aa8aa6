"""Runs a streaming query over a stored table to its end and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.io import shared_dir


def read_table_stream(spark: SparkSession, base: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A table as a file stream: a folder of files, or one file picked from its folder by name. A trigger takes so many
    files at most."""
    at = f"{base}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(path).isDirectory():
        return stream.parquet(at)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def replayed(stream: DataFrame, mode: str = "append", write: Callable[[str], Callable[[DataFrame, int], None]] | None = None, latest_by: list[str] | None = None) -> DataFrame:
    """All rows that the stream yields for what is stored now; with `latest_by` the last row of each key, as an updated
    table holds it. Output and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if write or mode != "append":
        sink = write(f"{at}/out") if write else (lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"))
        query = out.outputMode(mode).foreachBatch(sink).start()
    else:
        query = out.outputMode(mode).format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.parquet(f"{at}/out") if latest_by else spark.read.schema(stream.schema).parquet(f"{at}/out")
    if latest_by:
        last = F.max_by(F.struct(*stream.columns), "batch").alias("r")
        return rows.groupBy(*latest_by).agg(last).select("r.*")
    return rows.select(*stream.columns)
