"""Table reads, shared scratch space and small helpers that every operator family uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What `stored` wrote, for `clear_stored`.
WRITTEN: list[str] = []
#: Most bytes of a table that is broadcast, as measured before it is.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset and all
    tasks run on this machine (tests, local runs) a temporary folder is taken and remembered in the session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("codeloom.scratch", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-codeloom-")
        spark.conf.set("codeloom.scratch", at)
    return at


def stored(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Writes df once to the shared folder and returns the written table: lineage ends there, and a lost executor
    costs no more than re-reading a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Deletes the tables that this process wrote to the shared folder. Results that still read them must be written
    before."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the measured bytes of df are within the limit; beyond it the same join shuffles. df is
    read once more to be measured, so it should be a stored table."""
    sizes = []
    for name, kind in df.dtypes:
        if kind == "string" or kind == "binary":
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)) + 16)
        elif kind.startswith("array"):
            sizes.append(F.coalesce(F.size(name), F.lit(0)) * 8 + 16)
        else:
            sizes.append(F.lit(8))
    total = df.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0]).cast("long")), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if total <= limit else df


def spread(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """df over all cores where it comes from fewer files than there are, and small ones: a small file is one task however
    much work its rows are. Larger tables, and those of many files, are left as they are read. Only the plan is looked at."""
    n, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    few = 0 < n < cores and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= small
    return df.repartition(cores) if few else df


def running_total(df: DataFrame, by: list[str], order: list[str], n: str) -> DataFrame:
    """df with `upto`, the sum of n over the rows of the same group up to each one in order, itself included, and `total`,
    the sum over the group. Rows are split into ranges of (by, order); ranges are added up first, so a group that holds
    all rows is spread over as many tasks as there are ranges. Rows that tie in order must not be told apart."""
    by, keys = [*by, "_group"], by  # one constant more, so that there may be no group
    df = df.withColumn("_group", F.lit(0))
    ranges = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranges.groupBy(*by, "_range").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("total", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")
    per = per.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), "_before", "total")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    x = ranges.join(per, [*same, F.col("_range") == F.col("_r")])
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    return x.withColumn("upto", F.sum(n).over(inside) + F.col("_before")).drop("_range", "_r", "_before", "_group", *[f"_k{i}" for i in range(len(by))])
