"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.classes import language_of


def read_tree(spark: SparkSession, root: str, repository: str, glob: str = "*") -> DataFrame:
    """A folder as source_files: path (below the root), repository, language, content, length, modification_time. Bytes
    that are no UTF-8 become replacement characters."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return x.select(
        path.alias("path"), F.lit(repository).alias("repository"), language_of(F.col("path")).alias("language"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "length", F.col("modificationTime").alias("modification_time"),
    )
