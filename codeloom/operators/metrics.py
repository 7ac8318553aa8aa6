"""Metrics of repositories over time: the snapshot table and the code metadata of each snapshot.

Rows delivered twice count once (`once`). Sorts end with a unique key, so that ties have one order; null sort values come
last in descending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classes import activity, ownership, risk, size

ORDERS = {"risk_desc": ("risk_score", False), "risk_asc": ("risk_score", True), "lines_desc": ("lines_of_code", False), "commits_desc": ("commit_count", False)}


def once(df: DataFrame, *key: str) -> DataFrame:
    return df.dropDuplicates(list(key))


def clean(metadata: DataFrame) -> DataFrame:
    """Code metadata with paths in one spelling and one row per snapshot and file."""
    path = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(?:\./+)+", "")
    return once(metadata.withColumn("file_path", path), "snapshot_id", "file_path")


def find_snapshots(snapshots: DataFrame, since=None, until=None, repository: str | None = None, trigger: str | None = None, limit: int = 100) -> DataFrame:
    """The newest snapshots that satisfy all given predicates, at most `limit` (1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    x = once(snapshots, "id")
    for column, op, value in (("ts", ">=", since), ("ts", "<=", until), ("repository", "=", repository), ("trigger", "=", trigger)):
        if value is not None:
            c = F.col(column)
            x = x.filter(c >= F.lit(value) if op == ">=" else c <= F.lit(value) if op == "<=" else c == value)
    return x.orderBy(F.desc("ts"), "id").limit(limit)


def latest(snapshots: DataFrame, *by: str) -> DataFrame:
    """The newest snapshot per group (per repository path, say) or of all, by an aggregate with map-side combine."""
    row = F.struct(*snapshots.columns)
    x = snapshots.groupBy(*by).agg(F.max_by(row, F.struct("ts", "id")).alias("r"))
    return x.select("r.*")


def busiest_file(metadata: DataFrame) -> DataFrame:
    """(file_path) of the file with most rows, the first by name among equals."""
    return clean(metadata).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(1).select("file_path")


def file_trend(snapshots: DataFrame, metadata: DataFrame, file: DataFrame, limit: int = 10) -> DataFrame:
    """The newest rows of one file, given as a table of one row (file_path), each with its snapshot's time and the change
    of commits and lines since the row before in its series."""
    m = clean(metadata).join(F.broadcast(file.limit(1)), "file_path", "left_semi")
    s = once(snapshots, "id").select(F.col("id").alias("snapshot_id"), "ts", "repository_path")
    w = Window.partitionBy("repository_path", "file_path").orderBy("ts", "snapshot_id")
    x = m.join(s, "snapshot_id")
    for c in ("commit_count", "lines_of_code"):
        x = x.withColumn(f"{c}_delta", F.col(c) - F.lag(c).over(w))
    return x.orderBy(F.desc("ts"), "snapshot_id").limit(limit)


def file_metrics(metadata: DataFrame) -> DataFrame:
    """Each row with its classes of activity, size and ownership; null counts are 0, fewer than one author is one."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return clean(metadata).select(
        "snapshot_id",
        "file_path",
        zero("commit_count").alias("commit_count"),
        activity(F.col("commit_count")).alias("activity"),
        zero("lines_of_code").alias("lines_of_code"),
        size(F.col("lines_of_code")).alias("size"),
        F.greatest(zero("author_count"), F.lit(1)).alias("author_count"),
        ownership(F.greatest(zero("author_count"), F.lit(1))).alias("ownership"),
        "last_modified",
        zero("num_functions").alias("num_functions"),
        zero("num_imports").alias("num_imports"),
        risk(F.col("commit_count"), F.col("lines_of_code"), F.col("author_count")).alias("risk_score"),
    )


def top_files(metrics: DataFrame, order: str = "risk_desc", limit: int = 100, min_risk: float | None = None) -> DataFrame:
    column, ascending = ORDERS[order]
    x = metrics if min_risk is None else metrics.filter(F.col("risk_score") >= min_risk)
    key = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    return x.orderBy(key, "snapshot_id", "file_path").limit(limit)


def concentrated_ownership(metrics: DataFrame, limit: int = 10, pool: int = 1000) -> DataFrame:
    """Of the riskiest `pool` files those with one or two authors, riskiest first. The pool is cut first, as the contract
    has it."""
    x = top_files(metrics, "risk_desc", pool).filter(F.col("author_count") <= 2)
    return x.orderBy(F.desc_nulls_last("risk_score"), "snapshot_id", "file_path").limit(limit)


def snapshot_summary(metrics: DataFrame) -> DataFrame:
    """One row per snapshot: totals, rounded means and cumulative classes with their shares in percent."""
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) * 100 / n).cast("long")
    return metrics.groupBy("snapshot_id").agg(
        n.alias("total_files"),
        F.sum("lines_of_code").alias("total_loc"),
        F.sum("num_functions").alias("total_functions"),
        F.round(F.avg("lines_of_code")).cast("long").alias("avg_loc"),
        F.count_if(F.col("commit_count") >= 100).alias("very_active"),
        F.count_if(F.col("commit_count") >= 50).alias("highly_active"),
        share(F.col("commit_count") >= 50).alias("highly_active_percent"),
        F.count_if(F.col("lines_of_code") >= 2000).alias("very_large"),
        F.count_if(F.col("lines_of_code") >= 1000).alias("large"),
        F.count_if(F.col("author_count") == 1).alias("single_author"),
        share(F.col("author_count") == 1).alias("single_author_percent"),
    )


def append_code_metadata(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and the new rows whose (snapshot_id, file_path) isn't there yet; zero counts are stored as null, the risk
    is computed."""
    zero_null = {c: F.nullif(F.col(c), F.lit(0)) for c in ("commit_count", "author_count", "lines_of_code", "num_functions", "num_imports")}
    n = clean(new).withColumn("risk_score", risk(F.col("commit_count"), F.col("lines_of_code"), F.col("author_count"))).withColumns(zero_null)
    n = n.join(existing.select("snapshot_id", "file_path"), ["snapshot_id", "file_path"], "left_anti")
    return existing.unionByName(n.select(*existing.columns))


def prune(snapshots: DataFrame, metadata: DataFrame, now, days: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without snapshots older than `days` before `now`; file rows go with their snapshot."""
    keep = snapshots.filter(F.col("ts") >= F.lit(now) - F.make_dt_interval(F.lit(days)))
    return keep, metadata.join(keep.select(F.col("id").alias("snapshot_id")).distinct(), "snapshot_id", "left_semi")
