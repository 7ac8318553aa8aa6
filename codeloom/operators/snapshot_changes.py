"""Problem 3: what changed between full snapshots.

Method: gaps-and-islands over key and row hash across snapshots creates validity intervals; interval starts, ends and
adjacencies become change events. Deliveries of a series are numbered; a row with the same key and hash in consecutive
deliveries belongs to one interval. An interval whose predecessor for the key ended just before it is a change, any
other start after the first delivery an addition, and an end before the last delivery that no interval follows a removal.

Nothing is compared snapshot against snapshot, so the work grows with the rows, not with rows times snapshots. Rows are
shuffled once, by series and key, never by series alone: a series that holds a third of all rows is spread over its keys.
Removing repeats, cutting intervals and comparing neighbours all run in that partitioning and its one order.

Defined results: rows delivered twice count once; of rows of one snapshot and key that still differ the one with the
greatest row hash stays; rows without a key and snapshots without a series or time are left out; snapshots of one time are
ordered by id; null counts equal 0 and a null modification time equals null; an unknown snapshot's rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.io import broadcast_small, stored

#: Columns that make a change: counts where null means 0, and columns compared as they are.
COUNTS = ["commit_count", "author_count"]
VALUES = ["last_modified", "lines_of_code", "num_functions", "num_imports"]


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading './'."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./+)+", "")


def deliveries(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """(snapshot_id, series, seq, last_seq): the deliveries of each series in order, stored, as they are read twice. A
    snapshot that promises files but has no row was lost and is passed over; one that promises none is a real, empty
    delivery."""
    s = snapshots.filter("id is not null and repository_path is not null and ts is not null")
    s = s.groupBy("id").agg(F.max_by(F.struct("repository_path", "ts", "total_files"), F.struct("ts", "repository_path", "total_files")).alias("s"))
    s = s.select(F.col("id").alias("snapshot_id"), F.col("s.repository_path").alias("series"), F.col("s.ts").alias("ts"), F.coalesce("s.total_files", F.lit(0)).alias("total_files"))
    held = metadata.filter("file_path is not null").select("snapshot_id").distinct().withColumn("_held", F.lit(True))
    s = s.join(held, "snapshot_id", "left").filter((F.col("total_files") <= 0) | F.col("_held"))
    order = Window.partitionBy("series").orderBy("ts", "snapshot_id")  # one row per snapshot: narrow and bounded
    s = s.withColumn("seq", F.row_number().over(order)).withColumn("last_seq", F.max("seq").over(Window.partitionBy("series")))
    return stored(s.select("snapshot_id", "series", "seq", "last_seq"), "deliveries")


def intervals(delivered: DataFrame, metadata: DataFrame) -> DataFrame:
    """(series, file_path, from_seq, to_seq, last_seq): in which deliveries a file had the same values. A row begins an
    interval unless the delivery before held the file with the same hash; a running count of beginnings numbers them."""
    same = [F.coalesce(c, F.lit(0)) for c in COUNTS] + [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in VALUES]
    rows = metadata.filter("file_path is not null and snapshot_id is not null").select(
        "snapshot_id", clean_path(F.col("file_path")).alias("file_path"), F.xxhash64(*same).alias("row_hash")
    )
    rows = rows.join(broadcast_small(delivered), "snapshot_id").drop("snapshot_id").repartition("series", "file_path")
    # Two deliveries of one row are one; a path spelt in two ways within a snapshot is one file.
    rows = rows.groupBy("series", "file_path", "seq", "last_seq").agg(F.max("row_hash").alias("row_hash"))
    key = Window.partitionBy("series", "file_path").orderBy("seq")
    goes_on = (F.lag("seq").over(key) == F.col("seq") - 1) & (F.lag("row_hash").over(key) == F.col("row_hash"))
    rows = rows.withColumn("begins", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("begins").over(key))
    return rows.groupBy("series", "file_path", "island", "last_seq").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq")).drop("island")


def change_events(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """(snapshot_id, file_path, change_kind, series, seq): one row per change, at the delivery that shows it."""
    return _events(deliveries(snapshots, metadata), metadata)


def _events(delivered: DataFrame, metadata: DataFrame) -> DataFrame:
    key = Window.partitionBy("series", "file_path").orderBy("from_seq")
    iv = intervals(delivered, metadata)
    iv = iv.withColumn("before", F.lag("to_seq").over(key)).withColumn("after", F.lead("from_seq").over(key))
    begins = F.when(F.col("from_seq") == 1, F.lit(None)).when(F.col("before") == F.col("from_seq") - 1, F.lit("changed")).otherwise(F.lit("added"))
    ends = (F.col("to_seq") < F.col("last_seq")) & (F.col("after").isNull() | (F.col("after") > F.col("to_seq") + 1))
    events = F.array(
        F.struct(begins.alias("change_kind"), F.col("from_seq").alias("seq")),
        F.struct(F.when(ends, F.lit("removed")).alias("change_kind"), (F.col("to_seq") + 1).alias("seq")),
    )
    x = iv.select("series", "file_path", F.explode(events).alias("e")).select("series", "file_path", "e.*").filter("change_kind is not null")
    x = x.join(broadcast_small(delivered), ["series", "seq"])
    return x.select("snapshot_id", "file_path", "change_kind", "series", "seq")


def change_counts(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per delivery after the first of its series: how many files were added, removed and changed, beside the
    totals that the snapshot's stats name (null where they are missing or cut off)."""
    d = deliveries(snapshots, metadata)
    n = _events(d, metadata).groupBy("snapshot_id").agg(*[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")])
    s = snapshots.filter("id is not null").groupBy(F.col("id").alias("snapshot_id")).agg(
        F.max("total_files").alias("total_files"), F.max(F.get_json_object("stats", "$.filesScanned").cast("long")).alias("stats_files")
    )
    x = d.filter("seq > 1").join(n, "snapshot_id", "left").join(s, "snapshot_id")
    return x.select("snapshot_id", "series", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("added", "removed", "changed")], "total_files", "stats_files")
