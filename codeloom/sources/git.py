"""Git history as a Spark data source: raw commit records and blame lines; Spark parses them.

`spark.dataSource.register(GitLog)` and then `spark.read.format("git_log").option("repository", path).load()`. Each
partition reads a range of commits. The repository must be reachable from the executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions.text import plain_references, pull_references
from codeloom.operators.texts import parse_numstat

#: Fields of a record, set apart by a unit separator; records begin with a record separator.
FORMAT = "%x1e%H%x1f%h%x1f%s%x1f%b%x1f%an%x1f%ae%x1f%aI%x1f%cn%x1f%ce%x1f%cI%x1f%P%x1f"
FIELDS = ["hash", "short_hash", "subject", "body", "author_name", "author_email", "author_date", "committer_name", "committer_email", "commit_date", "parents"]


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, check=True, errors="replace").stdout


class GitLog(DataSource):
    """Options: repository, path (follows one file), author, since, until, merges ('true' to keep them), block."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class GitLogReader(DataSourceReader):
    def __init__(self, options) -> None:
        o = dict(options)
        self.repository, self.block = o["repository"], int(o.get("block", 10_000))
        self.args = [f"--{k}={o[k]}" for k in ("author", "since", "until") if o.get(k)] + ([] if o.get("merges") == "true" else ["--no-merges"])
        self.path = ["--", o["path"]] if o.get("path") else []

    def partitions(self) -> list[InputPartition]:
        n = int(_git(self.repository, "rev-list", "--count", *self.args, "HEAD", *self.path).strip() or 0)
        return [InputPartition(i) for i in range(0, max(n, 1), self.block)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        args = ["log", f"--format={FORMAT}", "--numstat", f"--skip={partition.value}", f"--max-count={self.block}", *self.args]
        for record in _git(self.repository, *args, *self.path).split("\x1e")[1:]:
            yield (record,)


class GitBlame(DataSource):
    """Options: repository, path, and first and last for a range of lines (both or none). Rows: file, n, line, as
    `parse_blame` takes them."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return "file string, n long, line string"

    def reader(self, schema) -> DataSourceReader:
        return GitBlameReader(self.options)


class GitBlameReader(DataSourceReader):
    def __init__(self, options) -> None:
        o = dict(options)
        self.repository, self.path = o["repository"], o["path"]
        self.range = ["-L", f"{o['first']},{o['last']}"] if o.get("first") and o.get("last") else []

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one file

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        for n, line in enumerate(_git(self.repository, "blame", "--porcelain", *self.range, "--", self.path).split("\n")):
            yield self.path, n, line


def commit_of(commits_: DataFrame, hash: str) -> DataFrame:
    """The commit of a full or short hash; no row if there is none."""
    return commits_.filter((F.col("hash") == hash) | (F.col("short_hash") == hash))


def commits(records: DataFrame) -> DataFrame:
    """Raw records to commits with issue and pull references; records with too few fields fall out."""
    p = F.split("record", "\x1f")
    x = records.filter(F.size(p) > len(FIELDS)).select(*[F.element_at(p, i + 1).alias(f) for i, f in enumerate(FIELDS)], F.element_at(p, len(FIELDS) + 1).alias("numstat"))
    message = F.concat_ws("\n", "subject", "body")
    parents = F.filter(F.split("parents", " "), lambda h: h != "")
    return x.withColumns({"parents": parents, "pr_refs": pull_references(message), "issue_refs": plain_references(message), "author_date": F.to_timestamp("author_date"), "commit_date": F.to_timestamp("commit_date")})


def commit_files(commits_: DataFrame) -> DataFrame:
    """hash, author_email, author_date and one file of the commit: path, previous_path, status, additions, deletions."""
    lines = commits_.select("hash", "author_email", "author_date", F.explode(F.split("numstat", r"\r?\n")).alias("line"))
    return parse_numstat(lines, "hash", "author_email", "author_date")


def change_frequency(files: DataFrame) -> DataFrame:
    """path, commits, authors (at least 1), last_change: per file."""
    return files.groupBy("path").agg(
        F.countDistinct("hash").alias("commits"), F.greatest(F.countDistinct("author_email"), F.lit(1)).alias("authors"), F.max("author_date").alias("last_change")
    )


def parse_blame(lines: DataFrame) -> DataFrame:
    """Porcelain blame lines (file, n, line) to file, line_no, hash, author, author_time, content: header values carry forward to the
    line they describe, and by commit to its later lines. The rows are those of one file: one window holds them."""
    w = Window.partitionBy("file").orderBy("n")
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    x = lines.withColumn("hash", F.last(F.nullif(F.regexp_extract("line", head, 1), F.lit("")), ignorenulls=True).over(w))
    x = x.withColumn("line_no", F.last(F.nullif(F.regexp_extract("line", head, 2), F.lit("")), ignorenulls=True).over(w).cast("long"))
    by = Window.partitionBy("file", "hash").orderBy("n")
    for column, key in (("author", "author "), ("author_time", "author-time ")):
        x = x.withColumn(column, F.last(F.when(F.col("line").startswith(key), F.substring("line", F.lit(len(key) + 1), F.length("line"))), ignorenulls=True).over(by))
    return x.filter(F.col("line").startswith("\t")).select("file", "line_no", "hash", "author", F.col("author_time").cast("long").alias("author_time"), F.substring("line", F.lit(2), F.length("line")).alias("content"))
