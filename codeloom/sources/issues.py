"""Issue and pull-request exports (JSON, one object or array per file) as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T

SCHEMA = """number long, title string, body string, state string, labels array<struct<name string>>, author struct<login string>,
createdAt string, updatedAt string, closedAt string, mergedAt string, url string, headRefName string, baseRefName string,
comments array<struct<body string>>"""


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def to_documents(export: DataFrame, kind: str, repository: str) -> DataFrame:
    """One row per issue or pull request with what its text refers to, itself excluded. A pull request with a merge time
    is merged; states are lower case; missing texts and lists are empty."""
    text = F.concat_ws("\n", "title", "body")
    links = T.urls(text)
    own = lambda a: F.filter(a, lambda x: x != F.col("number"))
    merged = (F.lit(kind) == "pull_request") & F.col("mergedAt").isNotNull()
    return export.filter("number is not null").select(
        F.concat(F.lit(f"{kind}-"), F.col("number").cast("string")).alias("id"), F.lit(kind).alias("type"), "number",
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"),
        F.when(merged, "merged").otherwise(F.lower("state")).alias("state"),
        F.coalesce(F.col("labels.name"), F.array().cast("array<string>")).alias("labels"), F.col("author.login").alias("author"),
        F.to_timestamp("createdAt").alias("created_at"), F.to_timestamp("updatedAt").alias("updated_at"), F.to_timestamp("closedAt").alias("closed_at"), F.to_timestamp("mergedAt").alias("merged_at"),
        "url", F.lit(repository).alias("repository"), F.col("headRefName").alias("head_branch"), F.col("baseRefName").alias("base_branch"),
        F.coalesce(F.size("comments"), F.lit(0)).cast("long").alias("comments"),
        own(F.array_sort(F.array_union(T.issue_references(text), T.url_numbers(links, "issues")))).alias("related_issues"),
        own(T.url_numbers(links, "pull")).alias("related_prs"), T.file_paths(text).alias("linked_files"), T.mentions(text).alias("mentions"),
    )


def search(docs: DataFrame, kind=None, state=None, author=None, labels: list[str] | None = None, since=None, until=None) -> DataFrame:
    """Documents that satisfy all given filters: type, state, author, any of the labels, created between."""
    x = docs
    for column, value in (("type", kind), ("state", state), ("author", author)):
        x = x if value is None else x.filter(F.col(column) == value)
    x = x if not labels else x.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    x = x if since is None else x.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return x if until is None else x.filter(F.col("created_at") <= F.lit(until).cast("timestamp"))


def state_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("type").pivot("state", ["open", "closed", "merged"]).count().na.fill(0)


def all_documents(issues: DataFrame, pulls: DataFrame, repository: str) -> DataFrame:
    """Issues and pull requests of two exports, one after the other."""
    return to_documents(issues, "issue", repository).unionByName(to_documents(pulls, "pull_request", repository))
