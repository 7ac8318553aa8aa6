"""Filters, joins and texts of scanned components.

A component delivered twice counts once. Null languages and types match nothing; a null flag is neither exported nor not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classes import extension
from codeloom.functions.text import estimate_tokens
from codeloom.operators.files import line_count
from codeloom.operators.stats import components_once


def by_export(components: DataFrame, exported: bool = True) -> DataFrame:
    return components.filter(F.col("exported") == exported)


def by_types(components: DataFrame, types: list[str]) -> DataFrame:
    """Types are compared as they are written."""
    return components.filter(F.col("type").isin(types))


def by_languages(components: DataFrame, languages: list[str]) -> DataFrame:
    """Languages are compared without case."""
    return components.filter(F.lower("language").isin([x.lower() for x in languages]))


def code_metadata(components: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per file with components: file_path, num_components, num_functions, num_imports (distinct modules),
    lines_of_code (pieces between line feeds), commit_count, author_count, last_modified (0, 0 and null where no change is
    known). Three aggregates by file meet in two joins; of the contents only the line count is shuffled."""
    c = components.dropDuplicates(["id"]).filter("file is not null")
    per = c.groupBy(F.col("file").alias("file_path")).agg(
        F.count("*").alias("num_components"),
        F.count_if(F.col("type").isin("function", "method")).alias("num_functions"),
        F.size(F.array_distinct(F.flatten(F.collect_set("imports")))).cast("long").alias("num_imports"),
    )
    lines = files.filter("path is not null").select(F.col("path").alias("file_path"), line_count(F.col("content")).alias("n")).groupBy("file_path").agg(F.max("n").alias("lines_of_code"))
    ch = changes.groupBy("file_path").agg(F.max("commit_count").alias("commit_count"), F.max("author_count").alias("author_count"), F.max("last_modified").alias("last_modified"))
    x = per.join(lines, "file_path", "left").join(ch, "file_path", "left")
    return x.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("lines_of_code", "commit_count", "author_count")})


def same_extension(files: DataFrame, references: DataFrame, n: int = 5) -> DataFrame:
    """(ref, path, position): for each file of `references` (path, repository) the first n others of its repository with the
    same last extension, without case. Each extension of a repository is cut to n + 1 paths before the join."""
    f = files.filter("path is not null").select("repository", "path", extension(F.col("path")).alias("ext")).distinct()
    w = Window.partitionBy("repository", "ext").orderBy("path")
    few = f.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n + 1).drop("r")
    r = references.select("repository", F.col("path").alias("ref"), extension(F.col("path")).alias("ext")).distinct()
    x = r.join(few, ["repository", "ext"]).filter("path <> ref")
    one = Window.partitionBy("ref").orderBy("path")
    return x.withColumn("position", F.row_number().over(one)).filter(F.col("position") <= n).select("ref", "path", "position")


def stale(state: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """path, stale: whether a file was last indexed more than so many minutes before now, or never."""
    x = state.filter("path is not null").groupBy("path").agg(F.max("last_indexed").alias("at"))
    return x.select("path", (F.col("at").isNull() | (F.unix_micros(now) - F.unix_micros("at") > minutes * 60_000_000)).alias("stale"))


def coverage(files: DataFrame, state: DataFrame) -> DataFrame:
    """repository, files, indexed, percent: of each repository's files those that the index knows."""
    f = files.filter("path is not null").select("repository", "path").distinct()
    known = state.filter("path is not null").select("path").distinct().withColumn("_k", F.lit(1))
    x = f.join(known, "path", "left").groupBy("repository").agg(F.count("*").alias("files"), F.count("_k").alias("indexed"))
    return x.withColumn("percent", F.round(F.col("indexed") * 100 / F.col("files"), 2))


def package_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """package, files, components and commits of two package tables (package, files, components, total_commits): the
    change of each; packages of one side only count as 0 on the other."""
    kinds = ["files", "components", "total_commits"]
    u = before.select("package", *[(-F.coalesce(k, F.lit(0))).alias(k) for k in kinds]).unionByName(after.select("package", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds]))
    return u.groupBy("package").agg(*[F.sum(k).alias(f"{k}_change") for k in kinds])


# ---- Texts -----------------------------------------------------------------------------------------------------
def _given(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def text_with_signature() -> Column:
    """'type: name', the signature and the text, one a line; parts that are missing fall out."""
    return F.concat_ws("\n", F.when(_given("name").isNotNull(), F.concat_ws(": ", "type", "name")), _given("signature"), _given("text"))


def embedding_text() -> Column:
    """'type name', the signature and the documentation, one a line, as a scanner gives it to the embedder. Exported
    constants of variables are called constants."""
    kind = F.when((F.col("type") == "variable") & F.coalesce("is_constant", F.lit(False)), "constant").otherwise(F.col("type"))
    none = F.lit("")
    return F.concat_ws("\n", F.concat_ws(" ", kind, F.coalesce("name", none)), F.coalesce("signature", none), _given("docstring"))


def json_tokens() -> Column:
    """Tokens of a component's name, type, file and lines as JSON."""
    return estimate_tokens(F.to_json(F.struct("name", "type", "file", "start_line", "end_line")))


def lines_of(content: Column, start: Column, end: Column) -> Column:
    """The lines from start to end, counted from 1, both included."""
    parts = F.split(F.coalesce(content, F.lit("")), "\n", -1)
    first = F.greatest(start, F.lit(1)).cast("int")
    return F.array_join(F.slice(parts, first, F.greatest(end.cast("int") - first + 1, F.lit(0))), "\n")


def component_lines(components: DataFrame, files: DataFrame) -> DataFrame:
    """id, lines: the lines of its file that each component spans. The join is by path; a file meets its own components."""
    c = components_once(components).filter("start_line is not null and end_line is not null").select("id", F.col("file").alias("path"), "start_line", "end_line")
    f = files.filter("path is not null").groupBy("path").agg(F.min("content").alias("content"))
    return c.join(f, "path").select("id", lines_of(F.col("content"), F.col("start_line"), F.col("end_line")).alias("lines"))
