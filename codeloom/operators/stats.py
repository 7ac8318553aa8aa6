"""Index statistics: counts by language, type and package, their merge, diff and export.

Components delivered twice count once. The order that the first-wins rules need is explicit: (start_line, id). Null
languages count under 'unknown'; paths are prefix-matched at slash boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classes import extension, language_of, numeric_diff, trend

METRICS = ["files", "components", "lines"]


def components_once(components: DataFrame) -> DataFrame:
    c = components.dropDuplicates(["id"])
    return c.withColumn("language", F.coalesce(F.lower("language"), F.lit("unknown")))


def lines_spanned() -> Column:
    return F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))


def by_language(components: DataFrame) -> DataFrame:
    """language, files, components, lines. A file counts only in the language of its first component."""
    first = Window.partitionBy("file").orderBy("start_line", "id")  # one file's components: bounded
    c = components_once(components).withColumn("_first", F.row_number().over(first) == 1)
    return c.groupBy("language").agg(F.count_if("_first").alias("files"), F.count("*").alias("components"), F.sum(lines_spanned()).alias("lines"))


def by_type(components: DataFrame) -> DataFrame:
    """type, components and their share of all in percent."""
    x = components_once(components).groupBy("type").agg(F.count("*").alias("components"))
    total = F.sum("components").over(Window.partitionBy())  # over a handful of rows
    return x.withColumn("percent", F.round(F.col("components") * 100 / total, 1))


def prefixes(path: Column, with_self: bool = False) -> Column:
    """Every ancestor folder of a path: 'a/b/c.ts' has 'a' and 'a/b', and itself if asked."""
    parts = F.split(path, "/")
    n = F.size(parts) if with_self else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file, package): the longest package path that is an ancestor of the file, null where none is. The prefix join is
    an equi-join: each file's few ancestors against the package names."""
    f = files.select("file").distinct()
    x = f.withColumn("package", F.explode(prefixes(F.col("file")))).join(packages.select("package").distinct(), "package")
    best = x.groupBy("file").agg(F.max_by("package", F.length("package")).alias("package"))
    return f.join(best, "file", "left")


def by_package(components: DataFrame, packages: DataFrame) -> DataFrame:
    """package, files, components, languages (a map of component counts). One scan: components are counted per file and
    language, and the longest package is picked among each file's few ancestors; both aggregates come from those rows."""
    c = components_once(components).filter("file is not null").groupBy("file", "language").agg(F.count("*").alias("n"))
    own = F.array_sort(F.collect_list(F.struct("language", "n"))).alias("own")
    c = c.groupBy("file").agg(own)  # the languages of one file
    x = c.withColumn("package", F.explode(prefixes(F.col("file")))).join(packages.select("package").distinct(), "package")
    x = x.groupBy("file").agg(F.max_by(F.struct("package", "own"), F.length("package")).alias("b"))
    x = x.select("b.package", F.posexplode("b.own").alias("k", "l"))  # a file counts with its first language
    per = x.groupBy("package", F.col("l.language").alias("language")).agg(F.sum("l.n").alias("n"), F.count_if(F.col("k") == 0).alias("files"))
    langs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n"))))
    per = per.groupBy("package").agg(F.sum("files").alias("files"), F.sum("n").alias("components"), langs.alias("languages"))
    return per


def merge(current: DataFrame, removed: DataFrame, added: DataFrame, key: str, compat: bool = True) -> DataFrame:
    """Statistics after an incremental update: current minus removed plus added, as one union of signed deltas. Counts
    don't fall below 0; a key without files goes. Only files are subtracted, as the contract has it, so components and lines
    drift; with compat=False all are."""
    sign = lambda df, s: df.select(key, *[(F.coalesce(c, F.lit(0)) * F.lit(s if c == "files" or not compat or s > 0 else 0)).alias(c) for c in METRICS])
    u = sign(current, 1).unionByName(sign(removed, -1)).unionByName(sign(added, 1))
    x = u.groupBy(key).agg(*[F.greatest(F.sum(c), F.lit(0)).alias(c) for c in METRICS])
    return x.filter(F.col("files") > 0)


def diff(before: DataFrame, after: DataFrame, key: str, metrics: list[str] = METRICS) -> DataFrame:
    """One row per key of either side and metric: before, after, absolute, percent, and whether the key is added, removed,
    changed or unchanged."""
    b, a = before.select(key, *[F.col(m).alias(f"b_{m}") for m in metrics]), after.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics])
    j = b.withColumn("_b", F.lit(True)).join(a.withColumn("_a", F.lit(True)), key, "full_outer")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[c.cast("double").alias(n) for n, c in numeric_diff(F.col(f"b_{m}"), F.col(f"a_{m}")).items()]) for m in metrics]))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
    x = j.select(key, state.alias("_s"), rows.alias("r")).select(key, "_s", "r.*")
    return x.withColumn("status", F.coalesce("_s", F.when(F.col("absolute") != 0, "changed").otherwise("unchanged"))).drop("_s")


def overall_trend(before: DataFrame, after: DataFrame) -> DataFrame:
    total = lambda df, n: df.agg(F.coalesce(F.sum("files"), F.lit(0)).alias(n))
    x = total(before, "before").join(total(after, "after"))
    return x.withColumn("trend", trend(F.col("after") - F.col("before")))


def with_grand_total(stats: DataFrame, key: str) -> DataFrame:
    """The rows and a total row, named 'Total'."""
    x = stats.rollup(key).agg(*[F.sum(m).alias(m) for m in METRICS], F.grouping(key).alias("_g"))
    return x.withColumn(key, F.when(F.col("_g") == 1, "Total").otherwise(F.col(key))).drop("_g")


def language_activity(languages: DataFrame, files: DataFrame) -> DataFrame:
    """languages with the commits of files of that language: total, average per file (0 where none) and the last change.
    A suffix match becomes an equi-join on the language of the extension; languages without files stay."""
    a = files.groupBy(language_of(F.col("file_path")).alias("language")).agg(
        F.sum("commit_count").alias("total_commits"), F.round(F.avg("commit_count"), 4).alias("avg_commits"), F.max("last_modified").alias("last_change")
    )
    x = languages.join(a, "language", "left")
    return x.withColumn("total_commits", F.coalesce("total_commits", F.lit(0))).withColumn("avg_commits", F.coalesce("avg_commits", F.lit(0.0)))


def package_activity(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Commits of all files whose path begins with a package path, at a slash or not, as the contract has it; nested packages
    included. An equi-join on the beginnings of each path that have the length of some package path."""
    p = packages.select("package").filter("package is not null").distinct()
    lengths = sorted(r.n for r in p.select(F.length("package").alias("n")).distinct().collect())  # at most as many as a path is long
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("file_path")), lambda n: F.substring(F.col("file_path"), F.lit(1), n))
    x = files.withColumn("package", F.explode(starts)).join(p, "package")
    return x.groupBy("package").agg(F.sum("commit_count").alias("total_commits"), F.max("last_modified").alias("last_change"), F.count("*").alias("files"))


def export_rows(stats: DataFrame, category: str, key: str) -> DataFrame:
    """category, subcategory, metric, value: the flat form for CSV. Commas in keys become semicolons."""
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in METRICS if c in stats.columns]))
    return stats.select(F.lit(category).alias("category"), F.regexp_replace(key, ",", ";").alias("subcategory"), m.alias("m")).select("category", "subcategory", "m.*")


def export_json(stats: DataFrame, key: str) -> DataFrame:
    """One row per key with its metrics as JSON."""
    return stats.select(key, F.to_json(F.struct(*[c for c in stats.columns if c != key])).alias("json"))


def markdown_rows(stats: DataFrame, key: str) -> DataFrame:
    """A table's lines: key | metrics, 'N/A' for nulls."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in [key, *[m for m in METRICS if m in stats.columns]]]
    return stats.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def extension_counts(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(extension(F.col(path)).alias("extension"), language_of(F.col(path)).alias("language")).agg(F.countDistinct(path).alias("files"))
