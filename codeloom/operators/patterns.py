"""Coding patterns of files and how a file compares with its neighbours.

Every pattern is counted in one scan of the contents; comparisons are aggregates per group. Modes break ties by the first
path. Medians are upper medians: the element at floor(n / 2) of the sorted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.io import spread, stored
from codeloom.operators.files import is_test_file, line_count


def import_style(content: Column) -> tuple[Column, Column]:
    """(style, imports): esm, cjs, mixed or unknown."""
    esm, cjs = F.regexp_count(content, F.lit(r"(?m)^import\s")), F.regexp_count(content, F.lit(r"require\s*\("))
    style = F.when((esm > 0) & (cjs > 0), "mixed").when(esm > 0, "esm").when(cjs > 0, "cjs").otherwise("unknown")
    return style, esm + cjs


#: How code handles errors, and how a signature names its type.
THROWS, RESULTS, RETURNS = r"throw\s+new\s+\w*Error", r"Result<|\{\s*ok:\s*(?:true|false)", r"\)\s*:?\s*\([^)]*,\s*error\)"
TYPED = r"(?:\)|=>)\s*:\s*\w+"


def error_style(content: Column) -> Column:
    """throw, result, error-return, mixed or unknown."""
    throw = F.regexp_count(content, F.lit(THROWS))
    result = F.regexp_count(content, F.lit(RESULTS))
    returned = F.regexp_count(content, F.lit(RETURNS))
    kinds = (throw > 0).cast("int") + (result > 0).cast("int") + (returned > 0).cast("int")
    return F.when(kinds == 0, "unknown").when(kinds > 1, "mixed").when(throw > 0, "throw").when(result > 0, "result").otherwise("error-return")


def file_patterns(files: DataFrame) -> DataFrame:
    """path, language, lines, bytes, import_style, imports, error_style, is_test: once per path."""
    c = F.coalesce("content", F.lit(""))
    style, n = import_style(c)
    x = spread(files.filter("path is not null").select("path", "repository", "language", "content", "length")).select(
        "path", "repository", F.lower("language").alias("language"), line_count(c).alias("lines"), F.col("length").alias("bytes"),
        style.alias("import_style"), n.cast("long").alias("imports"), error_style(c).alias("error_style"), is_test_file(F.col("path")).alias("is_test"),
    )
    return x.dropDuplicates(["path"])


def type_coverage(components: DataFrame) -> DataFrame:
    """file, annotated, functions, coverage (full, partial, minimal or none): explicit return types of a file's functions."""
    c = components.dropDuplicates(["id"]).filter(F.col("type").isin("function", "method") & F.col("file").isNotNull())
    hit = F.coalesce("signature", F.lit("")).rlike(TYPED)
    x = c.groupBy("file").agg(F.count_if(hit).alias("annotated"), F.count("*").alias("functions"))
    share = F.col("annotated") / F.col("functions")
    return x.withColumn("coverage", F.when(share >= 0.9, "full").when(share >= 0.5, "partial").when(share > 0, "minimal").otherwise("none"))


def pattern_mode(patterns: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """by, mode, times, total: the commonest value of a pattern per group, the one of the first path among equals."""
    g = patterns.groupBy(*by, pattern).agg(F.count("*").alias("times"), F.min("path").alias("first"))
    w, t = Window.partitionBy(*by).orderBy(F.desc("times"), "first"), Window.partitionBy(*by)  # over a group's few values
    x = g.withColumn("r", F.row_number().over(w)).withColumn("total", F.sum("times").over(t))
    return x.filter("r = 1").select(*by, F.col(pattern).alias("mode"), "times", "total")


def size_deviation(patterns: DataFrame, by: list[str]) -> DataFrame:
    """path, lines, average, median, smallest, largest, deviation: each file against all files of its group; larger or
    smaller if more than a fifth off the mean. The upper median is a discrete percentile over counts per size, so a hot
    group is aggregated before it is shuffled."""
    per = patterns.groupBy(*by, "lines").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("lines")
    all_ = Window.partitionBy(*by)
    c = per.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(all_))
    mid = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("lines")))
    g = c.groupBy(*by).agg(
        mid.alias("median"), (F.sum(F.col("lines") * F.col("n")) / F.sum("n")).alias("mean"), F.min("lines").alias("smallest"), F.max("lines").alias("largest")
    )
    x = patterns.join(g, by)
    off = F.abs(F.col("lines") - F.col("mean")) / F.col("mean")
    kind = F.when(off > 0.2, F.when(F.col("lines") > F.col("mean"), "larger").otherwise("smaller")).otherwise("similar")
    return x.select("path", *by, "lines", F.round("mean").cast("long").alias("average"), "median", "smallest", "largest", kind.alias("deviation"))


def testing_share(patterns: DataFrame, tests: DataFrame, by: list[str]) -> DataFrame:
    """by, files, tested, percent: how many files that are no tests have one beside them."""
    x = patterns.filter("not is_test").join(tests, "path", "left")
    return x.groupBy(*by).agg(F.count("*").alias("files"), F.count("test").alias("tested")).withColumn("percent", F.round(F.col("tested") * 100 / F.col("files")).cast("long"))


def compare(patterns: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    """One row per file: its own styles beside the commonest ones of its group."""
    kinds = ["import_style", "error_style", "coverage"]
    x = patterns.select("path", *by, "import_style", "error_style")
    x = x.join(types.select(F.col("file").alias("path"), "coverage"), "path", "left").withColumn("coverage", F.coalesce("coverage", F.lit("none")))
    x = stored(x, "patterns")  # texts are matched once; what follows reads narrow rows
    # All modes come from one aggregate over the few combinations of values that a group has.
    per = x.groupBy(*by, *kinds).agg(F.count("*").alias("n"), F.min("path").alias("first"))
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]))
    per = per.select(*by, "n", "first", one.alias("o")).groupBy(*by, "o.kind", "o.value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.struct(-F.col("n"), "first"))).alias(f"common_{k}")
    modes = per.groupBy(*by).agg(*map(best, kinds))
    same = [x[c].eqNullSafe(modes[c]) for c in by]
    x = x.join(modes.select(*by, *[f"common_{k}" for k in kinds]), same, "left").drop(*[modes[c] for c in by])
    return x.select("path", *by, "import_style", "common_import_style", "error_style", "common_error_style", "coverage", "common_coverage")
