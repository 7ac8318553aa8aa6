"""Problem 1: source files that nobody wrote by hand.

Method: threshold layout statistics, with thresholds per language: longest and mean line, white-space share, alphanumeric
share, density of numeric literals, long encoded runs, and how few line shapes repeat. They find what was compressed, what
repeats itself and what is data. A copy of another project's source, or a short file that a tool wrote, has the layout of
hand-written source: no threshold tells it apart (README has the figures), so what the opening comment and the path say
is evidence of its own. `evidence` counts which kind decided.

Everything is a JVM expression over one scan; only narrow verdict rows are shuffled, to count a file delivered twice once.

Defined results: null content counts as empty, an empty file is hand-written (no layout to judge) unless its path or
name says otherwise, Markdown is never a case, a null path yields no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.io import spread

#: Folders that hold packages of other projects, and folders that hold tool output.
VENDOR_DIRS = ["node_modules", "bower_components", "third_party", "vendor", "vendored", "external", "deps"]
GENERATED_DIRS = ["generated", "__generated__", "gen"]
#: Names by which tools mark what they write.
GENERATED_NAME = r"(_pb\.(ts|js|py)|_pb2\.py|\.pb\.(go|ts|js)|_(gen|generated)\.(go|ts|js|py)|\.generated\.(go|ts|js|py)|\.gen\.(go|ts|js|py)|\.min\.js|\.bundle\.js|/mocks/mock_[^/]+\.go)$"

#: How a comment line begins that says a tool wrote the file. A line that merely mentions such a note,
#: denies it or speaks of the past does not begin so.
GENERATED_NOTE = (
    r"(?im)^[ \t﻿]*(?://+|/\*+!?|\*+|#+|\"\"\")?[ \t]*(?:"
    r"code generated by\b.*\bdo not edit|this file (?:was|is|has been) auto\S* (?:generated|created|written)"
    r"|this (?:file|code) (?:was|is|has been) (?:machine|generated)|diese datei wurde automatisch"
    r"|ce fichier a été généré|este archivo (?:fue|ha sido) generado|generated (?:automatically|from|by) "
    r"|auto-?generated\b|automatically generated\b|@generated\b)"
)
#: How a comment line names the package that a file was copied from.
FOREIGN_NOTE = (
    r"(?im)^[ \t﻿]*(?://+|/\*+!?|\*+|#+|\"\"\")?[ \t]*(?:"
    r"copied (?:verbatim )?from \S+ v?\d|vendored from \S+|[\w@/.-]+ v\d+\.\d+[\w.-]*[ \t]*(?:\*/)?[ \t]*\r?$"
    r"|copyright (?:\(c\) )?[\d, -]+ ((?!the )\S+) contributors\b|(?:copyright )?\(c\) [\d, -]+ (?:the )?(\S+) authors\b)"
)

#: Longest line, mean line, least white space and most alphanumeric characters of compressed code; most digits in numeric
#: literals, most encoded text and most alphanumeric characters of source; fewest line shapes a line; least share of
#: letters outside literals, of any file and of one of so many alphanumeric characters. They lie between the extremes of what is hand-written and what is not in the 4,051 files of
#: sf0.1. A parameter of the operator; a language without a row of its own has the first.
LAYOUT = {
    "default": {"max_line": 300, "mean_line": 150, "min_space": 0.08, "dense_alnum": 0.68, "max_numeric": 0.4, "max_encoded": 0.4, "max_alnum": 0.86, "min_shapes": 0.06, "min_bare": 0.09, "min_code": 0.4},
    "typescript": {"max_line": 300, "mean_line": 150, "min_space": 0.08, "dense_alnum": 0.68, "max_numeric": 0.4, "max_encoded": 0.4, "max_alnum": 0.84, "min_shapes": 0.07, "min_bare": 0.12, "min_code": 0.4},
    "javascript": {"max_line": 300, "mean_line": 120, "min_space": 0.08, "dense_alnum": 0.68, "max_numeric": 0.4, "max_encoded": 0.4, "max_alnum": 0.84, "min_shapes": 0.08, "min_bare": 0.12, "min_code": 0.4},
    "go": {"max_line": 300, "mean_line": 150, "min_space": 0.06, "dense_alnum": 0.7, "max_numeric": 0.4, "max_encoded": 0.4, "max_alnum": 0.85, "min_shapes": 0.07, "min_bare": 0.12, "min_code": 0.4},
    "python": {"max_line": 300, "mean_line": 150, "min_space": 0.07, "dense_alnum": 0.7, "max_numeric": 0.4, "max_encoded": 0.4, "max_alnum": 0.86, "min_shapes": 0.08, "min_bare": 0.12, "min_code": 0.4},
}


def layout(content: Column) -> dict[str, Column]:
    """Statistics of a whole text; each is one pass in the JVM."""
    n = F.greatest(F.length(content), F.lit(1)).cast("double")
    without = lambda pattern: (F.length(content) - F.length(F.regexp_replace(content, pattern, ""))) / n
    lines = F.split(content, "\n")
    return {
        "n_chars": F.length(content).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "max_line": F.array_max(F.transform(lines, F.length)).cast("long"),
        "mean_line": F.length(content) / F.size(lines),
        "space_share": without(r"\s+"),
        "alnum_share": without(r"[A-Za-z0-9]+"),
        "numeric_share": without(r"\b(?:0[xX][0-9a-fA-F]+|[0-9][0-9.eE]*)\b"),
        # Characters of string and numeric literals, and letters outside: what is left when data is taken away.
        "literal_share": without(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|\b[0-9][0-9a-fA-FxX.]*\b"),
        "bare_share": F.length(F.regexp_replace(F.regexp_replace(content, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`", ""), r"[^A-Za-z]+", "")) / n,
        # Distinct line shapes a line: code that a tool repeats for each field or record has few for its length.
        "shape_share": F.size(F.array_distinct(F.split(F.regexp_replace(content, r"\w+", "a"), "\n"))) / F.size(lines),
        "encoded_share": without(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{60,}+|(?:\\x[0-9a-fA-F]{2}){15,30}"),
    }


def _comment_lines(content: Column) -> Column:
    """All text before the first line that is neither blank nor marked as a comment."""
    at = F.regexp_instr(content, F.lit(r"(?m)^(?!﻿?[ \t]*(?://|#|/\*|\*|\"\"\"|\r?$))﻿?[ \t]*\S"))
    return F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(content)


def opening_comment(content: Column) -> Column:
    """All text before the first code. A block comment or string that opens it is read to its end, whether its lines are
    marked or not."""
    first = _comment_lines(content)
    behind = lambda mark: F.length(F.substring_index(first, mark, -1))
    ends = F.when(behind("/*") < behind("*/"), F.lit("*/")).when(F.size(F.split(first, '"""')) % 2 == 0, F.lit('"""'))
    at = F.call_function("locate", ends, content, F.length(first) + 1)
    size = at + F.length(ends) - 1
    whole = F.concat(F.substring(content, F.lit(1), size), _comment_lines(F.substring(content, size + 1, F.length(content))))
    return F.when(at > 0, whole).otherwise(first)


def classify_files(files: DataFrame, thresholds: dict[str, dict[str, float]] = LAYOUT) -> DataFrame:
    """One row per path: verdict flags, the reason and the statistics.

    Identical rows delivered twice count once; of rows of one path that differ, a flag holds if it holds for any.
    """
    lang = F.lower(F.coalesce(F.col("language"), F.lit("default")))
    kinds = [k for k in thresholds if k != "default"]

    def limit(name: str) -> Column:
        out = F.lit(float(thresholds["default"][name]))
        for k in kinds:
            out = F.when(lang == k, F.lit(float(thresholds[k][name]))).otherwise(out)
        return out

    x = spread(files.filter("path is not null").select("path", "repository", "language", F.coalesce("content", F.lit("")).alias("_c")))
    x = x.withColumns(layout(F.col("_c"))).withColumn("_head", opening_comment(F.col("_c")))
    path = F.col("path")
    flags = {
        "by_note": F.col("_head").rlike(GENERATED_NOTE),
        "by_name": path.rlike(GENERATED_NAME) | path.rlike(rf"(^|/)({'|'.join(GENERATED_DIRS)})/"),
        "minified": (F.col("n_chars") > 0)
        & (F.col("space_share") < limit("min_space"))
        & (F.col("alnum_share") < limit("dense_alnum"))
        & (F.col("max_line") > limit("max_line"))
        & (F.col("mean_line") > limit("mean_line")),
        "repeated": F.col("shape_share") < limit("min_shapes"),
        "vendored": path.rlike(rf"(^|/)({'|'.join(VENDOR_DIRS)})/[^/]+/") | F.col("_head").rlike(FOREIGN_NOTE),
        "data": (F.col("literal_share") > 0) & (F.col("bare_share") < limit("min_bare"))
        | (F.col("numeric_share") > limit("max_numeric"))
        | (F.col("encoded_share") > limit("max_encoded"))
        | ((F.col("alnum_share") > limit("max_alnum")) & (F.col("bare_share") < limit("min_code"))),
    }
    stats = ["n_chars", "n_lines", "max_line", "mean_line", "space_share", "alnum_share", "numeric_share", "encoded_share", "shape_share", "literal_share", "bare_share"]
    x = x.withColumns(flags).drop("_c", "_head")
    x = x.groupBy("path").agg(
        F.max("repository").alias("repository"),
        F.max("language").alias("language"),
        *[F.max(s).alias(s) for s in stats],
        *[F.max(f).alias(f) for f in flags],
    )
    markdown = F.lower("path").rlike(r"\.(md|mdx|markdown)$")
    reason = F.when(markdown, F.lit(None).cast("string"))
    for f in flags:
        reason = reason.when(F.col(f), F.lit(f))
    return x.withColumn("reason", reason).withColumn("hand_written", F.col("reason").isNull())


def hand_written(files: DataFrame) -> DataFrame:
    """The rows of files that remain, with all their columns: an anti join on the narrow list of cases."""
    cases = classify_files(files).filter("not hand_written").select("path")
    return files.join(cases, "path", "left_anti")


def marked_mentions(files: DataFrame, components: DataFrame, code_metadata: DataFrame) -> DataFrame:
    """Components per verdict and the lines_of_code last delivered, one row per path that source_files holds."""
    parts = components.filter("file is not null").groupBy(F.col("file").alias("path")).agg(F.countDistinct("id").alias("n_components"))
    loc = code_metadata.groupBy(F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^(\./)+", "").alias("path")).agg(
        F.max("lines_of_code").alias("max_lines_of_code")
    )
    return (
        classify_files(files)
        .select("path", "hand_written", "reason")
        .join(parts, "path", "left")
        .join(loc, "path", "left")
        .withColumn("n_components", F.coalesce("n_components", F.lit(0)))
    )


def evidence(files: DataFrame) -> DataFrame:
    """language, n_files, n_cases, by_layout, by_both, by_mark: how many cases the layout statistics decide, alone and
    beside a comment or path, and how many the comment or path decides alone."""
    x = classify_files(files).filter(~F.lower("path").rlike(r"\.(md|mdx|markdown)$"))
    layout_, mark = F.col("minified") | F.col("repeated") | F.col("data"), F.col("by_note") | F.col("by_name") | F.col("vendored")
    return x.groupBy(F.lower("language").alias("language")).agg(
        F.count("*").alias("n_files"), F.count_if(layout_ | mark).alias("n_cases"), F.count_if(layout_ & ~mark).alias("by_layout"),
        F.count_if(layout_ & mark).alias("by_both"), F.count_if(mark & ~layout_).alias("by_mark"),
    )
