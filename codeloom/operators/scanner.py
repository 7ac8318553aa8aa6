"""Where declarations end and what they say of themselves: spans, documentation, flags, and Go's aliases and constants.

Lines carry the work: a declaration at the left margin ends where the next margin line closes it, or on its own line if
nothing stays open there; in Python where the next line at the margin begins. One window over the lines of a file serves
all of its declarations. A parser isn't needed, and `span_agreement` says how well this does against delivered components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classes import extension, language_of
from codeloom.operators.files import declared_fields, declared_lines, family, generated_go, source_lines

#: What a margin line ends with if its declaration goes on, and how one begins that closes it.
OPENS = r"(?:[{(\[,=|&+]|=>|\bextends)\s*(?://.*)?$"
CLOSES = r"^[})\]]"


def spans(files: DataFrame) -> DataFrame:
    """(id, file, name, type, start_line, signature, exported, end_line, snippet, docstring, is_async, is_arrow_function,
    is_hook, is_constant, constant_kind) of what stands at the left margin. snippet: the lines from start to end.
    docstring: the comment that ends on the line above, or the string that opens a Python body, without marks.

    Declarations at the margin don't overlap, so every line goes to one of them at most: as part of the declaration that
    it lies in, or of the comment above the next one. A file's lines are held by one window, never copied."""
    x, line = declared_lines(files, by_file=True), F.col("line")
    fam = family(F.col("language"))
    file = Window.partitionBy("path").orderBy("line_no")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("path").orderBy(F.desc("line_no"))  # what follows is seen from the end: each row is read once
    ahead, rest = (back.rowsBetween(Window.unboundedPreceding, n) for n in (-1, 0))
    closes = F.when(fam == "python", line.rlike(r"^[^\s#)\]}]")).otherwise(line.rlike(CLOSES) & ~line.rlike(OPENS))
    stop = F.coalesce(F.last(F.when(closes, F.col("line_no")), ignorenulls=True).over(ahead) - F.when(fam == "python", 1).otherwise(0), F.lit(1 << 40))
    comment = line.rlike(r"^(?://|/\*| ?\*|#)")
    x = x.withColumns({"stop": stop, "comment": comment}).withColumn("island", F.sum(F.when(F.col("comment"), 0).otherwise(1)).over(file))
    one_line = (fam != "python") & ~line.rlike(OPENS)
    here = F.when(F.col("type").isNotNull(), F.struct(F.col("line_no").alias("at"), F.when(one_line, F.col("line_no")).otherwise(F.col("stop")).alias("end")))
    x = x.withColumn("own_", F.last(here, ignorenulls=True).over(upto))
    x = x.withColumn("next_", F.last(F.when(F.col("type").isNotNull(), F.struct(F.col("line_no").alias("at"), "island")), ignorenulls=True).over(rest))
    inside = F.col("line_no") <= F.col("own_.end")
    above = F.col("comment") & ~F.coalesce(inside, F.lit(False)) & (F.col("next_.island") == F.col("island") + 1)
    # Of a Python block the comments and blank lines at its end don't belong to it.
    filled = (fam != "python") | line.rlike(r"^\s+\S") | line.rlike(r"^[)\]}]") | F.col("type").isNotNull()
    x = x.withColumn("key", F.when(above, F.col("next_.at")).when(inside, F.col("own_.at"))).filter("key is not null")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("line_no", "line")))), lambda r: r.line), "\n")
    head = F.max(F.when(F.col("type").isNotNull(), F.struct(*declared_fields(), fam.alias("fam"))))
    x = x.withColumn("above", above)
    y = x.groupBy("path", "key").agg(head.alias("h"), F.max(F.when(filled & ~F.col("above"), F.col("line_no"))).alias("end_line"), F.array_sort(F.collect_list(F.when(~F.col("above"), F.struct("line_no", "line")))).alias("body"), text(F.col("above")).alias("note"))
    y = y.select("h.*", "end_line", "body", "note")
    y = y.withColumn("snippet", F.array_join(F.transform(F.filter("body", lambda r: r.line_no <= F.col("end_line")), lambda r: r.line), "\n"))
    inner = F.regexp_extract("snippet", r"(?s)^[^\n]*:\s*\n\s*[rRbBuUfF]{0,2}(\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\n]*\"|'[^'\n]*')", 1)
    y = y.withColumn("docstring", plain_comment(F.when(F.col("fam") == "python", inner).otherwise(F.col("note"))))
    return y.select("id", "file", "name", "type", "start_line", "signature", "exported", "end_line", "snippet", "docstring", *flags())


def plain_comment(text: Column) -> Column:
    """A comment without its marks and without tag lines, or null if nothing is left."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*\*?|\*/|\*|///?|#)[ \t]?|[ \t]*\*/[ \t]*$|\"\"\"|'''", "")
    t = F.regexp_replace(t, r"(?m)^@\w[^\n]*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", ""), r"^\s+|\s+$", ""), F.lit(""))


def flags() -> list[Column]:
    """is_async, is_arrow_function, is_hook, is_constant and constant_kind by a declaration's text and name."""
    head = F.substring_index("snippet", "\n", 1)
    arrow = F.col("snippet").rlike(r"(?s)^(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+\w+[^=]*=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^{]*\)(?:\s*:[^{=]+)?|\w+)\s*=>") & (F.col("type") == "variable")
    value = F.regexp_extract("snippet", r"(?s)^(?:export\s+)?(?:const|let|var)\s+\w+[^=]*=\s*(.)", 1)
    constant = (F.col("type") == "variable") & ~arrow & F.col("exported") & F.col("snippet").rlike(r"^export\s+const\b")
    kind = F.when(constant, F.when(value == "{", "object").when(value == "[", "array").otherwise("value"))
    return [
head.rlike(r"\basync\b").alias("is_async"), arrow.alias("is_arrow_function"), (arrow & F.col("name").rlike(r"^use[A-Z]")).alias("is_hook"),
        constant.alias("is_constant"), kind.alias("constant_kind"),
    ]


def span_agreement(files: DataFrame, components: DataFrame) -> DataFrame:
    """type, language, found, same_end, same_snippet: of the delivered components that `spans` finds by file, name and
    line, those with the same last line and the same text."""
    s = spans(files).select("file", "name", F.col("start_line").alias("line"), F.col("end_line").alias("e"), F.col("snippet").alias("s"))
    c = components.dropDuplicates(["id"]).select("file", "name", "type", language_of(F.col("file")).alias("language"), F.col("start_line").alias("line"), "end_line", "snippet")
    x = c.join(s, ["file", "name", "line"])
    text = lambda c_: F.regexp_replace(c_, r"\s+", "")
    return x.groupBy("type", "language").agg(F.count("*").alias("found"), F.count_if(F.col("e") == F.col("end_line")).alias("same_end"), F.count_if(text("s") == text("snippet")).alias("same_snippet"))


def type_parameters(signature: Column) -> Column:
    """What the first brackets of a Go declaration hold, split at commas; empty without brackets."""
    inside = F.regexp_extract(signature, r"\[([^\]]+)\]", 1)
    return F.filter(F.transform(F.split(inside, r",\s*"), lambda p: F.trim(p)), lambda p: p != "")


def go_members(files: DataFrame) -> DataFrame:
    """(id, file, name, type, start_line, signature, exported, type_parameters): Go's type aliases (named types that are
    neither struct nor interface) and exported constants, single or in a block. Generated files are skipped."""
    f = files.filter((language_of(F.col("path")) == "go") & ~generated_go(F.col("content")))
    x = source_lines(f, by_file=True)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("line").rlike(r"^const\s*\("), 1).when(F.col("line").rlike(r"^\S"), 0)
    x = x.withColumn("block", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(0)) == 1)
    alias = F.regexp_extract("line", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?:=\s*)?(?!struct\b|interface\b)[^\s=(]", 1)
    const = F.regexp_extract("line", r"^const\s+([A-Z]\w*)\b", 1)
    inner = F.when(F.col("block"), F.regexp_extract("line", r"^\s+([A-Z]\w*)\b", 1)).otherwise("")
    x = x.withColumn("name", F.coalesce(*[F.nullif(c, F.lit("")) for c in (alias, const, inner)])).withColumn("type", F.when(alias != "", "type").otherwise("variable")).filter("name is not null")
    sig = F.trim(F.regexp_replace("line", r"\s*//.*$", ""))
    return x.select(
        F.concat_ws(":", "path", "name", "line_no").alias("id"), F.col("path").alias("file"), "name", "type", F.col("line_no").alias("start_line"), sig.alias("signature"),
        F.col("name").rlike(r"^\p{Lu}").alias("exported"), type_parameters(sig).alias("type_parameters"),
    )


def scan_with(files: DataFrame, scan: Callable[[str, str], Iterable[dict]], extensions: list[str]) -> DataFrame:
    """(file, name, type, start_line, end_line, text, error): what a scanner of one's own finds in the files of its
    extensions: `scan` gets a path and its content and yields rows. A file at which it fails yields one row with the
    error, and the scan goes on. Files delivered twice are scanned once; null content counts as empty."""
    fields = ["name", "type", "start_line", "end_line", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *[r.get(f) for f in fields], None) for r in scan(path, content)]
                except Exception as e:  # noqa: BLE001 - whatever a scanner raises becomes a row
                    rows.append((path, *[None] * len(fields), f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["file", *fields, "error"])
            yield out.astype({"start_line": "Int64", "end_line": "Int64"})

    x = files.filter(F.col("path").isNotNull() & extension(F.col("path")).isin(extensions)).select("path", F.coalesce("content", F.lit("")).alias("content"))
    x = x.mapInPandas(run, "file string, name string, type string, start_line long, end_line long, text string, error string")
    return x.distinct()


def scan_errors(files: DataFrame) -> DataFrame:
    """(language, error, files): files that a scan passes over, and why: binary or blank content, generated Go."""
    c = F.coalesce("content", F.lit(""))
    why = F.when(F.contains(c, F.lit("\x00")), "binary").when(F.trim(F.regexp_replace(c, r"\s+", "")) == "", "empty")
    why = why.when((language_of(F.col("path")) == "go") & generated_go(c), "generated")
    x = files.filter("path is not null").select("path", language_of(F.col("path")).alias("language"), why.alias("error")).filter("error is not null").distinct()
    return x.groupBy("language", "error").agg(F.count("*").alias("files"))
