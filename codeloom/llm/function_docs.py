"""Problem 2: functions paired with their documentation.

Method: lexed tokens are exploded into rows; a cumulative-depth window and gaps-and-islands SQL delimit functions, and
windows over the tokens before attach comments. All of it is JVM work: the lexers are fixed patterns.

Two inputs are served. `component_pairs` takes the scanner's rows, where the documentation is the docstring or else the
comment that opens the snippet (in Python the string that opens the body). `source_functions` takes whole source files
and finds the functions itself.

Defined results: null or blank snippets have no opening comment, null names take no words away, a component delivered
twice counts once, unterminated comments and strings run to the end of their line, rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 5

# ---- Fixed values: lexer and noise patterns --------------------------------------------------------------------
#: Coarse tokens: comments, strings, regular expressions (a slash where no value can stand before it), delimiters, and
#: runs of other code. Repetition is possessive: it must not recurse.
BRACE_TOKENS = (
    r"(?s)/\*.*?\*/|//[^\n]*|(?<=[(,=:\[!&|?{};\n]\s{0,8})/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"
    r"|[{}()\[\];]|[^\s/\"'`{}()\[\];][^/\"'`{}()\[\];\n]*|\S"
)
GO_TOKENS = (
    r"(?s)/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`"
    r"|[{}()\[\];]|[^\s/\"'`{}()\[\];][^/\"'`{}()\[\];\n]*|\S"
)
PYTHON_TOKENS = (
    r"(?s)#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\".*?\"\"\"|'''.*?''')|[rRbBuUfF]{0,2}\"(?:[^\"\\\n]|\\.)*+\"|[rRbBuUfF]{0,2}'(?:[^'\\\n]|\\.)*+'"
    r"|[(){}\[\]:]|[^\s#\"'(){}\[\]:][^#\"'(){}\[\]:\n]*|\S"
)
COMMENT_TOKEN = r"^(//|/\*)"
STRING_TOKEN = r"^[rRbBuUfF]{0,2}[\"']"
#: Comment marks at either end of a line.
LINE_MARKS = r"(?m)^[ \t﻿]*(?:/\*+!?|\*+/|\*+(?!\w)|//+!?|#+!?|[rRbBuUfF]{0,2}\"\"\"|[rRbBuUfF]{0,2}''')?[ \t]*|[ \t]*(?:\*+/|\"\"\"|''')?[ \t\r]*$"
NOISE = {
    "tag": r"^@",
    "directive": r"(?i)^(?:eslint\b|prettier-|noqa\b|nolint\b|pylint\s*:|type:\s*ignore|ts-(?:ignore|expect-error|nocheck)|istanbul |c8 ignore|v8 ignore"
    r"|go:\w+|\+build\b|fmt:\s*(?:off|on|skip)|mypy:|pragma\b|ruff\s*:|flake8\s*:|isort\s*:|yapf\s*:|black\s*:|nosec\b|biome-ignore|tslint\s*:|jshint\b|jslint\b"
    r"|#?(?:end)?region\b|webpack\w+\s*:|vim?:|-\*-|sourcemappingurl|lint:|nosonar\b|coverage\s*:|deno-lint|global\s+\w+$|exported\s+\w+$|export\s+\w+$)",
    "todo": r"(?i)^(?:todo|fixme|xxx|hack|tbd|wip)\b",
    "ruler": r"^[\W_]*$",
    "placeholder": r"(?i)^(?:\{@\w+[^}]*\}\W*$|description of (?:the|this) (?:function|method|class)\b.*\bhere\b|insert (?:function|method|a|the)?\s*description\b"
    r"|(?:add|put|write|enter|your) (?:a |the |your )?(?:description|documentation|docs?|comments?)\b.*|describe (?:the|this|what)\b.*\bhere\b|(?:function|method) description\W*$"
    r"|lorem ipsum|<[^>]*>\W*$|auto-?generated (?:method|function|docstring|stub)|\[?(?:missing|no) (?:docs?|description|documentation)\b|_?(?:summary|description)_?\W*$|n/?a\W*$|no-op\W*$)",
    "licence": r"(?i)(?:\bcopyright\b|\(c\)\s*\d{4}|\blicen[cs]ed? under\b|\bspdx-|all rights reserved|\bsee licen[cs]e\b|\b(?:mit|bsd|apache|gpl)\b.*\blicen[cs]e|permission is hereby granted|the software is provided|redistribution and use)",
    "code": r"(?:[;{]\s*$|^[})\]]+[;,]?\s*$|^(?:return|const|let|var|throw|await|import|export|yield|raise|del|assert)\s+\S*[(=.\[{\"'`].*$|^(?:if|for|while|switch|catch)\s*\(.*"
    r"|^(?:if|elif|for|while|with|def|class|try|except|else|finally)\b.*:\s*$|^[\w.\[\]\"']+\s*(?::=|[-+*/|&]?=)\s*\S.*$|^(?:await\s+)?[\w.]+\([^`]*\)[;,]?\s*$|^(?:if|for|func|defer|go|switch)\b.*\{\s*$|=>\s*[{(]|^\}\s*else\b)",
}


def cleaned_lines(doc: Column) -> Column:
    """The lines of a comment without marks and without lines that say nothing."""
    lines = F.transform(F.split(F.regexp_replace(doc, LINE_MARKS, ""), r"\r?\n"), lambda x: F.trim(x))
    noise = "|".join(f"(?:{p.replace('(?i)', '')})" for k, p in NOISE.items() if p.startswith("(?i)"))
    exact = "|".join(f"(?:{p})" for k, p in NOISE.items() if not p.startswith("(?i)"))
    return F.filter(lines, lambda x: ~x.rlike(f"(?i){noise}") & ~x.rlike(exact))


def own_words(name: Column) -> Column:
    """The words of a function's own name, in lower case: split at dots, underscores, digits and capitals."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.split(F.lower(F.trim(spaced)), r"\s+")


def said_words(lines: Column, name: Column) -> Column:
    """How many words of the lines aren't in the function's own name."""
    words = F.regexp_extract_all(F.lower(F.array_join(lines, " ")), F.lit(r"([\p{L}\p{N}]+(?:['’_-][\p{L}\p{N}]+)*)"), F.lit(1))
    mine = F.coalesce(own_words(name), F.array().cast("array<string>"))
    return F.size(F.filter(words, lambda w: ~F.array_contains(mine, w)))


def tokens(df: DataFrame, key: str, text: str, python: Column) -> DataFrame:
    """(key, pos, token, is_python): one row per token."""
    found = F.when(python, F.regexp_extract_all(text, F.lit(PYTHON_TOKENS), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(BRACE_TOKENS), F.lit(0))
    )
    return df.select(key, python.alias("is_python"), F.posexplode(found).alias("pos", "token"))


def opening_comments(df: DataFrame, key: str = "id", text: str = "snippet", language: str = "language") -> DataFrame:
    """(key, opening): the comment before the first code token; in Python the string right behind the header's colon.
    Rows without one are left out. Tokens are windowed by key, so a group is one snippet, never more."""
    python = F.lower(F.coalesce(F.col(language), F.lit(""))).isin("python", "py")
    t = tokens(df, key, text, python)
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    comment = F.when(F.col("is_python"), F.col("token").startswith("#")).otherwise(F.col("token").rlike(COMMENT_TOKEN))
    step = F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)
    t = t.withColumn("comment", comment).withColumn("code_before", F.count_if(~F.col("comment")).over(so_far))
    t = t.withColumn("depth", F.sum(step).over(so_far))
    colon = F.col("is_python") & (F.col("token") == ":") & (F.col("depth") == 0)
    t = t.withColumn("header_at", F.min(F.when(colon, F.col("pos"))).over(so_far))
    # The first token behind the header that isn't a comment: the only code token since.
    since = F.count_if(~F.col("comment") & F.col("header_at").isNotNull()).over(so_far)
    t = t.withColumn("body_code", since)
    keep = F.when(F.col("is_python"), (F.col("body_code") == 2) & F.col("token").rlike(STRING_TOKEN) & ~F.col("comment")).otherwise(
        F.col("comment") & (F.col("code_before") == 0)
    )
    # A '/' alone is what is left of a comment that doesn't end: no documentation.
    return t.filter(keep).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.token), "\n").alias("opening"))


def functions_of(components: DataFrame) -> DataFrame:
    """Components that are a function or a method, or hold an arrow function, once each."""
    kind = F.lower(F.col("type")).isin("function", "method") | F.coalesce(F.col("is_arrow_function"), F.lit(False))
    keep = ["id", "name", "language", "file", "signature", "docstring", "snippet"]
    return components.filter(kind & F.col("id").isNotNull()).select(*keep)


def component_pairs(components: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per documented function: id, name, language, signature, code, description, doc_source, n_words.

    Only snippets whose docstring is missing are lexed. Rows of one id that differ keep the one with the most words."""
    f = functions_of(components)
    # The language by the file's extension where the column is null or misspelt.
    by_file = F.when(F.col("file").rlike(r"(?i)\.pyi?$"), "python").when(F.col("file").rlike(r"(?i)\.\w+$"), "other")
    f = f.withColumn("language", F.coalesce(by_file, F.lower("language")))
    only_marks = F.coalesce(F.regexp_replace("docstring", r"[/*#\"'\s]+", ""), F.lit("")) == ""
    # A row delivered twice must not mix its tokens with the copy's: rows are numbered at the scan.
    missing = f.filter(only_marks).withColumn("_row", F.monotonically_increasing_id())
    opened = opening_comments(missing.withColumn("_key", F.struct("_row", "id")), "_key").select(F.col("_key.id").alias("id"), "opening")
    opened = opened.groupBy("id").agg(F.max("opening").alias("opening"))
    given = f.filter(~only_marks).withColumn("description", F.col("docstring")).withColumn("doc_source", F.lit("docstring"))
    found = f.filter(only_marks).join(opened, "id").withColumnRenamed("opening", "description").withColumn("doc_source", F.lit("snippet"))
    x = given.unionByName(found).withColumn("_lines", cleaned_lines(F.col("description")))
    x = x.withColumn("n_words", said_words(F.col("_lines"), F.col("name"))).filter(F.col("n_words") >= min_words)
    row = F.struct("name", "language", "signature", F.col("snippet").alias("code"), F.array_join("_lines", "\n").alias("description"), "doc_source", "n_words")
    return x.groupBy("id").agg(F.max_by(row, "n_words").alias("r")).select("id", "r.*")


# ---- Whole source files ----------------------------------------------------------------------------------------
#: What a statement's text looks like, up to its brace, if it opens a function.
FUNCTION_HEADER = (
    r"(?s)^(?:(?:export|default|async)\s+)*function\b\s*\*?\s*([\w$]+)"
    r"|^func\s*(?:\([^)]*\)\s*)?([\w]+)\s*[\[(]"
    r"|^(?:export\s+)?(?:const|let|var)\s+([\w$]+)\b.*=>\s*$"
    r"|^(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|with|return|function|super|new)\b)(#?[\w$]+)\s*(?:<[^()]*>)?\s*\(.*\)\s*(?::.*)?$"
)
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go"}


#: What tells files apart: two digests of 64 bits, which sort faster than a path and are shorter.
FILE = ["f1", "f2"]


def files_once(files: DataFrame, extensions: str) -> DataFrame:
    """(f1, f2, path, content) of the files with one of the extensions, once each and spread by f1: what comes after is told
    apart by f1 and f2 and shuffles nothing more, so a text is shuffled once and its pieces never."""
    x = files.filter(F.col("path").rlike(rf"(?i)\.({extensions})$") & F.col("content").isNotNull()).select("path", "content")
    x = x.select(F.xxhash64("path", "content").alias("f1"), F.xxhash64(F.lit("other"), "content", "path").alias("f2"), "path", "content")
    return x.repartition("f1").dropDuplicates([*FILE, "path", "content"])


#: What a piece of code between delimiters consists of, besides plain characters. Possessive, as above.
BRACE_VALUES = (
    r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"
    r"|(?<=[(,=:\[!&|?{};\n]\s{0,8})/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+"
)
GO_VALUES = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`"


def _pieces(values: str) -> str:
    """A comment, or the code up to a brace or semicolon and that: one row where finer tokens would be many."""
    code = rf"(?:[^{{}};/\"'`]++|{values}|/(?![/*])|[\"'`])"
    return rf"(?s)\s*+(?:/\*.*?\*/|//[^\n]*+|{code}++[;{{}}]?+|\S)"


def brace_functions(files: DataFrame) -> DataFrame:
    """Functions of TypeScript, JavaScript and Go files: path, name, signature, code, doc."""
    whole = files_once(files, "tsx?|js|go")
    go = F.col("path").rlike(r"(?i)\.go$")
    # (f1, f2, pos, raw): pieces with the white space before them, so that joining them gives the text.
    pieces = F.when(go, F.regexp_extract_all("content", F.lit(_pieces(GO_VALUES)), F.lit(0))).otherwise(F.regexp_extract_all("content", F.lit(_pieces(BRACE_VALUES)), F.lit(0)))
    t = whole.select(*FILE, go.alias("go"), F.posexplode(pieces).alias("pos", "raw"))
    t = t.withColumn("token", F.ltrim("raw", F.lit(" \t\r\n\f\x0b"))).withColumn("comment", F.col("token").startswith("//") | F.col("token").startswith("/*"))
    bare = F.when(F.col("go"), F.regexp_replace("raw", rf"(?s){GO_VALUES}", "")).otherwise(F.regexp_replace("raw", rf"(?s){BRACE_VALUES}", ""))
    t = t.withColumn("bare", F.when(~F.col("comment") & F.col("raw").rlike(r"[\[\]()]"), bare).otherwise(F.lit("")))
    count = lambda c: F.length("bare") - F.length(F.translate("bare", c, ""))
    end = F.when(~F.col("comment"), F.right("raw", F.lit(1)))
    t = t.withColumn("step", count("([") - count(")]")).withColumn("end", F.when(end.isin(";", "{", "}"), end))
    # A piece is carried once: comments trimmed, code as it stands.
    t = t.select(*FILE, "pos", F.when(F.col("comment"), F.col("token")).otherwise(F.col("raw")).alias("v"), F.length("raw").alias("size"), "comment", "step", "end")
    file = Window.partitionBy(*FILE).orderBy("pos")
    upto, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    brace = F.when(F.col("end") == "{", 1).when(F.col("end") == "}", -1).otherwise(0)
    t = t.withColumn("chars", F.sum("size").over(upto)).withColumn("parens", F.sum("step").over(upto))
    t = t.withColumn("depth", F.sum(brace).over(upto) + F.when(F.col("end") == "}", 1).otherwise(0))
    # A statement ends with a brace or a semicolon outside parentheses.
    t = t.withColumn("ends", F.when((F.col("parens") == 0) & F.col("end").isNotNull(), 1).otherwise(0)).withColumn("statement", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # Comments stand before the statement's code or in it: the last piece of code before it is in another statement, or not.
    t = t.withColumn("code_at", F.last(F.when(~F.col("comment"), F.col("statement")), ignorenulls=True).over(upto)).drop("step", "ends", "size", "parens")
    # An opening brace closes with the next closing brace of its depth, seen from the end of the file.
    back = Window.partitionBy(*FILE, "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("closes", F.last(F.when(F.col("end") == "}", F.col("chars")), ignorenulls=True).over(back))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "v")))), lambda x: x.v), by)
    here = F.col("code_at").eqNullSafe(F.col("statement"))
    parts = t.groupBy(*FILE, "statement").agg(
        F.max_by(F.struct("pos", "end", "chars", "closes"), "pos").alias("last"),
        joined(~F.col("comment"), "").alias("text"),
        joined(F.col("comment") & ~here, "\n").alias("lead"),
        joined(F.col("comment") & here, "\n").alias("later"),
    )
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"\{$", ""), r"(?m)^(?:import|package|type)\b[^\n]*$", ""))
    text = F.regexp_replace(text, r"(?s)^.*\n(?=(?:export|async|function|func|const|let|var)\b)", "")
    parts = parts.filter("last.end = '{' and last.closes is not null").withColumn("signature", F.regexp_replace(text, r"^\s+", ""))
    # The one group of the header that matched; exploded, so that a filter pushed down doesn't match it anew.
    name = F.regexp_replace(F.regexp_extract("signature", FUNCTION_HEADER, 0), FUNCTION_HEADER, "$1$2$3$4")
    heads = parts.withColumn("name", F.explode(F.filter(F.array(name), lambda n: n != "")))
    heads = heads.select("f1", F.col("f2").alias("of"), "last", "name", "signature", F.coalesce(F.nullif("later", F.lit("")), "lead").alias("doc"))
    # Bodies are cut out of the text by character positions: no token meets every function of its file.
    body = F.substring("content", F.col("last.chars"), F.col("last.closes") - F.col("last.chars") + 1)
    x = heads.join(whole, "f1").filter(F.col("of") == F.col("f2"))
    return x.select("path", "name", "signature", F.concat("signature", F.lit(" "), body).alias("code"), "doc", F.col("last.pos").alias("at"))


def python_functions(files: DataFrame) -> DataFrame:
    """Functions of Python files: path, name, signature, code, doc. A function is an island of logical lines that are
    indented deeper than its def line; each level of indentation at which a file has a def is numbered by itself."""
    x = files_once(files, "py").select(*FILE, "path", F.regexp_replace("content", r"^﻿|\r", "").alias("content"))
    pattern = r"(?s)\n[ \t]*|" + PYTHON_TOKENS[4:].replace(r"[^\s#", r"[^\s#", 1)
    t = x.select(*FILE, "path", F.posexplode(F.regexp_extract_all(F.concat(F.lit("\n"), "content"), F.lit(pattern + r"|[ \t]+"), F.lit(0))).alias("pos", "token"))
    file = Window.partitionBy(*FILE).orderBy("pos")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)
    t = t.withColumn("depth", F.sum(step).over(upto)).withColumn("next", F.lead("token").over(file))
    starts = F.col("token").startswith("\n") & (F.col("depth") == 0) & ~F.coalesce(F.col("next"), F.lit("\n")).rlike(r"^(?:\n|#)")
    t = t.withColumn("line", F.sum(F.when(starts, 1).otherwise(0)).over(upto))
    lines = t.groupBy(*FILE, "line").agg(
        F.first("path").alias("path"),
        F.min("pos").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.token), "").alias("text"),
    )
    lines = lines.withColumn("indent", F.length(F.regexp_extract("text", r"^\n([ \t]*)", 1)))
    header = r"^\n[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"
    lines = lines.withColumn("name", F.nullif(F.regexp_extract("text", header, 1), F.lit("")))
    levels = lines.filter("name is not null").select("f1", F.col("f2").alias("of"), F.col("indent").alias("level")).distinct()
    by_level = lines.join(levels, "f1").filter(F.col("of") == F.col("f2"))
    w = Window.partitionBy(*FILE, "level").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    islands = by_level.withColumn("island", F.sum(F.when(F.col("indent") <= F.col("level"), 1).otherwise(0)).over(w))
    first = F.min_by(F.struct("name", "indent", "text"), "line")
    row = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text)
    f = islands.groupBy(*FILE, "level", "island").agg(F.first("path").alias("path"), first.alias("f"), row.alias("rows"), F.min("at").alias("at"))
    f = f.filter("f.name is not null and f.indent = level")
    second = F.trim(F.regexp_replace(F.try_element_at("rows", F.lit(2)), r"^\s+", ""))
    doc = F.when(second.rlike(STRING_TOKEN), F.regexp_extract(second, r"(?s)^[rRbBuUfF]{0,2}(\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\n]*\"|'[^'\n]*')", 1)).otherwise(F.lit(""))
    text = F.regexp_replace(F.array_join("rows", ""), r"^\n", "")
    return f.select("path", F.col("f.name").alias("name"), F.trim("f.text").alias("signature"), text.alias("code"), doc.alias("doc"), "at")


def source_functions(files: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Code-description pairs of whole source files: path, name, signature, code, description, n_words; functions whose
    documentation is missing or says nothing are left out."""
    x = brace_functions(files).unionByName(python_functions(files)).withColumn("_lines", cleaned_lines(F.col("doc")))
    x = x.withColumn("n_words", said_words(F.col("_lines"), F.col("name"))).filter(F.col("n_words") >= min_words)
    return x.select("path", "name", "signature", "code", F.array_join("_lines", "\n").alias("description"), "n_words")
