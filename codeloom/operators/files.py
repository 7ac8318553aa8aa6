"""Source files: discovery, validation, change detection and a line-based declaration scanner.

A path delivered twice counts once. Null content counts as empty. All work is JVM expressions over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classes import extension, language_of
from codeloom.io import spread

#: Folders and files that discovery leaves out unless told otherwise.
EXCLUDED_DIRS = [
    "node_modules", "bower_components", "vendor", "third_party",
    "dist", "build", "out", "target", ".next", ".turbo", ".nuxt",
    "mocks", "testdata",
    ".git", ".svn", ".hg", ".vscode", ".idea", ".vs", ".fleet",
    ".cache", ".parcel-cache", ".vite", "coverage", ".nyc_output", "logs", "tmp", "temp",
    "__fixtures__", "__snapshots__", "fixtures", "analysis-reports", ".research", "benchmarks",
]
EXCLUDED_FILES = [
    "*.pb.go", "*.gen.go", "*_gen.go", "*.pb.gw.go", "mock_*.go", ".eslintcache", "*.log", "*.tmp",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", ".DS_Store", "Thumbs.db",
]


def glob_pattern(names: list[str]) -> str:
    """The names, where '*' stands for any characters of one path segment, as one pattern."""
    return "|".join(n.replace(".", r"\.").replace("*", "[^/]*") for n in names)


def discover(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Paths of known languages (or of the given extensions) outside the excluded folders. The default exclusions hold
    only where `exclude` isn't given."""
    p = F.col("path")
    wanted = extension(p).isin([e.lstrip("*.").lower() for e in include]) if include else language_of(p) != "unknown"
    dirs = EXCLUDED_DIRS if exclude is None else exclude
    x = files.filter(wanted & p.isNotNull())
    if dirs:
        x = x.filter(~p.rlike(rf"(^|/)(?:{glob_pattern(dirs)})/"))
    return x.filter(~p.rlike(rf"(^|/)(?:{glob_pattern(EXCLUDED_FILES)})$")) if exclude is None else x


def validated(files: DataFrame) -> DataFrame:
    """path, status: 'empty', 'blank', 'binary' or 'ok'."""
    c = F.coalesce("content", F.lit(""))
    status = F.when(c == "", "empty").when(F.trim(F.regexp_replace(c, r"\s+", "")) == "", "blank").when(c.contains("\x00"), "binary").otherwise("ok")
    return files.filter("path is not null").groupBy("path").agg(F.max(status).alias("status"))


def line_count(content: Column) -> Column:
    """Pieces between line feeds: a trailing one adds a line, as in the contract."""
    return F.size(F.split(F.coalesce(content, F.lit("")), "\n", -1)).cast("long")


def is_test_file(path: Column) -> Column:
    return F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec."))


def test_candidates(path: Column) -> Column:
    """x.ts to x.test.ts and x.spec.ts, in order of preference."""
    stem, ext = F.regexp_extract(path, r"^(.*)\.[^./]+$", 1), F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.array(*[F.concat(stem, F.lit(f".{k}."), ext) for k in ("test", "spec")])


def related_tests(files: DataFrame, candidates=test_candidates) -> DataFrame:
    """path, test: each file that is no test with its first existing test file, null where there is none. `candidates`
    names the test files of a path in order of preference."""
    f = files.select("path").filter("path is not null").distinct()
    c = f.filter(~is_test_file(F.col("path"))).select("path", F.posexplode(candidates(F.col("path"))).alias("n", "test"))
    found = c.join(f.select(F.col("path").alias("test")), "test")
    best = found.groupBy("path").agg(F.min_by("test", "n").alias("test"))
    return f.filter(~is_test_file(F.col("path"))).join(best, "path", "left")


def generated_go(content: Column) -> Column:
    return F.substring_index(F.coalesce(content, F.lit("")), "\n", 1).rlike("Code generated|DO NOT EDIT")


def current_state(files: DataFrame) -> DataFrame:
    """path, hash (SHA-256 of the content), size, language: one row per path."""
    x = files.filter("path is not null").select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), F.col("length").alias("size"), "language")
    return x.groupBy("path").agg(F.max(F.struct("hash", "size", "language")).alias("r")).select("path", "r.*")


def detect_changes(state: DataFrame, files: DataFrame) -> DataFrame:
    """path, change: 'added', 'deleted', 'changed' or 'unchanged', by one full outer join on the path. A file whose stored
    hash is null counts as changed."""
    s = state.filter("path is not null").groupBy("path").agg(F.max("hash").alias("was")).withColumn("_s", F.lit(True))
    n = current_state(files).select("path", F.col("hash").alias("now")).withColumn("_n", F.lit(True))
    change = F.when(F.col("_s").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return s.join(n, "path", "full_outer").select("path", change.alias("change"))


def apply_update(components: DataFrame, state: DataFrame, files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Components after an incremental update: those of changed and deleted files go, those scanned anew from changed and
    added files come in. scanned: rows of current files in the columns of components."""
    ch = detect_changes(state, files)
    gone = ch.filter("change in ('changed', 'deleted')").select(F.col("path").alias("file"))
    new = ch.filter("change in ('changed', 'added')").select(F.col("path").alias("file"))
    return components.join(gone, "file", "left_anti").unionByName(scanned.join(new, "file", "left_semi").select(*components.columns))


def state_of(components: DataFrame) -> DataFrame:
    """file, document_ids (sorted), n: what was indexed of each file."""
    x = components.dropDuplicates(["id"]).filter("file is not null").groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("document_ids"))
    return x.withColumn("n", F.size("document_ids"))


def state_drift(state: DataFrame, components: DataFrame) -> DataFrame:
    """path, missing, stale: ids that a file's state doesn't name though they exist, and the other way round; files that
    agree are left out."""
    a = state.filter("path is not null").select("path", F.explode("document_ids").alias("id")).distinct()
    b = components.filter("file is not null").select(F.col("file").alias("path"), "id").distinct()
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["path", "id"], "full_outer")
    x = j.groupBy("path").agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_b").isNull()).alias("stale"))
    return x.filter("missing + stale > 0")


#: How a line begins that declares something, by language family; the name is the one group.
DECLARATIONS = {
    "ecma": [
        ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
        ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("interface", r"^(?:export\s+)?(?:default\s+)?interface\s+([A-Za-z_$][\w$]*)"),
        ("type", r"^(?:export\s+)?type\s+([A-Za-z_$][\w$]*)[^=]*="),
        ("variable", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
    ],
    "go": [
        ("function", r"^func\s+([A-Za-z_]\w*)\s*[\[(]"),
        ("method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("),
        ("class", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b"),
        ("interface", r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b"),
    ],
    "python": [("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("class", r"^class\s+([A-Za-z_]\w*)")],
}


#: Fixed value: the type that a Go method belongs to.
GO_RECEIVER = r"^func\s+\(\s*(?:\w+\s+)?\*?\s*([A-Za-z_]\w*)"


def family(language: Column) -> Column:
    return F.when(language.isin("typescript", "javascript"), "ecma").when(language.isin("go", "python"), language)


def source_lines(files: DataFrame, by_file: bool = False) -> DataFrame:
    """(path, language, line_no, line): one row per line, without byte-order mark and carriage returns. The lines of a file
    delivered twice come twice; with `by_file` they come once and lie together, so that windows by path shuffle nothing more."""
    x = files.filter("path is not null").select("path", "content")
    x = x.repartition("path").dropDuplicates(["path", "content"]) if by_file else spread(x)
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "^﻿|\r", "")
    x = x.select("path", language_of(F.col("path")).alias("language"), text.alias("content"))
    x = x.select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    return x.select("path", "language", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def declared_lines(files: DataFrame, by_file: bool = False) -> DataFrame:
    """The lines of files with type, own (the declared name) and name (with a Go method's receiver), null where a line
    declares nothing at the left margin. Generated Go files are skipped."""
    f = files.filter(~((language_of(F.col("path")) == "go") & generated_go(F.col("content"))))
    x = source_lines(f, by_file)
    may = F.col("line").rlike(r"^(?:export|default|async|abstract|function|class|interface|type|const|let|var|func|def)\b")
    fam, kind, name = family(F.col("language")), F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, rules in DECLARATIONS.items():
        for k, pattern in rules:
            hit = may & (fam == language) & F.col("line").rlike(pattern)
            kind, name = F.coalesce(kind, F.when(hit, k)), F.coalesce(name, F.when(hit, F.regexp_extract("line", pattern, 1)))
    x = x.withColumn("type", kind).withColumn("own", name)
    return x.withColumn("name", F.when(F.col("type") == "method", F.concat_ws(".", F.regexp_extract("line", GO_RECEIVER, 1), "own")).otherwise(F.col("own")))


def declared_fields() -> list[Column]:
    """id, file, name, type, start_line, signature and exported of a row of `declared_lines` that declares something."""
    fam = family(F.col("language"))
    exported = F.when(fam == "ecma", F.col("line").startswith("export")).when(fam == "go", F.col("own").rlike(r"^\p{Lu}")).otherwise(~F.col("name").startswith("_"))
    sig = F.trim(F.regexp_replace(F.substring_index("line", "{", 1), r"\s*=>\s*$|\s*=\s*$", ""))
    return [F.concat_ws(":", "path", "name", "line_no").alias("id"), F.col("path").alias("file"), F.col("name"), F.col("type"), F.col("line_no").alias("start_line"), sig.alias("signature"), exported.alias("exported")]


def declarations(files: DataFrame) -> DataFrame:
    """id, file, name, type, start_line, signature, exported: what stands at the left margin of each file. Methods of
    classes and nested functions aren't at the margin and are left to a parser. Generated Go files are skipped."""
    return declared_lines(files).filter("type is not null").select(*declared_fields()).distinct()  # narrow rows, not texts


def doc_lines(files: DataFrame) -> DataFrame:
    """file, line_no, doc: of each Go declaration the comment lines right above it, by gaps and islands over the lines."""
    x = source_lines(files.filter(F.col("path").endswith(".go")), by_file=True)
    w = Window.partitionBy("path").orderBy("line_no")
    comment = F.col("line").startswith("//")
    x = x.withColumn("c", comment).withColumn("island", F.sum(F.when(comment, 0).otherwise(1)).over(w))
    x = x.withColumn("above", F.lag("c").over(w))
    docs = x.filter("c").groupBy("path", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: F.regexp_replace(r.line, r"^//\s?", "")), "\n").alias("doc"))
    heads = x.filter("not c and above").filter(F.col("line").rlike(r"^(?:func|type|const|var)\b")).select("path", F.col("line_no"), (F.col("island") - 1).alias("island"))
    return heads.join(docs, ["path", "island"]).select(F.col("path").alias("file"), "line_no", "doc")


def imports(files: DataFrame) -> DataFrame:
    """path, module, kind: modules a file imports: ES imports and re-exports, require calls, Go and Python imports."""
    text, fam = F.coalesce("content", F.lit("")), family(language_of(F.col("path")))
    none = F.array().cast("array<string>")
    got = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    es = F.when(fam == "ecma", F.concat(got(r"(?m)^import\s[^'\";]*?['\"]([^'\"\n]+)['\"]"), got(r"(?m)^export\s[^'\";=(]*?from\s+['\"]([^'\"\n]+)['\"]"))).otherwise(none)
    cjs = F.when(fam == "ecma", got(r"\brequire\s*\(\s*['\"]([^'\"\n]+)['\"]")).otherwise(none)
    go = F.when(fam == "go", got(r"(?m)^\t(?:[\w.]+\s+)?\"([^\"\n]+)\"$")).otherwise(none)
    py = F.when(fam == "python", got(r"(?m)^(?:from|import)\s+([\w.]+)")).otherwise(none)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("modules")) for k, v in (("esm", es), ("cjs", cjs), ("go", go), ("python", py))])
    x = files.filter("path is not null").select("path", F.explode(rows).alias("r")).select("path", "r.kind", F.explode("r.modules").alias("module"))
    return x.distinct()


def markdown_sections(files: DataFrame) -> DataFrame:
    """id, file, name, start_line, docstring (the first 200 characters), text: one row per heading with content. Fences hide headings; list items, tables
    and quotes don't count as content; text before the first heading belongs to none. A running count of headings carries
    each line to its section."""
    x = source_lines(files.filter(language_of(F.col("path")) == "markdown"), by_file=True)
    w = Window.partitionBy("path").orderBy("line_no")
    x = x.withColumn("fence", F.col("line").rlike(r"^\s{0,3}(?:```|~~~)"))
    x = x.withColumn("open", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(w) % 2 == 1)
    head = F.col("line").rlike(r"^#{1,6}(?:\s|$)") & ~F.col("open") & ~F.col("fence")
    x = x.withColumn("head", head).withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w))
    code = F.col("open") | F.col("fence")
    prose = ~F.col("head") & ~code & (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(?:[-*+]\s|\d+[.)]\s|>|\||<!--|(?:[-*_]\s*){3,}$)")
    kind = F.when(code, "code").when(prose, "prose")
    # Blocks are set apart by an empty line: one begins with a fence that opens, or with prose behind anything else.
    x = x.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    begins = (F.col("fence") & F.col("open")) | ((F.col("kind") == "prose") & ~F.coalesce(F.col("before") == "prose", F.lit(False)))
    x = x.filter("section > 0").withColumn("piece", F.when(begins, F.concat(F.lit("\n"), "line")).otherwise(F.col("line")))
    name = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s*", ""), r"\s+#+\s*$", ""))
    g = x.groupBy("path", "section").agg(
        F.min(F.when(F.col("head"), F.col("line_no"))).alias("start_line"),
        F.min_by(F.when(F.col("head"), name), F.when(F.col("head"), F.col("line_no"))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("line_no", "piece")))), lambda r: r.piece), "\n").alias("content"),
    )
    g = g.withColumn("content", F.regexp_replace("content", r"^\n", ""))
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return g.filter("content <> ''").select(
        F.concat_ws(":", "path", slug, "start_line").alias("id"), F.col("path").alias("file"), "name", "start_line",
        F.substring("content", 1, 200).alias("docstring"), F.concat_ws("\n\n", "name", "content").alias("text"),
    )


def folder_sizes(files: DataFrame, levels: int = 2) -> DataFrame:
    """folder, files, bytes: of the folders of the first levels."""
    x = files.filter("path is not null").groupBy("path").agg(F.max("length").alias("n"))
    p = F.split("path", "/")
    x = x.withColumn("folder", F.array_join(F.slice(p, 1, F.least(F.size(p) - 1, F.lit(levels))), "/"))
    return x.groupBy("folder").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


#: A method's header one level inside a class.
METHOD = {
    "ecma": r"^(?: {2}| {4}|\t)(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*\(.*\{\s*$",
    "python": r"^(?: {4}|\t)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(",
}
NOT_METHODS = ["if", "for", "while", "switch", "catch", "with", "return", "function"]


def methods(files: DataFrame) -> DataFrame:
    """id, file, name (Class.method), start_line, signature, is_async: methods one level inside the classes at the left
    margin. The class carries forward line by line until the margin is met again."""
    x = source_lines(files.filter(family(language_of(F.col("path"))).isin("ecma", "python")), by_file=True)
    fam = family(F.col("language"))
    owner = F.when(F.col("line").rlike(DECLARATIONS["ecma"][1][1]) & (fam == "ecma"), F.regexp_extract("line", DECLARATIONS["ecma"][1][1], 1))
    owner = owner.when(F.col("line").rlike(DECLARATIONS["python"][1][1]) & (fam == "python"), F.regexp_extract("line", DECLARATIONS["python"][1][1], 1))
    owner = owner.when(F.col("line").rlike(r"^\S"), "")  # anything else at the margin ends a class
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("owner", F.last(owner, ignorenulls=True).over(w)).filter("owner <> ''")
    name = F.when(fam == "ecma", F.regexp_extract("line", METHOD["ecma"], 1)).otherwise(F.regexp_extract("line", METHOD["python"], 1))
    x = x.withColumn("own", name).filter((F.col("own") != "") & ~F.col("own").isin(NOT_METHODS))
    full = F.concat_ws(".", "owner", "own")
    return x.select(
        F.concat_ws(":", "path", full, "line_no").alias("id"), F.col("path").alias("file"), full.alias("name"), F.col("line_no").alias("start_line"),
        F.trim(F.regexp_replace("line", r"\s*[{:]\s*$", "")).alias("signature"), F.col("line").rlike(r"\basync\b").alias("is_async"),
    )

