"""Scalar rules as Column expressions: classes, scores and number formats. All are null-safe: null in, the stated default out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step that value reaches; null counts as 0."""
    v, out = F.coalesce(value, F.lit(0)), None
    for least, name in steps:
        out = F.when(v >= least, name) if out is None else out.when(v >= least, name)
    return out.otherwise(otherwise)


def activity(commits: Column) -> Column:
    return banded(commits, [(100, "very-high"), (50, "high"), (20, "medium"), (5, "low")], "minimal")


def size(lines: Column) -> Column:
    return banded(lines, [(2000, "very-large"), (1000, "large"), (500, "medium"), (100, "small")], "tiny")


def ownership(authors: Column) -> Column:
    a = F.coalesce(authors, F.lit(0))
    return F.when(a == 1, "single").when(a == 2, "pair").when(a <= 5, "small-team").otherwise("shared")


def risk(commits: Column, lines: Column, authors: Column) -> Column:
    """commits * lines / authors, where fewer than one author counts as one."""
    zero = F.lit(0)
    return F.coalesce(commits, zero) * F.coalesce(lines, zero) / F.greatest(F.coalesce(authors, zero), F.lit(1))


def numeric_diff(before: Column, after: Column) -> dict[str, Column]:
    """before, after, absolute and percent change; from nothing to something is 100 percent."""
    b, a = F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))
    percent = F.when(b == 0, F.when(a == 0, 0.0).otherwise(100.0)).otherwise(F.round((a - b) / b * 100, 2))
    return {"before": b, "after": a, "absolute": a - b, "percent": percent.cast("double")}


def trend(files_delta: Column) -> Column:
    return F.when(files_delta > 10, "growing").when(files_delta < -10, "shrinking").otherwise("stable")


def human_bytes(n: Column) -> Column:
    """Steps of 1024 with two decimals."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    step = F.when(n < 1, 0).otherwise(F.floor(F.log(1024.0, n))).cast("int")
    return F.when(n < 1, F.lit("0 Bytes")).otherwise(
        F.concat(F.regexp_replace(F.round(n / F.pow(F.lit(1024.0), step), 2).cast("string"), r"\.0$", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB", "TB", "PB"])), step + 1))
    )


def time_since(then: Column, now: Column) -> Column:
    """'just now', minutes, hours, days, months, years ago. `now` is an input, never the clock."""
    m = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    say = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return (
        F.when(then.isNull(), F.lit("never")).when(m < 1, F.lit("just now")).when(m < 60, say(m, "minute")).when(m < 1440, say(F.floor(m / 60), "hour"))
        .when(m < 43200, say(F.floor(m / 1440), "day")).when(m < 525600, say(F.floor(m / 43200), "month")).otherwise(say(F.floor(m / 525600), "year"))
    )


def duration(ms: Column) -> Column:
    s = F.coalesce(ms, F.lit(0)) / 1000
    return F.when(s < 1, F.concat(F.coalesce(ms, F.lit(0)).cast("string"), F.lit("ms"))).when(s < 60, F.concat(F.round(s, 1).cast("string"), F.lit("s"))).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.round(s % 60).cast("int").cast("string"), F.lit("s"))
    )


#: Languages by extension.
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "py": "python", "md": "markdown", "mdx": "markdown", "markdown": "markdown"}


def extension(path: Column) -> Column:
    """The last extension in lower case without its dot, or ''."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    ext, out = extension(path), None
    for e, name in LANGUAGE_OF.items():
        out = F.when(ext == e, name) if out is None else out.when(ext == e, name)
    return out.otherwise("unknown")
