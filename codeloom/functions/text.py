"""Text functions as Column expressions; null in, null or empty out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXT = r"\.(?:tsx?|jsx?|py|go|rs|java|md)"
#: Words that carry no topic.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _numbers(found: Column) -> Column:
    return F.transform(F.filter(found, lambda x: F.length(x) <= 18), lambda x: x.cast("long"))


def issue_references(text: Column) -> Column:
    """Numbers written #n or GH-n, above 0, distinct and ascending."""
    return F.array_sort(F.array_distinct(F.filter(_numbers(_all(text, r"(?:#|GH-)(\d+)")), lambda n: n > 0)))


def pull_references(text: Column) -> Column:
    """Numbers of pull requests in order of first mention."""
    return F.array_distinct(_numbers(_all(text, r"(?i)(?:PR\s*#|pull\s+request\s*#)(\d+)")))


def plain_references(text: Column) -> Column:
    """Numbers written #n that aren't pull requests, in order of first mention."""
    return F.array_except(F.array_distinct(_numbers(_all(text, r"#(\d+)"))), pull_references(text))


def urls(text: Column) -> Column:
    return F.array_distinct(_all(text, r"""(?i)(https?://[^\s<>"{}|\\^`\[\]]+)"""))


def url_numbers(found: Column, kind: str) -> Column:
    """Issue or pull numbers in URLs of a code host; kind: 'issues' or 'pull'."""
    got = F.transform(found, lambda u: F.regexp_extract(u, rf"://[^/]+/[^/]+/[^/]+/{kind}/(\d+)", 1))
    return F.array_sort(F.array_distinct(_numbers(F.filter(got, lambda x: x != ""))))


def mentions(text: Column) -> Column:
    """Names written @name, not behind a letter or digit and not before a dot; sorted."""
    return F.array_sort(F.array_distinct(_all(text, r"(?<![A-Za-z0-9])@([A-Za-z0-9][-A-Za-z0-9]*+)(?!\.)")))


def file_paths(text: Column) -> Column:
    """Paths of source files that a text names, 4 to 199 characters, distinct and sorted."""
    found = F.concat(
        _all(text, rf"(?i)```\w*\n(?://|#)\s*([^\n]+{EXT})"),
        _all(text, rf"(?i)`([^\n`]+{EXT})`"),
        _all(text, rf"(?m)(?:^|\s)([A-Za-z0-9_./-]+{EXT})(?=\s|$)"),
        _all(text, rf"(?i)((?:src|packages|libs?|tests?)/[A-Za-z0-9_./-]+{EXT})"),
    )
    clean = F.transform(found, lambda p: F.regexp_replace(F.trim(p), r"^[`'\"]+|[`'\"]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda p: (F.length(p) > 3) & (F.length(p) < 200))))


def words(text: Column) -> Column:
    """Words of three and more letters, digits and hyphens in lower case, without stop words, in order."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """The greater of characters / 4.5 and words * 1.25 of the collapsed text, rounded up; empty is 0."""
    t = collapsed(F.coalesce(text, F.lit("")))
    n = F.greatest(F.ceil(F.length(t) / 4.5), F.ceil(F.size(F.split(t, " ")) * 1.25))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(n).cast("long")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def truncate_to_tokens(text: Column, budget: int) -> Column:
    return F.when(estimate_tokens(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, 4 * budget - 3), F.lit("...")))


def clean_document(text: Column) -> Column:
    """Runs of blanks become one, three and more line breaks two."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def document_text(type_: Column, name: Column, text: Column) -> Column:
    """'type: name', a blank line, the text; parts that are missing fall out."""
    head = F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws(": ", type_, name))
    return F.concat_ws("\n\n", head, F.when(F.coalesce(text, F.lit("")) != "", text))


def snippet_head(snippet: Column, lines: int = 50) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(snippet, "\n")
    more = F.concat(F.lit("\n// ... "), (F.size(parts) - lines).cast("string"), F.lit(" more lines"))
    return F.when(F.size(parts) <= lines, snippet).otherwise(F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), more))


def signature_of(code: Column) -> Column:
    return F.trim(F.substring_index(code, "{", 1))


def remote_key(url: Column) -> Column:
    """owner/repo of a remote URL in lower case, without protocol, user, host and '.git'."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"(?:\.git)?/*$", "")
    u = F.regexp_replace(u, r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    return F.regexp_replace(u, r"^[^/:]+[:/]", "")


def storage_key(url: Column) -> Column:
    return F.substring(F.md5(remote_key(url)), 1, 8)
