"""Problem 9: visually identical text with different characters.

Method: transitive look-alike classes by union-find over strings and code points, a representative for each class by
frequency, greedy rewriting with a multi-pattern automaton. The classes are made over the code points and the
base-plus-mark strings that occur in the corpus; their number is bounded by Unicode, not by the documents, so the
driver holds no more than that table. Counting, rewriting and grouping run on Spark over all rows.

Defined results: a null text stays null and belongs to no group, an empty text is its own form, rows delivered twice
count once, an id that comes with different texts keeps each of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.io import stored

#: Cyrillic and Greek letters that are drawn like Latin ones.
DRAWN_LIKE_LATIN = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
#: Invisible characters outside the format category.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0}

SALTS = 16
#: A class, or the copies of one form, of more rows is split into tiles of about so many, paired by different tasks.
TILE = 500


def plain_form(s: str) -> str:
    """What a string looks like: compatibility forms and look-alike letters made plain, invisible characters gone."""
    out = []
    for c in unicodedata.normalize("NFKD", s):
        kind = unicodedata.category(c)
        if kind == "Cf" or ord(c) in INVISIBLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
            continue
        out.append(" " if kind == "Zs" else DRAWN_LIKE_LATIN.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)


def lookalike_classes(counts: dict[str, int]) -> dict[str, str]:
    """Of each string or code point that isn't its class's representative, the representative. The representative is
    the plain ASCII member if there is one, whatever its frequency, so that plain text never changes; else the member seen
    most often; ties go to the shortest, then the lowest. Classes without an ASCII member are thus decided by frequency."""
    sets = UnionFind()
    for s in counts:
        sets.find(s)
        for t in (plain_form(s), unicodedata.normalize("NFC", s), "".join(map(plain_form, s))):
            sets.union(s, t)
    members: dict[str, list[str]] = {}
    for s in list(sets.up):
        members.setdefault(sets.find(s), []).append(s)
    out = {}
    for group in members.values():
        stable = [s for s in group if s == unicodedata.normalize("NFC", s)] or group
        best = min(stable, key=lambda s: (not s.isascii(), -counts.get(s, 0), len(s), s)) if "" not in group else ""
        out |= {s: best for s in group if s != best}
    return out


@lru_cache(maxsize=1)
def classes_of_unicode() -> dict[str, str]:
    """The classes over every code point that has a look-alike, whether a corpus holds it or not: the same relation as
    over a corpus, with representatives chosen without frequencies. For comparisons that need no reading of the corpus."""
    kinds = unicodedata.category
    points = (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i <= 0xDFFF and not 0x30000 <= i < 0xE0000 and i < 0xF0000)
    return lookalike_classes({c: 0 for c in points if kinds(c) in ("Cf", "Zs", "Mn") or c in DRAWN_LIKE_LATIN or ord(c) in INVISIBLE or unicodedata.normalize("NFKD", c) != c})


def strings_counted(texts: DataFrame) -> dict[str, int]:
    """How often each non-ASCII code point, and each character with combining marks, occurs in column `text`. At most as
    many entries as Unicode has code points and compositions: strings that compose to nothing are left out."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            s = "".join(t for t in b.column(0).to_pylist() if t and not t.isascii())
            total += np.bincount(np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32), minlength=0x110000)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in at], pa.string()), pa.array(total[at])], names=["s", "n"])

    x = texts.select("text").filter("text is not null")
    one = x.mapInArrow(points, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("ascii(s) > 127")
    marks = F.regexp_extract_all("text", F.lit(r"(\P{M}\p{M}+)"), F.lit(1))
    more = x.filter(F.col("text").rlike(r"\p{M}")).select(F.explode(marks).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    composed = F.udf(lambda s: len(plain_form(s)) == 1, "boolean")
    return {r.s: r.n for r in one.unionByName(more.filter(composed("s"))).collect()}


def rewriter(replace: dict[str, str]):
    """A function that rewrites a text greedily, the longest match from the left first. Where that brings a letter and
    its accent together (an invisible character between them is gone), they compose, and the text is read once more."""
    import ahocorasick  # here, so that its absence doesn't hide the other operators

    marks = set().union(*replace) if replace else set()
    seen: set[str] = set()
    auto = None

    def once(text: str) -> str:
        nonlocal auto
        fresh = marks.intersection(text) - seen
        if fresh:  # the automaton holds what the texts so far can hold: it stays small, whatever the classes
            seen.update(fresh)
            auto = ahocorasick.Automaton()
            for s, t in replace.items():
                if s and seen.issuperset(s):
                    auto.add_word(s, (len(s), t))
            auto.make_automaton()
        if not auto:
            return text
        out, at = [], 0
        for end, (n, t) in auto.iter_long(text):
            out.append(text[at : end + 1 - n])
            out.append(t)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def rewrite(text: str | None) -> str | None:
        if not text or text.isascii() or not replace:
            return text
        for _ in range(len(text) + 2):  # until it stays as it is; each round brings at least one pair together
            before, text = text, unicodedata.normalize("NFC", once(text))
            if text == before:
                return text
        raise RuntimeError("the look-alike classes have no stable form")

    return rewrite


def consistent_form(classes: dict[str, str], text: Column | str) -> Column:
    """The text with every look-alike replaced by its representative. `classes` travels with the task."""

    made: list = []

    @F.pandas_udf(StringType())
    def form(s: pd.Series) -> pd.Series:
        if not made:
            made.append(rewriter(classes))
        return s.map(made[0], na_action="ignore").astype(object)

    return form(text)


def normalized(docs: DataFrame, classes: dict[str, str] | None = None) -> DataFrame:
    """docs with the column `consistent_text`."""
    return docs.withColumn("consistent_text", consistent_form(strings_and_classes(docs) if classes is None else classes, "text"))


def strings_and_classes(*tables: DataFrame) -> dict[str, str]:
    """The look-alike classes of all texts of the tables together."""
    counts: dict[str, int] = {}
    for t in tables:
        for s, n in strings_counted(t).items():
            counts[s] = counts.get(s, 0) + n
    return lookalike_classes(counts)


def classes_of_documents(docs: DataFrame) -> DataFrame:
    """One row per document and stored text: doc_id, class_id (the least doc_id of all that look the same), form_id (the
    least doc_id with exactly this text), n_documents and n_forms of the class."""
    keyed = normalized(docs.filter("text is not null").select("doc_id", "text")).select(
        "doc_id", F.md5("consistent_text").alias("key"), F.md5("text").alias("form")
    )
    return groups_of_forms(stored(keyed.distinct(), "forms"), "doc_id")


def groups_of_forms(keyed: DataFrame, id_col: str) -> DataFrame:
    """(id, key, form) to (id, class_id, form_id, n_documents, n_forms). Counts are combined before the shuffle, and the
    join back is salted, so that a class holding a third of all rows is spread over many tasks."""
    forms = keyed.groupBy("key", "form").agg(F.min(id_col).alias("form_id"), F.count("*").alias("_n"))
    keys = forms.groupBy("key").agg(F.min("form_id").alias("class_id"), F.sum("_n").alias("n_documents"), F.count("*").alias("n_forms"))
    small = forms.drop("_n").join(keys, "key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    groups = (
        keyed.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        .join(small, ["key", "form", "_salt"])
        .select(F.col(id_col), "class_id", "form_id", "n_documents", "n_forms")
    )
    return stored(groups, "groups")


def pairs_of_key(rows: DataFrame, key: str, id_col: str, size: str) -> DataFrame:
    """(a, b), a < b: all pairs of the ids of one key, which come once each; `size` counts them. Large keys are paired
    tile against tile."""
    x = rows.withColumn("_tiles", F.ceil(F.col(size) / TILE).cast("int"))
    x = x.withColumn("_tile", F.pmod(F.xxhash64(id_col), F.col("_tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = x.select(F.col(key).alias("_key"), F.col("_tile").alias("_i"), other.alias("_j"), F.col(id_col).alias("a"))
    right = x.select(F.col(key).alias("_key"), other.alias("_i"), F.col("_tile").alias("_j"), F.col(id_col).alias("b"))
    return left.join(right, ["_key", "_i", "_j"]).filter("a < b").select("a", "b")


def pairs_of_members(pairs: DataFrame, members: DataFrame, owner: str, id_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: for each of `pairs` (a, b) of owners every member of one with every member of the
    other; an owner without rows in `members` (owner, id) stands for itself. Members of large owners are split into tiles."""
    sizes = members.groupBy(owner).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles")).filter("_tiles > 1")
    tiles = lambda name: F.coalesce(F.col(name), F.lit(1))
    m = members.select(owner, id_col).join(sizes, owner, "left").withColumn("_tile", F.pmod(F.xxhash64(id_col), tiles("_tiles")).cast("int"))
    x = pairs.select("a", "b")
    for s in "ab":
        x = x.join(sizes.select(F.col(owner).alias(s), F.col("_tiles").alias(f"_n{s}")), s, "left")
    for s in "ab":
        x = x.withColumn(f"_t{s}", F.explode(F.sequence(F.lit(0), tiles(f"_n{s}") - 1)))
    for s in "ab":
        side = m.select(F.col(owner).alias(s), F.col("_tile").alias(f"_t{s}"), F.col(id_col).alias(f"_id{s}"))
        x = x.join(side, [s, f"_t{s}"], "left").withColumn(f"_id{s}", F.coalesce(f"_id{s}", s))
    x = x.select(F.least("_ida", "_idb").alias(f"{id_col}_a"), F.greatest("_ida", "_idb").alias(f"{id_col}_b"))
    return x.filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))


def links_between_forms(groups: DataFrame, id_col: str) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows in one class with different forms: all of them, whatever the size of the
    class. Forms are paired first, then their rows, so exact copies are never compared."""
    g = groups.filter("n_forms > 1")
    forms = pairs_of_key(g.select("class_id", "form_id", "n_forms").distinct(), "class_id", "form_id", "n_forms")
    return pairs_of_members(forms, g, "form_id", id_col).distinct()
