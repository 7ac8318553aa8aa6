"""Problem 5: splitting oversized items at natural boundaries.

Method: balanced targets. The least number of pieces that can hold the item is computed, targets are placed at equal
lengths, each is snapped to the strongest boundary nearby, and a piece is added when any piece would exceed the limit.
Boundaries, strongest first: blank line, end of a block, end of a line, end of a sentence, white space, whatever the line
ends; where there is none in reach the cut falls between two characters, never between a letter and its marks.

Each piece but the first starts exactly `overlap` characters before the end of the one before, as the overlap is given,
not sought. Pieces cover the item: their bodies (from `body_start` to `end`) joined give it back exactly.

Defined results: null and short texts yield no pieces; lengths are code points; an item of one endless word is cut
evenly; rows delivered twice count once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: What ends at a boundary, with its strength.
BOUNDARIES = [
    (re.compile(r"(?>\r\n?|\n)[ \t]*(?>\r\n?|\n)"), 5),
    (re.compile(r"(?>\r\n?|\n)(?=\S)|[}\]);](?>\r\n?|\n)"), 4),
    (re.compile(r"(?>\r\n?|\n)"), 3),
    (re.compile(r"[.!?;:]['\")\]]?\s"), 2),
    (re.compile(r"\s+"), 1),
]
PIECE = "field_name string, piece int, n_pieces int, start int, body_start int, end int, boundary int, text string"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions behind which a cut may fall, ascending, and the strength of each."""
    best: dict[int, int] = {}
    for pattern, strength in BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    at = sorted(best)
    return at, [best[p] for p in at]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(end, strength) of each piece; the last is (len(text), 0)."""
    n = len(text)
    if n <= limit:
        return [(n, 0)]
    room = limit - overlap  # what a piece brings forward, besides its overlap
    at, strength = boundaries(text)
    pieces = max(2, -(-(n - overlap) // room))
    while True:
        step, out, begin, fits = n / pieces, [], 0, True
        for i in range(1, pieces):
            target = round(i * step)
            most = begin + (limit if begin == 0 else room)
            # The reach shrinks as the step nears what fits, so that a snap cannot make the next piece too long.
            reach = max(1, min(int(step // 3), int(room // 3)))
            low, high = max(begin + 1, target - reach), min(most, target + reach, n - 1)
            if low > high:
                fits = False
                break
            k, j = bisect_left(at, low), bisect_right(at, high)
            best = max(((strength[q], -abs(at[q] - target), at[q]) for q in range(k, j)), default=None)
            cut, s = (best[2], best[0]) if best else (min(max(target, low), high), 0)
            while not best and cut > low and unicodedata.combining(text[cut]):
                cut -= 1
            out.append((cut, s))
            begin = cut
        if fits and n - begin <= (room if begin else limit):
            return [*out, (n, 0)]
        pieces += 1


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int, str]]:
    """(start, body_start, end, boundary, text) of each piece in order. The overlap is exact but for the first piece."""
    begin = 0
    for end, strength in cuts(text, limit, overlap):
        start = max(0, begin - overlap) if begin else 0
        yield start, begin, end, strength, text[start:end]
        begin = end


def split_oversized(items: DataFrame, fields: list[str], limit: int = LIMIT, overlap: int = OVERLAP, key: str = "id") -> DataFrame:
    """One row per piece of each field longer than `limit`: key, field_name, piece, n_pieces, start, body_start, end,
    boundary (strength of the cut at its end), text.

    Only oversized fields reach Python; copies are dropped before. One item is cut at a time, by the task that holds it."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    f = F.explode(F.array(*[F.struct(F.lit(x).alias("field_name"), F.col(x).alias("text")) for x in fields]))
    long = items.filter(reduce(Column.__or__, [F.coalesce(F.length(x), F.lit(0)) > limit for x in fields]))
    long = long.select(F.col(key), f.alias("f")).select(key, "f.*").filter(F.length("text") > limit).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, name, text in zip(b[key], b["field_name"], b["text"]):
                got = list(pieces_of(text, limit, overlap))
                rows += [(k, name, i, len(got), *p) for i, p in enumerate(got)]
            yield pd.DataFrame(rows, columns=[key, "field_name", "piece", "n_pieces", "start", "body_start", "end", "boundary", "text"])

    return long.mapInPandas(split, f"{key} {dict(items.dtypes)[key]}, {PIECE}")


def cover(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "id") -> DataFrame:
    """One row per split field: key, field_name, n_chars and digest (MD5) of its bodies joined, and whether every piece is
    within the limit and overlaps the one before as wanted. For checks: the digest must be that of the field."""
    body = F.expr("substring(text, CAST(body_start - start + 1 AS INT), CAST(end - body_start AS INT))")
    fits = (F.length("text") <= limit) & ((F.col("piece") == 0) | (F.col("body_start") - F.col("start") == overlap))
    rows = F.array_sort(F.collect_list(F.struct("piece", body.alias("body"))))
    x = pieces.groupBy(key, "field_name").agg(F.array_join(F.transform(rows, lambda r: r.body), "").alias("t"), F.min(fits).alias("fits"))
    return x.select(key, "field_name", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), "fits")
