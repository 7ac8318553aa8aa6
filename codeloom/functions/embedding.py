"""A deterministic embedder behind an Arrow UDF: hashed words and character trigrams, added up and L2-normalized.
Weights are whole numbers, so sums don't depend on their order.

It stands where a sentence model would; scores aren't comparable with such a model's. Any function from a list of texts to
a float matrix can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSION = 128
#: What a word and each of its trigrams count.
WORD_WEIGHT, TRIGRAM_WEIGHT = 10, 3
_WORD = re.compile(r"[A-Za-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[_\W]+")


@lru_cache(maxsize=200_000)
def _parts(word: str, dimension: int) -> tuple[tuple[int, int], ...]:
    out = []
    for part, weight in [(word, WORD_WEIGHT), *((f"#{word[i : i + 3]}", TRIGRAM_WEIGHT) for i in range(len(word) - 2))]:
        h = int(hashlib.md5(part.encode()).hexdigest()[:8], 16)
        out.append((h % dimension, weight if h >= 1 << 31 else -weight))
    return tuple(out)


def hashed(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """One unit vector per text; a text without words is the zero vector."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts):
        for word in _WORD.findall(_CAMEL.sub(" ", text or "")):
            for at, weight in _parts(word.lower(), dimension):
                row[at] += weight
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column | str, provider: Callable[[list[str]], np.ndarray] = hashed) -> Column:
    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(list(provider(s.fillna("").tolist())), index=s.index)

    return vectors(text)
