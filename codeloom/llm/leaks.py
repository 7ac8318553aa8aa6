"""Problem 8: evaluation texts leaking into training text.

Method: a distributed positional inverted index. Training texts are tokenized in the consistent form of problem 9;
their postings (term, document, position, and a digest of the three terms on either side) are stored in segments sorted by term. For every
window of twelve test words the rarest term's list is read first and adjusted by the term's offset; the lists of the
neighbouring terms cut it down, then those of all other terms of the item are intersected at their offsets. Runs of
consecutive offsets are exact phrase matches; many offsets within a short span without such a run are proximity matches.

Proximity matches have candidates of their own, by runs of three item words (triples): of a span of NEAR_SPAN words at
most six are not matched, which leave at most seven runs of 18 words or more together, and these hold at least four triples.

The index holds postings of words that some test item holds; those of other words are never read, so they aren't stored:
a whole index would take several times the space of the corpus. A test set of more words than a task can hold is taken in
blocks of items, each with an index of its own, so no test set is too large. Tables are broadcast only after their bytes
were measured; beyond the limit the same join shuffles. No document list is collected, none is cut off.

Defined results: null or empty texts and items shorter than the phrase length match nothing; rows delivered twice count
once; terms that occur in no document rule their windows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from codeloom.io import broadcast_small, spread, stored

from .lookalikes import classes_of_unicode, rewriter

PHRASE_WORDS = 12
#: A proximity match: so many item words within a span of so many, without a whole phrase. They stand at their places
#: from one shift, or in runs of TRIPLE or more at shifts that differ by up to NEAR_SHIFT words, which a word put in,
#: left out or moved makes.
NEAR_WORDS, NEAR_SPAN, NEAR_SHIFT, TRIPLE = 18, 24, 3, 3
#: A proximity match holds at least so many triples at shifts within NEAR_SHIFT.
NEAR_TRIPLES = NEAR_WORDS - (TRIPLE - 1) * (NEAR_SPAN - NEAR_WORDS + 1)
#: Most words of the test items that are looked for at once: what every task holds of them, and what the driver numbers.
BLOCK_WORDS = 1_000_000
#: A phrase of twelve words has six or more on one side of any of its words; three of them are digested.
SIDE, DIGEST, DIGEST_BELOW = 3, (31_337, 7_919, 104_729), 65_521
#: A word: a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(classes: dict[str, str]):
    """text -> its words, in the consistent form and without case."""
    rewrite = rewriter(classes)
    return lambda text: WORD.findall(rewrite(rewrite(text).lower())) if text else []


def item_words(items: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(item_id, off, word) of the items long enough to match."""
    split = F.udf(words_of(classes), ArrayType(StringType()))
    x = items.select("item_id", split("text").alias("w")).distinct().filter(F.size("w") >= PHRASE_WORDS)
    return x.select("item_id", F.posexplode("w").alias("off", "word"))


def postings(docs: DataFrame, terms: dict[str, int], classes: dict[str, str], triples: np.ndarray) -> DataFrame:
    """(term, doc_id, pos, before, after, triple) of every occurrence of a test term in `docs`; before and after digest
    the three words on that side, where -1 stands for any word that is no test term; triple is the key of the word and
    the next two if it is among `triples` (sorted), else null. One pass over the texts, whole."""
    base = len(terms) + 1
    shared = docs.sparkSession.sparkContext.broadcast(triples)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(classes)
        for b in batches:
            ids, starts = [], []
            for text in b.column(1).to_pylist():
                ids += [-1] * SIDE
                starts.append(len(ids))
                ids += [terms.get(w, -1) for w in words(text)]
            ids += [-1] * SIDE
            at = np.array(ids, np.int64)
            side = lambda sign: sum((at[where + sign * (i + 1)] + 1) * f for i, f in enumerate(DIGEST)) % DIGEST_BELOW
            begin = np.array([*starts, len(ids) + 1])
            where = np.flatnonzero(at >= 0)
            doc = np.searchsorted(begin, where, "right") - 1
            known = shared.value
            key = (at[where] * base + at[where + 1]) * base + at[where + 2]
            found = (at[where + 1] >= 0) & (at[where + 2] >= 0)
            if len(known):
                found &= known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            else:
                found[:] = False
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at[where].astype(np.int32)),
                    b.column(0).take(pa.array(doc)),
                    pa.array((where - begin[doc]).astype(np.int32)),
                    pa.array(side(-1).astype(np.int32)),
                    pa.array(side(1).astype(np.int32)),
                    pa.array(key, pa.int64(), mask=~found),
                ],
                names=["term", "doc_id", "pos", "before", "after", "triple"],
            )

    x = spread(docs.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    return x.mapInArrow(segment, "term int, doc_id long, pos int, before int, after int, triple long")


def digest(step, window):
    """What `postings` digests of the terms before (lag) or after (lead) a row."""
    return F.pmod(sum((F.coalesce(step("term", i + 1).over(window), F.lit(-1)).cast("long") + 1) * f for i, f in enumerate(DIGEST)), F.lit(DIGEST_BELOW)).cast("int")


def triples_of(query: DataFrame, n_terms: int) -> DataFrame:
    """(item_id, off, triple) of every three consecutive words of an item (item_id, off, term), keyed as in `postings`."""
    w = Window.partitionBy("item_id").orderBy("off")
    key = F.col("term").cast("long")
    for i in (1, 2):
        key = key * F.lit(n_terms + 1) + F.lead("term", i).over(w)
    return query.select("item_id", "off", key.alias("triple")).filter("triple is not null")


def near_shifts(index: DataFrame, triples: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift) of the shifts whose triples, with those up to NEAR_SHIFT words on, reach NEAR_TRIPLES."""
    hits = (
        index.filter("triple is not null")
        .select("doc_id", "pos", "triple")
        .join(triples, "triple")
        .groupBy("doc_id", "item_id", (F.col("pos") - F.col("off")).alias("shift"))
        .agg(F.count("*").alias("n"))
    )
    band = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    enough = hits.withColumn("n", F.sum("n").over(band.rangeBetween(0, NEAR_SHIFT)))
    # A shift belongs to the bands that begin up to NEAR_SHIFT words before it.
    best = F.max("n").over(band.rangeBetween(-NEAR_SHIFT, 0))
    return enough.withColumn("n", best).filter(F.col("n") >= NEAR_TRIPLES).select("doc_id", "item_id", "shift")


def bands_of_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, item_id, band_matched, band_near) of runs (doc_id, item_id, shift, first, run): the most item words in
    runs of TRIPLE or more at shifts within NEAR_SHIFT, and the most of them within NEAR_SPAN."""
    long = runs.filter(F.col("run") >= TRIPLE)
    band = F.explode(F.sequence(F.col("shift") - NEAR_SHIFT, F.col("shift")))
    words = long.withColumn("band", band).select("doc_id", "item_id", "band", F.explode(F.expr("sequence(first, first + run - 1)")).alias("off")).distinct()
    line = Window.partitionBy("doc_id", "item_id", "band").orderBy(F.col("off").cast("long"))
    return (
        words.withColumn("near", F.count("*").over(line.rangeBetween(0, NEAR_SPAN - 1)))
        .groupBy("doc_id", "item_id", "band")
        .agg(F.count("*").alias("n"), F.max("near").alias("near"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n").alias("band_matched"), F.max("near").alias("band_near"))
    )


def leaks(docs: DataFrame, items: DataFrame, phrase: int = PHRASE_WORDS, proximity: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item: doc_id, item_id, longest_run, matched_words (most of the item's words at one
    alignment, or in runs of three at alignments within NEAR_SHIFT words), match_kind 'phrase' (a run of at least
    `phrase`) or 'proximity'. Without `proximity` phrases only, matched at one alignment."""
    query = stored(item_words(items, classes_of_unicode()), "item-words")
    blocks = max(1, -(-query.count() // block_words))
    found = [_leaks_of(docs, query.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), phrase, proximity) for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _leaks_of(docs: DataFrame, query: DataFrame, phrase: int, proximity: bool) -> DataFrame:
    """`leaks` of one block of items, given as (item_id, off, word)."""
    spark, classes = docs.sparkSession, classes_of_unicode()
    terms = {r.word: i for i, r in enumerate(sorted(query.select("word").distinct().collect()))}
    numbers = spark.createDataFrame(list(terms.items()), "word string, term int")
    by_item = Window.partitionBy("item_id").orderBy("off")
    query = stored(
        query.join(broadcast_small(numbers), "word").select(
            "item_id", "off", "term", *(digest(f, by_item).alias(n) for f, n in ((F.lag, "terms_before"), (F.lead, "terms_after")))
        ),
        "items",
    )
    keys = np.empty(0, np.int64)
    if proximity:
        triples = stored(triples_of(query, len(terms)), "triples")
        keys = np.sort(triples.select("triple").distinct().toArrow().column("triple").to_numpy())
        triples = broadcast_small(triples)
    index = stored(postings(docs, terms, classes, keys), "postings", sort_by=["term", "doc_id"])
    query = broadcast_small(query)
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    # The rarest term of each window of `phrase` words; overlapping windows mostly share it.
    window = by_item.rowsBetween(0, phrase - 1)
    anchors = (
        query.join(frequency, "term", "left")
        .select("item_id", "off", F.min(F.struct(F.coalesce("n", F.lit(0)), "off")).over(window).off.alias("rarest"), F.count("*").over(window).alias("wide"))
        .filter(F.col("wide") == phrase)
        .select("item_id", F.col("rarest").alias("off"))
        .distinct()
        .join(query, ["item_id", "off"])
    )
    anchors = broadcast_small(stored(anchors, "anchors"))
    candidates = (
        index.join(anchors, "term")
        .filter((F.col("before") == F.col("terms_before")) | (F.col("after") == F.col("terms_after")))
        .select("doc_id", "item_id", (F.col("pos") - F.col("off")).alias("shift"))
        .distinct()
    )
    if proximity:
        candidates = candidates.unionByName(near_shifts(index, triples)).distinct()
    candidates = stored(candidates, "candidates")
    chosen = broadcast_small(candidates)
    # Intersect: every term of the item at its own offset from the same shift. Salting isn't needed: a document's
    # postings are bounded by its text.
    met = (
        index.select("term", "doc_id", "pos")
        .join(chosen, "doc_id")
        .withColumn("off", F.col("pos") - F.col("shift"))
        .join(query.select("item_id", "off", "term"), ["item_id", "off", "term"])
        .select("doc_id", "item_id", "shift", "off")
        .distinct()
    )
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("off")
    runs = (
        met.withColumn("island", F.col("off") - F.row_number().over(line))
        .withColumn("near", F.count("*").over(line.rangeBetween(0, NEAR_SPAN - 1)))
        .groupBy("doc_id", "item_id", "shift", "island")
        .agg(F.min("off").alias("first"), F.count("*").cast("int").alias("run"), F.max("near").alias("near"))
    )
    if proximity:
        runs = stored(runs, "runs")
    found = (
        runs.groupBy("doc_id", "item_id", "shift")
        .agg(F.max("run").alias("run"), F.sum("run").alias("matched"), F.max("near").alias("near"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("run").cast("long").alias("longest_run"), F.max("matched").alias("matched_words"), F.max("near").alias("near"))
    )
    if not proximity:
        return found.filter(F.col("longest_run") >= phrase).drop("near").withColumn("match_kind", F.lit("phrase"))
    found = found.join(bands_of_runs(runs), ["doc_id", "item_id"], "left")
    found = found.withColumns({"matched_words": F.greatest("matched_words", "band_matched"), "near": F.greatest("near", "band_near")}).drop("band_matched", "band_near")
    kind = F.when(F.col("longest_run") >= phrase, "phrase").when(F.col("near") >= NEAR_WORDS, "proximity")
    return found.withColumn("match_kind", kind).filter("match_kind is not null").drop("near")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item that leaked: how many documents hold a phrase of it, and the longest run of its words."""
    hits = leaks(docs, items, proximity=False)
    return (
        hits.groupBy("item_id")
        .agg(F.countDistinct("doc_id").alias("n_documents"), F.max("longest_run").alias("longest_run"))
        .join(items.select("item_id", "suite", "kind").distinct(), "item_id")
    )
