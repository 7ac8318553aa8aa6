"""Problem 4: near-duplicate records with small edits.

Method: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity. A
shingle is a run of `SHINGLE` consecutive tokens; its weight is (1 + ln tf) * ln(1 + N / df). Document frequencies are
counted over all records in a table of fixed size (hashed terms), so that table is bounded whatever the collection.
Each record's samples form bands of `ROWS`; two records are candidates if they share at least `AGREE` bands. Candidates
are verified exactly: the weighted similarity is reported, and pairs below the wanted Jaccard similarity are dropped.

Records with the same tokens are copies: one of each class is sampled and compared, and membership comes beside it.
Buckets are never cut: a large one is split into tiles that are compared tile against tile by different tasks. What goes
to every task is either of fixed size (document frequencies) or broadcast only after its bytes were measured.

Defined results: null and short snippets (fewer than `MIN_TOKENS` tokens) take part in nothing; rows delivered twice
count once; an id that comes with different snippets keeps the least of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.io import broadcast_small, stored

from .lookalikes import SALTS, groups_of_forms, pairs_of_key, pairs_of_members

SHINGLE, MIN_TOKENS, SIMILARITY = 3, 40, 0.6
BANDS, ROWS, AGREE = 36, 3, 2
#: Terms are counted in this many buckets: the size of the table that every task gets.
DF_BUCKETS = 1 << 18
#: A bucket of more members is split into tiles of about so many.
TILE = 500
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def functions_once(components: DataFrame) -> DataFrame:
    """(id, snippet) of functions and methods, once each."""
    kind = F.lower(F.col("type")).isin("function", "method") & F.col("snippet").isNotNull() & F.col("id").isNotNull()
    return components.filter(kind).groupBy("id").agg(F.min("snippet").alias("snippet"))


def shingle_sets(records: DataFrame) -> DataFrame:
    """(id, form, shingles, tf) of records (id, snippet) of at least MIN_TOKENS tokens: a digest of all tokens, and the
    sorted 32-bit shingle digests with how often each occurs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}  # a token's digest, kept for the task: a cache, emptied when it grows
        for b in batches:
            ids, forms, out, counts = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = TOKEN.findall(text)
                if len(words) < MIN_TOKENS:
                    continue
                if len(numbers) > 1_000_000:
                    numbers.clear()
                for w in set(words).difference(numbers):
                    numbers[w] = int.from_bytes(_digest(w), "little")
                h = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
                s = h[: len(h) - SHINGLE + 1].copy()
                for i in range(1, SHINGLE):
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i]
                s ^= s >> np.uint64(29)
                u, n = np.unique(((s * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32).view(np.int32), return_counts=True)
                ids.append(key)
                forms.append(_digest("\n".join(words), 16).hex())
                out.append(u)
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(forms, pa.string()), _lists(out, pa.int32()), _lists(counts, pa.int32())], names=["id", "form", "shingles", "tf"])

    return records.mapInArrow(sets, f"id {dict(records.dtypes)['id']}, form string, shingles array<int>, tf array<int>")


def _digest(text: str, size: int = 8) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def document_frequencies(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How many records hold a shingle of each bucket, and how many records there are. Each task counts its records in a
    table of DF_BUCKETS numbers and sends those that aren't 0; they are added up by bucket, combined before and behind the
    shuffle, so no task holds more than its share of the buckets. The driver receives DF_BUCKETS numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_BUCKETS + 1, np.int64)  # the last counts records
        for b in batches:
            total[:-1] += np.bincount(b.column(0).flatten().to_numpy().view(np.uint32) % DF_BUCKETS, minlength=DF_BUCKETS)
            total[-1] += len(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DF_BUCKETS + 1)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / np.maximum(df, 1.0)).astype(np.float32)


def draws(seed: int, size: int = 1 << 16) -> tuple[np.ndarray, ...]:
    """The sampler's random numbers: 1/r, beta, ln c + r*beta - r, and r, with r and c from Gamma(2, 1) and beta
    uniform. A shingle picks its own row of the table anew for every sample, by a hash."""
    g = np.random.default_rng(seed)
    r, c, beta = g.gamma(2.0, 1.0, size), g.gamma(2.0, 1.0, size), g.random(size)
    return tuple(x.astype(np.float32) for x in (1 / r, beta, np.log(c) + r * beta - r, r))


def samples(shingles: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, k: int, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """k samples of each record: of its shingles the least ln a = ln c - r (t - beta) - r with t = floor(ln w / r +
    beta), as the bits of that number, which name the shingle and t. Records lie one after another from `starts`."""
    inverse, beta, base, r = table
    out = np.empty((len(starts), k), np.int32)
    h = shingles.view(np.uint32).astype(np.uint64)
    g = np.random.default_rng(7)
    for j in range(k):
        a, b = (int(x) | 1 for x in g.integers(1 << 62, size=2))
        at = ((h * np.uint64(a) + np.uint64(b)) >> np.uint64(48)).astype(np.int64)
        t = np.floor(log_weight * inverse[at] + beta[at])
        out[:, j] = np.minimum.reduceat(base[at] - r[at] * t, starts).view(np.int32)
    return out


def band_keys(sets: DataFrame, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, id, n): each record's bands. `idf` has DF_BUCKETS entries and goes to every task."""
    shared = sets.sparkSession.sparkContext.broadcast(idf)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = draws(11), shared.value
        mix = np.random.default_rng(13).integers(1 << 62, size=(bands, rows)).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            for at in range(0, len(batch), 256):  # blocks that stay in the processor's cache
                b = batch.slice(at, 256)
                lists = b.column(1)
                size = np.diff(lists.offsets.to_numpy())
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                s = lists.flatten().to_numpy()
                tf = b.column(2).flatten().to_numpy()
                w = np.log(weights[s.view(np.uint32) % DF_BUCKETS] * (1 + np.log(tf.astype(np.float32))))
                m = samples(s, w, starts, bands * rows, table).view(np.uint32).astype(np.uint64).reshape(-1, bands, rows)
                key = (m * mix).sum(2) ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), bands))), pa.array(np.repeat(size, bands).astype(np.int32))],
                    names=["key", "id", "n"],
                )

    return sets.select("id", "shingles", "tf").mapInArrow(keys, f"key long, id {dict(sets.dtypes)['id']}, n int")


def candidate_pairs(bands: DataFrame, similarity: float = SIMILARITY, agree: int = AGREE) -> DataFrame:
    """(a, b), a < b: records that share at least `agree` bands and whose sizes allow the similarity."""
    sizes = stored(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    sizes = broadcast_small(sizes)
    x = bands.join(sizes, "key").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    x = x.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = x.select("key", F.col("tile").alias("i"), other.alias("j"), F.col("id").alias("a"), F.col("n").alias("na"))
    right = x.select("key", other.alias("i"), F.col("tile").alias("j"), F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb"))
    pairs = left.join(right, ["key", "i", "j"]).filter(fits)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= agree).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b, jaccard, weighted): the pairs whose share of common distinct shingles reaches `similarity`."""
    shared = sets.sparkSession.sparkContext.broadcast(idf)
    pairs = stored(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = stored(ids, "candidate-ids")
    few = stored(sets.join(broadcast_small(ids), "id", "left_semi"), "candidate-sets")
    a, b = (few.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}"), F.col("tf").alias(f"t{s}")) for s in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            jaccard, weighted = [], []
            for i in range(len(batch)):
                x, y = (col[f"s{s}"][i].values.to_numpy() for s in "ab")
                both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                jaccard.append(len(both) / (len(x) + len(y) - len(both)))
                wx, wy = (idf[v.view(np.uint32) % DF_BUCKETS] * (1 + np.log(col[f"t{s}"][i].values.to_numpy().astype(np.float32))) for s, v in zip("ab", (x, y)))
                low = np.minimum(wx[ix], wy[iy]).sum()
                weighted.append(float(low / (wx.sum() + wy.sum() - low)))
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(jaccard, pa.float64()), pa.array(weighted, pa.float64())], names=["id_a", "id_b", "jaccard", "weighted"])

    kind = dict(sets.dtypes)["id"]
    x = pairs.join(a, "a").join(b, "b").mapInArrow(compare, f"id_a {kind}, id_b {kind}, jaccard double, weighted double")
    return x.filter(F.col("jaccard") >= similarity)


def near_duplicates(components: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the classes of copies: (id_a, id_b, jaccard, weighted) between the first records
    of classes, and (id, class_id, n_documents) with each record's class."""
    sets = stored(shingle_sets(functions_once(components)), "sets")
    copies = groups_of_forms(sets.select("id", F.col("form").alias("key"), F.col("id").alias("form")), "id")
    idf = idf_table(*document_frequencies(sets))
    # Only the first record of a class is sampled and compared.
    others = stored(copies.filter("id <> class_id").select("id"), "copies")
    first = sets.join(broadcast_small(others), "id", "left_anti")
    bands = stored(band_keys(first, idf), "bands")
    return stored(verified(candidate_pairs(bands, similarity), sets, idf, similarity), "links"), copies


def pairs_of_records(links: DataFrame, copies: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, over all records: all pairs within each class of copies, and for each link all pairs
    between its two classes, whatever their sizes, tile by tile."""
    member = copies.filter("n_documents > 1").select("id", "class_id", "n_documents")
    inside = pairs_of_key(member, "class_id", "id", "n_documents").toDF("id_a", "id_b")
    across = pairs_of_members(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), member, "class_id", "id")
    return inside.unionByName(across).distinct()


def linked_classes(links: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per record: id, class_id (the first of its copies), n_copies (records of that class), component_id (the
    least id it is linked to, directly or not) and n_links: how many records it is paired with, which are its copies and
    the members of all classes linked with its own.

    Labels move to the least neighbour's label and on to that label's own until nothing changes: labels only fall, so the
    rounds end. Each is a join and an aggregate, written to the shared folder. With `links`, the rows give back every pair
    of `pairs_of_records`: two records are paired if their classes are the same or linked."""
    edges = stored(links.select("id_a", "id_b").union(links.select("id_b", "id_a")).toDF("x", "y"), "edges")
    label = stored(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("l")), "labels")
    changed = 1
    while changed:
        seen = edges.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        step = label.join(seen, "x").select("x", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = label.select(F.col("x").alias("l"), F.col("l").alias("ll"))
        step = step.join(jump, "l", "left").select("x", F.least("l", F.coalesce("ll", "l")).alias("l"), "was")
        step = stored(step, "labels")
        changed = step.filter("l <> was").limit(1).count()
        label = step.select("x", "l")
    sizes = copies.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    reached = edges.join(sizes.withColumnRenamed("class_id", "y"), "y").groupBy("x").agg(F.sum("n_copies").alias("near"))
    near = reached.join(label, "x").select(F.col("x").alias("class_id"), "l", "near")
    classes = sizes.join(near, "class_id", "left").select(
        "class_id", "n_copies", F.coalesce("l", "class_id").alias("component_id"), (F.col("n_copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")
    )
    classes = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = copies.select("id", "class_id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt"))
    return x.join(classes, ["class_id", "_salt"]).select("id", "class_id", "n_copies", "component_id", "n_links")


def classes_of_copies(components: DataFrame) -> DataFrame:
    """(id, class_id, n_copies): the records with the same tokens, named by the first of them."""
    sets = shingle_sets(functions_once(components))
    groups = groups_of_forms(stored(sets.select("id", F.col("form").alias("key"), F.col("id").alias("form")), "forms"), "id")
    return groups.select("id", "class_id", F.col("n_documents").alias("n_copies"))
