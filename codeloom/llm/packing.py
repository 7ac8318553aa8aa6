"""Problem 7: filling fixed-capacity containers with items.

Method: cost-balanced packing. Each text's cost is estimated as linear plus quadratic (attention) in its tokens; texts
are taken in descending order and given to the lowest-cost sequence with remaining token capacity; where none has room a
sequence is added. Texts longer than the capacity are cut at it; whole parts fill a container each, the rest is packed.

The collection is spread over shards of a bounded number of tokens by a hash of the id, each packed by one task, so no
task grows with the collection. Each shard leaves at most about one sequence partly empty, a small share of the tokens
of a shard. The tokenizer's file is a parameter that Spark ships to the executors; it is read once by each task. Without
one, each task takes the file of the tokenizers that are installed where it runs.

Defined results: null and empty texts have no tokens and come out in no container; rows delivered twice count once; ties
in length go by id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.io import spread

CAPACITY = 2048
#: Tokens of a shard, in containers.
SHARD_CONTAINERS = 256
#: Cost of a text of n tokens: LINEAR * n + QUADRATIC * n^2, in units of one token's linear work.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens): tokens of the whole text by a byte-level BPE given as a rank file."""
    if tokenizer:
        docs.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer and tokenizer.rstrip("/").rpartition("/")[2]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name) if name else default_tokenizer(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": np.array([len(encode(t)) for t in b["text"]], np.int64)})

    x = spread(docs.filter(F.col(key).isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select(key, "text"))
    counted = x.mapInPandas(count, f"{key} {dict(docs.dtypes)[key]}, n_tokens long")
    return counted.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))


def parts(counted: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, part, start, n_tokens): a text that fits is one part; a longer one is cut at every `capacity` tokens."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    x = counted.filter("n_tokens > 0").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("part").cast("long") * capacity
    return x.select(key, "part", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(tokens: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each text; `tokens` descend. Each goes to the lowest-cost sequence with room for it."""
    n = tokens.astype(np.int64)
    cost = linear * n + quadratic * n.astype(float) ** 2
    many = max(1, -(-int(n.sum()) // capacity))
    size = 2 * many + 8
    room = np.zeros(size, np.int64)
    room[:many] = capacity
    spent = np.zeros(size)
    out = np.empty(len(n), np.int64)
    for i, (t, c) in enumerate(zip(n.tolist(), cost.tolist())):
        fits = np.flatnonzero(room[:many] >= t)
        if len(fits):
            j = fits[np.argmin(spent[fits])]
        else:
            if many == len(room):
                room, spent = np.concatenate([room, np.zeros_like(room)]), np.concatenate([spent, np.zeros_like(spent)])
            j, room[many], many = many, capacity, many + 1
        room[j] -= t
        spent[j] += c
        out[i] = j
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS, tokenizer: str | None = None, key: str = "doc_id") -> DataFrame:
    """(container_id, key, part, start, n_tokens, position, cost): every part in its container, in the order packed."""
    from codeloom.io import stored

    counted = stored(token_counts(docs, tokenizer, key), "tokens")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // (capacity * shard_containers)))
    x = parts(counted, capacity, key)
    full = x.filter(F.col("n_tokens") == capacity)
    full = full.select(F.concat_ws(":", F.lit("full"), F.col(key), "part").alias("container_id"), key, "part", "start", "n_tokens", F.lit(0).alias("position"))
    rest = x.filter(F.col("n_tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)))

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_tokens", key, "part"], ascending=[False, True, True], ignore_index=True)
        seq = pack(p["n_tokens"].to_numpy(), capacity)
        p["container_id"] = [f"{s}:{j}" for s, j in zip(p["shard"], seq)]
        p["position"] = p.groupby("container_id").cumcount().astype("int32")
        return p[["container_id", key, "part", "start", "n_tokens", "position"]]

    schema = f"container_id string, {key} {dict(docs.dtypes)[key]}, part int, start long, n_tokens long, position int"
    both = rest.groupBy("shard").applyInPandas(fill, schema).unionByName(full)
    return both.withColumn("cost", F.round(F.col("n_tokens") * LINEAR + F.col("n_tokens") * F.col("n_tokens") * QUADRATIC, 3))


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, the least possible number of containers, spread of cost."""
    c = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.sum("cost").alias("cost"))
    one = c.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_used"), F.stddev("cost").alias("sd"), F.avg("cost").alias("mean"))
    return one.select(
        "n_containers",
        "n_tokens",
        "most_used",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.round(1 - F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("unused_share"),
        F.round(F.col("sd") / F.col("mean"), 6).alias("cost_variation"),
    )


def checked(assigned: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """One row per text: key, whole (its parts follow each other from the start without a gap, and only a text that alone
    exceeds the capacity has more than one) and fits (no container that holds a part of it is filled above the capacity)."""
    used = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    x = assigned.join(used, "container_id")
    rows = F.array_sort(F.collect_list(F.struct("part", "start", "n_tokens"))).alias("p")
    x = x.groupBy(key).agg(rows, F.sum("n_tokens").alias("n"), F.max("used").alias("used"))
    follow = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i).start == F.aggregate(F.slice("p", 1, i - 1), F.lit(0).cast("long"), lambda s, r: s + r.n_tokens))
    return x.select(key, (follow & ((F.size("p") == 1) | (F.col("n") > capacity))).alias("whole"), (F.col("used") <= capacity).alias("fits"))
