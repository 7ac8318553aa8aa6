"""Vector search and the vector table: exact top-k by L2 distance, scores exp(-d^2), upsert and delete.

Null vectors, and vectors of another length than the query's, have no distance and are never returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.io import running_total


def l2_distance(a: Column, b: Column) -> Column:
    """Accumulated in double; null where a side is null or the lengths differ."""
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def score(distance: Column) -> Column:
    """exp(-d^2); a missing distance counts as 0, as in the search it stands for."""
    d = F.coalesce(distance, F.lit(0.0))
    return F.exp(-(d * d))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows. The threshold applies after the cut, as the contract has it: fewer than k rows may remain."""
    q = F.array(*[F.lit(float(x)) for x in query])
    x = vectors.withColumn("distance", l2_distance(F.col(vec_col), q)).filter("distance is not null")
    x = x.orderBy("distance", id_col).limit(k).withColumn("score", score(F.col("distance")))
    return x if threshold is None else x.filter(F.col("score") >= threshold)


def top_k_by_id(vectors: DataFrame, ref_id: int, k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows to a stored one, itself included; an unknown id gives no rows. One row is looked up and
    broadcast."""
    ref = vectors.filter(F.col(id_col) == ref_id).select(F.col(vec_col).alias("_q")).limit(1)
    x = vectors.join(F.broadcast(ref), how="cross")
    x = x.withColumn("distance", l2_distance(F.col(vec_col), F.col("_q"))).filter("distance is not null").drop("_q")
    x = x.orderBy("distance", id_col).limit(k).withColumn("score", score(F.col("distance")))
    return x if threshold is None else x.filter(F.col("score") >= threshold)


def similar_outside_group(vectors: DataFrame, ref_id: int, group_col: str, k: int = 10, threshold: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows similar to a stored one from other groups (files): of the k plus own-group-size nearest those of its own group
    are dropped, the rest isn't cut again. Places in that order are counted range by range, so a large group isn't sorted
    in one task."""
    ref = vectors.filter(F.col(id_col) == ref_id).select(F.col(vec_col).alias("_q"), F.col(group_col).alias("_g")).limit(1)
    x = vectors.join(F.broadcast(ref), how="cross")
    own = F.col(group_col).eqNullSafe(F.col("_g"))
    x = x.withColumn("distance", l2_distance(F.col(vec_col), F.col("_q"))).filter("distance is not null").withColumn("_own", own).drop("_q", "_g", vec_col)
    x = running_total(x.withColumn("_one", F.lit(1)), [], ["distance", id_col], "_one")
    fetch = k + vectors.join(F.broadcast(ref.select("_g")), vectors[group_col].eqNullSafe(F.col("_g")), "left_semi").count()
    x = x.filter((F.col("upto") <= fetch) & ~F.col("_own")).withColumn("score", score(F.col("distance")))
    return x.filter(F.col("score") >= threshold).drop("_own", "_one", "upto", "total")


#: Queries, and rows, that are compared at once: the size of a matrix in a task.
QUERY_BLOCK, ROW_TILE = 4096, 4096


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows for each row of `queries` (a stated query set, in the same
    columns), itself excluded. Each batch of rows keeps its k nearest per query in the task, so pairs are never written
    out, and only k rows a query and batch are shuffled. Rows whose vector is null or of another length than the queries'
    are left out.

    Queries that fit one block go to every task. More are blocks in a table of their own: they meet the rows, packed into
    tiles, by an equi-join on lanes, so neither the driver nor a task holds the query set."""
    q = queries.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).dropDuplicates([id_col])
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    kind = dict(vectors.dtypes)[id_col]
    schema = f"query_id {kind}, {id_col} {kind}, distance double"
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    if blocks == 1:
        own = q.collect()  # at most QUERY_BLOCK rows
        if not own:
            return vectors.select(F.col(id_col).alias("query_id"), id_col, F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
        found = rows.mapInArrow(_nearest([r[0] for r in own], np.array([r[1] for r in own], np.float64), k), schema)
    else:
        lanes = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dim = F.size(vec_col)
        pack = lambda df: df.groupBy("_p", "_dim").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))).alias("m"))
        tiles = max(1, -(-rows.count() // ROW_TILE))
        b = pack(q.withColumn("_p", F.pmod(F.xxhash64(id_col), F.lit(blocks))).withColumn("_dim", dim))
        t = pack(rows.withColumn("_p", F.pmod(F.xxhash64(id_col), F.lit(tiles))).withColumn("_dim", dim))
        b = b.select("_dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("m").alias("q"))
        t = t.select("_dim", F.pmod("_p", F.lit(lanes)).cast("int").alias("lane"), F.col("m").alias("r"))
        found = t.join(b, ["lane", "_dim"]).select("q", "r").mapInArrow(_nearest_of_tiles(k, id_col), schema)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _kept(ids: list, matrix: np.ndarray, squares: np.ndarray, own: list, m: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query ids, row ids and distances of the k nearest rows of a batch to each query; ties at the edge stay in, so that
    the order by id is that of all rows."""
    d = squares[:, None] + (m**2).sum(1)[None, :] - 2 * matrix @ m.T
    most = min(k + 1, d.shape[1])
    edge = (np.partition(d, most - 1, axis=1)[:, most - 1] if most < d.shape[1] else d.max(1)) + 1e-9
    out: tuple[list, list, list] = ([], [], [])
    for i, j in zip(*np.nonzero(d <= edge[:, None])):
        if own[j] != ids[i]:
            out[0].append(ids[i]), out[1].append(own[j]), out[2].append(float(np.sqrt(((matrix[i] - m[j]) ** 2).sum())))
    return out


def _batch(rows: tuple[list, list, list], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], kind), pa.array(rows[1], kind), pa.array(rows[2], pa.float64())], names=["query_id", id_col, "distance"])


def _nearest(ids: list, matrix: np.ndarray, k: int):
    squares = (matrix**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            keep = [j for j, n in enumerate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()) if n == matrix.shape[1]]
            if not keep:
                continue
            own = b.column(0).take(pa.array(keep)).to_pylist()
            m = lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), -1)
            yield _batch(_kept(ids, matrix, squares, own, m, k), b.schema.field(0).type, b.schema.names[0])

    return run


def _nearest_of_tiles(k: int, id_col: str):
    def side(column: pa.Array, i: int) -> tuple[list, np.ndarray]:
        rows = column[i].values
        ids, lists = rows.field("id").to_pylist(), rows.field("v")
        return ids, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                (ids, matrix), (own, m) = side(b.column(0), i), side(b.column(1), i)
                yield _batch(_kept(ids, matrix, (matrix**2).sum(1), own, m, k), b.column(0).type.value_type.field("id").type, id_col)

    return run


def all_rows(vectors: DataFrame, limit: int = 10_000, id_col: str = "vec_id") -> DataFrame:
    """The first rows by id without a search, each with the score 1; the limit is the contract's."""
    return vectors.orderBy(id_col).limit(limit).withColumn("score", F.lit(1.0))


def upsert(table: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The table with the rows of delta put in: all columns replaced where the key exists, else inserted. Of several
    delta rows for a key the last in column order stays; null keys are inserted, never matched."""
    cols = table.columns
    one = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in cols if c != key and dict(table.dtypes)[c] not in ("map",)])
    d = delta.select(*cols).withColumn("_r", F.when(F.col(key).isNull(), 1).otherwise(F.row_number().over(one))).filter("_r = 1").drop("_r")
    return table.join(d.select(key), key, "left_anti").select(*cols).unionByName(d)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti").select(*table.columns)
