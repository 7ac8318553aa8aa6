"""Vector search queries."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import search as S
from codeloom.operators import vectors as V
from codeloom.plans.embedding_sql import distances, embedded

REF = 7


def vector_topk(spark, d):
    x = V.top_k_by_id(table(spark, d, "embeddings"), REF, 10)
    return x.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def _v(spark, d):
    return table(spark, d, "embeddings")


def _shown(x):
    return x.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def vector_topk_threshold(spark, d):
    return _shown(V.top_k_by_id(_v(spark, d), REF, 50, 0.2))


def vector_query(spark, d):
    """Nearest to a vector given by value: the mean of one label's vectors."""
    mean = _v(spark, d).filter("label = 3").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.round(F.col("x").cast("double"), 6)).alias("x")).orderBy("i")
    return _shown(V.top_k(_v(spark, d), [round(r.x, 9) for r in mean.collect()], 10))


def similar_by_id_exclude_group(spark, d):
    return _shown(V.similar_outside_group(_v(spark, d), REF, "label", 10))


def topk_per_query(spark, d):
    v = _v(spark, d)
    x = V.top_k_per_query(v, v.filter("vec_id % 100 = 0"), 3)
    return x.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def vectors_by_label(spark, d):
    v = _v(spark, d)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 5).alias("mean_square"))


def all_vectors(spark, d):
    return V.all_rows(_v(spark, d)).select("vec_id", "label", "score")


def _delta(v):
    """An update: a quarter of the rows come with another label, and as many are new."""
    part = v.filter("vec_id % 4 = 0")
    return part.withColumn("label", F.col("label") + 100).unionByName(part.withColumn("vec_id", F.col("vec_id") + 1_000_000))


def vectors_upsert(spark, d):
    v = _v(spark, d)
    return V.upsert(v, _delta(v), "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def vectors_delete(spark, d):
    v = _v(spark, d)
    return V.delete(v, v.filter("label < 3").select("vec_id"), "vec_id").select("vec_id", "label")


def _components(spark, d):
    return S.vector_table(table(spark, d, "components"))


def text_search(spark, d):
    return S.search(_components(spark, d), "parse the socket cache of a worker", 10).select("id", F.round("score", 4).alias("score"))


def similar_by_path(spark, d):
    """Components like the path of a file, its own left out: the first path of the table is looked up."""
    c = _components(spark, d)
    path = table(spark, d, "components").agg(F.min("file").alias("p")).first().p
    return S.similar_to_path(c, path, 20, 0.1).select("id", F.round("score", 4).alias("score"))


def symbol_search(spark, d):
    return S.find_symbol(_components(spark, d), "mapTable").select("id", "name")


def test_search(spark, d):
    return S.related_test_components(_components(spark, d), "cache snapshot").select("file")


_F = (vector_topk, vector_topk_threshold, vector_query, similar_by_id_exclude_group, topk_per_query, all_vectors, vectors_by_label, vectors_upsert, vectors_delete, text_search, symbol_search, test_search, similar_by_path)
QUERIES = {f.__name__: f for f in _F}
_TEXTS = "WITH c AS (SELECT DISTINCT ON (id) * FROM components), t AS (SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN coalesce(name, '') <> '' THEN concat_ws(': ', type, name) END, nullif(text, '')) AS text FROM c), "


def _searched(queries: str) -> str:
    """CTEs down to `hit`(query_id, id, distance) of all components for the queries given as VALUES (id, text)."""
    return _TEXTS + f"qs AS (SELECT * FROM (VALUES {queries}) v(id, text)), " + embedded("qe", "qs") + "," + embedded("ce", "t") + "," + distances("hit", "qe", "ce", "t")


_CTE = f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v, label AS g FROM embeddings WHERE vec_id = {REF}),
x AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], q.v) AS dist FROM embeddings, q),
s AS (SELECT vec_id, label, dist, exp(-dist*dist) AS sc FROM x)
"""
_OUT = "SELECT vec_id, label, round(dist, 6) AS distance, round(sc, 6) AS score FROM "
SQL = {
    "vector_topk": _CTE + _OUT + "s ORDER BY dist, vec_id LIMIT 10",
    "vector_topk_threshold": _CTE + _OUT + "(SELECT * FROM s ORDER BY dist, vec_id LIMIT 50) WHERE sc >= 0.2",
    "vector_query": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT unnest(range(1, len(v) + 1)) AS i, round(unnest(v), 6) AS x FROM e WHERE label = 3),
m AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, round(avg(x), 9) AS x FROM u GROUP BY i)), s AS (SELECT vec_id, label, list_distance(e.v, m.v) AS dist FROM e, m)
SELECT vec_id, label, round(dist, 6) AS distance, round(exp(-dist*dist), 6) AS score FROM s ORDER BY dist, vec_id LIMIT 10""",
    "similar_by_id_exclude_group": _CTE + ", n AS (SELECT 10 + count(*) AS k FROM embeddings, q WHERE label = q.g), r AS (SELECT *, row_number() OVER (ORDER BY dist, vec_id) AS rn FROM s) " + _OUT + "r, n, q WHERE rn <= n.k AND label <> q.g",
    "topk_per_query": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, round(dist, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id)::INT AS rank FROM p) WHERE rank <= 3""",
    "all_vectors": "SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10000",
    "vectors_by_label": "SELECT label, count(*) AS n, round(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS mean_square FROM embeddings GROUP BY label",
    "vectors_upsert": "SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 4 = 0) GROUP BY label",
    "text_search": _searched("('q', 'parse the socket cache of a worker')") + " SELECT id, round(exp(-distance * distance), 4) AS score FROM hit ORDER BY distance, id LIMIT 10",
    "symbol_search": _searched("('q', 'mapTable')") + """, h AS (SELECT c.id, name, file, signature, distance FROM hit JOIN c ON c.id = hit.id ORDER BY distance, c.id LIMIT 10)
SELECT id, name FROM h ORDER BY CASE WHEN name = 'mapTable' THEN 0 WHEN contains(file, 'mapTable') OR contains(signature, 'mapTable') THEN 1 ELSE 2 END, distance, id LIMIT 1""",
    "test_search": _searched("(0, 'test cache snapshot'), (1, 'cache snapshot test'), (2, 'cache snapshot spec'), (3, 'describe cache snapshot')") + """
SELECT DISTINCT file FROM (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY distance, c.id) AS r FROM hit JOIN c ON c.id = hit.id WHERE contains(file, '.test.') OR contains(file, '.spec.')) WHERE r <= 5""",
    "similar_by_path": _TEXTS + "qs AS (SELECT 'q' AS id, min(file) AS text FROM components), " + embedded("qe", "qs") + "," + embedded("ce", "t") + "," + distances("hit", "qe", "ce", "t") + """
SELECT c.id AS id, round(exp(-distance * distance), 4) AS score FROM (SELECT * FROM hit ORDER BY distance, id LIMIT 21) h JOIN c ON c.id = h.id WHERE exp(-distance * distance) >= 0.1 AND c.file <> (SELECT text FROM qs) ORDER BY distance, c.id LIMIT 20""",
    "vectors_delete": "SELECT vec_id, label FROM embeddings WHERE NOT label < 3",
}
