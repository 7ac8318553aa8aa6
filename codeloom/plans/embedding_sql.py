"""The hashing embedder of codeloom.functions.embedding in SQL, for the queries that search texts."""


def embedded(name: str, source: str) -> str:
    """CTEs that end in `name`(id, dim, x, norm) for the rows (id, text) of `source`: whole-number sums by dimension."""
    return f"""
{name}_w AS (SELECT id, lower(unnest(regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'))) AS w FROM {source}),
{name}_p AS (SELECT w, unnest(list_concat([[w, '10']], list_transform(range(1, len(w) - 1), lambda i: ['#' || substr(w, i, 3), '3']))) AS p FROM (SELECT DISTINCT w FROM {name}_w)),
{name}_h AS (SELECT w, ('0x' || substr(md5(p[1]), 1, 8))::BIGINT AS h, p[2]::BIGINT AS n FROM {name}_p),
{name}_d AS (SELECT w, h % 128 AS dim, sum(CASE WHEN h >= 2147483648 THEN n ELSE -n END)::BIGINT AS n FROM {name}_h GROUP BY ALL),
{name}_s AS (SELECT id, dim, sum(n)::BIGINT AS x FROM {name}_w JOIN {name}_d USING (w) GROUP BY ALL),
{name} AS (SELECT id, dim, x, sqrt(sum(x * x) OVER (PARTITION BY id))::DOUBLE AS norm FROM {name}_s)"""


def distances(name: str, left: str, right: str, ids: str) -> str:
    """A CTE `name`(query_id, id, distance): every row of `ids`(id) against every query of `left`, by the vectors of both."""
    return f"""
{name}_dot AS (SELECT l.id AS query_id, r.id AS id, sum(l.x * r.x)::DOUBLE / max(l.norm) / max(r.norm) AS dot FROM {left} l JOIN {right} r USING (dim) GROUP BY ALL),
{name} AS (SELECT q.id AS query_id, i.id AS id, CASE WHEN e.id IS NULL THEN 1.0 ELSE sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))) END AS distance
FROM (SELECT DISTINCT id FROM {left}) q, {ids} i LEFT JOIN (SELECT DISTINCT id FROM {right} WHERE norm > 0) e ON e.id = i.id LEFT JOIN {name}_dot t ON t.query_id = q.id AND t.id = i.id)"""
