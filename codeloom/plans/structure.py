"""Queries on folders and the call graph."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import structure as T
from codeloom.plans.stats import _now

NOW = "2024-06-01 00:00:00"


def _c(spark, d):
    return table(spark, d, "components")


def _targets(spark, d):
    """The components that other files refer to: every exported function and every method."""
    return _c(spark, d).filter("(type = 'function' and exported) or type = 'method'").select("id", "name").distinct()


def dir_rollup(spark, d):
    return T.directory_rollup(_c(spark, d))


def dir_focus(spark, d):
    return T.directory_rollup(_c(spark, d), "packages")


def dir_prune(spark, d):
    return T.prune_to_depth(T.directory_rollup(_c(spark, d)), 2).select("path", "components")


def dir_smart_prune(spark, d):
    return T.smart_prune(T.directory_rollup(_c(spark, d)), 4, 40).select("path", "depth", "components")


def dir_exports(spark, d):
    return T.directory_exports(_c(spark, d))


def area_activity(spark, d):
    return T.directory_activity(_now(spark, d), F.to_timestamp(F.lit(NOW)))


def hot_paths(spark, d):
    return T.hot_paths(_c(spark, d), 10)


def call_edges(spark, d):
    return T.call_edges(_c(spark, d))


def callers(spark, d):
    return T.callers(T.call_edges(_c(spark, d)), _targets(spark, d))


def callees(spark, d):
    return T.callees(_c(spark, d), _targets(spark, d))


def tree_order(spark, d):
    return T.ordered_tree(T.directory_rollup(_c(spark, d)))


def codebase_map(spark, d):
    """The folders to a depth, pruned, with the activity of what lies under them."""
    nodes = T.smart_prune(T.directory_rollup(_c(spark, d)), 4, 40)
    return T.with_activity(nodes, area_activity(spark, d)).select("path", "components", "changed_30d", "changed_90d", "last_change")


def commit_activity(spark, d):
    """Commits that name a file, per folder, newest hundred in 90 days."""
    c = table(spark, d, "documents").filter("kind = 'commit'").select(F.col("doc_id").alias("commit"), F.col("file").alias("path"), F.col("created_at").alias("ts")).distinct()
    return T.commit_activity(c, F.to_timestamp(F.lit("2025-06-01 00:00:00")))


def import_counts(spark, d):
    return T.import_counts(_c(spark, d))


_F = (dir_rollup, dir_focus, dir_prune, dir_smart_prune, dir_exports, area_activity, hot_paths, call_edges, callers, callees, tree_order, codebase_map, commit_activity, import_counts)
QUERIES = {f.__name__: f for f in _F}
_CTE = r"""
WITH c AS (SELECT DISTINCT ON (id) * FROM components),
pf AS (SELECT file, count(*) AS n, regexp_replace(regexp_extract(file, '^(.*/)?[^/]*$', 1), '/$', '') AS dir, string_split(file, '/') AS p FROM c WHERE file IS NOT NULL GROUP BY file),
up AS (SELECT *, unnest(list_transform(range(0, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS path FROM pf),
nodes AS (SELECT path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END::INT AS depth, sum(n)::BIGINT AS components, coalesce(sum(n) FILTER (dir = path), 0)::BIGINT AS own_components, count(*) AS files FROM up GROUP BY path),
e AS (SELECT id AS caller_id, file AS caller_file, name AS caller_name, u.name AS callee_name, u.file AS callee_file, u.line AS line FROM (SELECT id, file, name, unnest(callees) AS u FROM c)),
t AS (SELECT DISTINCT id AS target_id, name AS target FROM components WHERE (type = 'function' AND exported) OR type = 'method')
"""
SQL = {
    "dir_rollup": _CTE + "SELECT * FROM nodes",
    "dir_focus": _CTE + "SELECT * FROM nodes WHERE starts_with(path, 'packages')",
    "dir_prune": _CTE + "SELECT path, components FROM nodes WHERE depth <= 2",
    "dir_smart_prune": _CTE + ", o AS (SELECT path FROM nodes WHERE NOT (depth < 2 OR components >= 40)) SELECT path, depth, components FROM nodes n WHERE depth <= 4 AND NOT EXISTS (SELECT 1 FROM o WHERE n.path <> o.path AND starts_with(n.path, o.path || '/'))",
    "dir_exports": _CTE + """SELECT path, list(name ORDER BY r) AS exports FROM (SELECT regexp_replace(regexp_extract(file, '^(.*/)?[^/]*$', 1), '/$', '') AS path, name,
row_number() OVER (PARTITION BY regexp_replace(regexp_extract(file, '^(.*/)?[^/]*$', 1), '/$', '') ORDER BY file, start_line, id) AS r FROM c WHERE exported AND name IS NOT NULL AND file IS NOT NULL) WHERE r <= 5 GROUP BY path""",
    "tree_order": _CTE + "SELECT path, parent, row_number() OVER (PARTITION BY parent ORDER BY lower(name), name)::INT AS position FROM (SELECT path, array_to_string(string_split(path, '/')[:-2], '/') AS parent, string_split(path, '/')[-1] AS name FROM nodes WHERE path <> '')",
    "commit_activity": """WITH k AS (SELECT DISTINCT doc_id, file, created_at FROM documents WHERE kind = 'commit' AND file IS NOT NULL AND created_at BETWEEN TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 90 DAY AND TIMESTAMPTZ '2025-06-01 00:00:00+00'),
u AS (SELECT *, unnest(list_transform(range(0, len(string_split(file, '/'))), lambda i: array_to_string(string_split(file, '/')[1:i], '/'))) AS path FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY created_at DESC, doc_id) AS r FROM u)
SELECT path, count(*) FILTER (created_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 30 DAY) AS changed_30d, count(*) AS changed_90d, max(created_at) AS last_change FROM r WHERE r <= 100 GROUP BY path""",
    "area_activity": r"""WITH s AS (SELECT DISTINCT * FROM snapshots), l AS (SELECT max_by(id, (ts, id)) AS id FROM s GROUP BY repository_path),
m AS (SELECT DISTINCT ON (snapshot_id, file_path) * FROM (SELECT snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, coalesce(commit_count, 0) AS commit_count, last_modified FROM code_metadata) WHERE snapshot_id IN (SELECT id FROM l)),
u AS (SELECT *, unnest(list_transform(range(0, len(string_split(file_path, '/'))), lambda k: array_to_string(string_split(file_path, '/')[1:k], '/'))) AS path FROM m),
g AS (SELECT path, count(*) FILTER (last_modified >= TIMESTAMPTZ '"""
    + NOW
    + "+00' - INTERVAL 30 DAY) AS changed_30d, count(*) FILTER (last_modified >= TIMESTAMPTZ '"
    + NOW
    + """+00' - INTERVAL 90 DAY) AS changed_90d, sum(commit_count)::BIGINT AS commits, max(last_modified) AS last_change FROM u GROUP BY path)
SELECT *, CASE WHEN changed_30d >= 5 THEN 'hot' WHEN changed_30d >= 1 THEN 'active' WHEN changed_90d >= 1 THEN 'recent' ELSE 'quiet' END AS class FROM g""",
    "hot_paths": _CTE + ", n AS (SELECT callee_file AS file, count(*) AS refs FROM e WHERE callee_file IS NOT NULL GROUP BY 1 ORDER BY refs DESC, file LIMIT 10), f AS (SELECT file, arg_min(name, (start_line, id)) AS component FROM c GROUP BY file) SELECT n.*, component FROM n LEFT JOIN f USING (file)",
    "call_edges": _CTE + "SELECT * FROM e",
    "callers": _CTE + "SELECT target_id, target, caller_id, min(line) AS line FROM e JOIN t ON string_split(callee_name, '.')[-1] = string_split(target, '.')[-1] AND (callee_name = target OR ends_with(callee_name, '.' || target) OR ends_with(target, '.' || callee_name)) WHERE caller_id <> target_id GROUP BY ALL",
    "callees": _CTE + """, b AS (SELECT target AS wanted, arg_min({'id': id, 'k': callees}, (name <> target, id)) AS b FROM c JOIN t ON string_split(name, '.')[-1] = string_split(target, '.')[-1] AND (name = target OR ends_with(name, '.' || target)) GROUP BY target),
x AS (SELECT wanted, b.id AS id, unnest(range(0, least(len(b.k), 20))) AS position, b.k AS k FROM b)
SELECT wanted, id, position::INT AS position, k[position + 1].name AS callee_name, k[position + 1].file AS callee_file, k[position + 1].line AS line FROM x""",
    "import_counts": _CTE + "SELECT module, count(DISTINCT file) AS files FROM (SELECT file, unnest(imports) AS module FROM c) WHERE NOT starts_with(module, '.') GROUP BY module",
}
SQL["codebase_map"] = (
    f"SELECT n.path, n.components, coalesce(a.changed_30d, 0) AS changed_30d, coalesce(a.changed_90d, 0) AS changed_90d, a.last_change FROM ({SQL['dir_smart_prune']}) n LEFT JOIN ({SQL['area_activity']}) a USING (path)"
)
