"""Problem 3: changes between full deliveries."""

from codeloom.io import table
from codeloom.operators import snapshot_changes as S


def _tables(spark, d):
    return table(spark, d, "snapshots"), table(spark, d, "code_metadata")


def p3_found(spark, d):
    return S.change_events(*_tables(spark, d)).select("snapshot_id", "file_path", "change_kind")


def p3_counts(spark, d):
    return S.change_counts(*_tables(spark, d)).select("snapshot_id", "n_added", "n_removed", "n_changed", "total_files")


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}

# By comparing each delivery with the one before it, a plainer way than the operator's.
_EVENTS = r"""
WITH s AS (SELECT DISTINCT id, repository_path, ts, total_files FROM snapshots),
m AS (
  SELECT DISTINCT snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS p,
         coalesce(commit_count, 0) AS c, coalesce(author_count, 0) AS a, last_modified AS t, lines_of_code AS l, num_functions AS f, num_imports AS i
  FROM code_metadata WHERE file_path IS NOT NULL
),
d AS (
  SELECT id, repository_path, total_files, row_number() OVER (PARTITION BY repository_path ORDER BY ts, id) AS seq FROM s
  WHERE coalesce(total_files, 0) <= 0 OR id IN (SELECT snapshot_id FROM m)
),
pair AS (SELECT b.id AS now_id, a.id AS then_id FROM d a JOIN d b ON a.repository_path = b.repository_path AND b.seq = a.seq + 1),
n AS (SELECT pair.now_id, m.* FROM pair JOIN m ON m.snapshot_id = pair.now_id),
o AS (SELECT pair.now_id, m.* FROM pair JOIN m ON m.snapshot_id = pair.then_id),
e AS (
  SELECT coalesce(n.now_id, o.now_id) AS snapshot_id, coalesce(n.p, o.p) AS file_path,
    CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed'
         WHEN (n.c, n.a) <> (o.c, o.a) OR n.t IS DISTINCT FROM o.t OR n.l IS DISTINCT FROM o.l OR n.f IS DISTINCT FROM o.f OR n.i IS DISTINCT FROM o.i THEN 'changed' END AS change_kind
  FROM n FULL JOIN o ON n.now_id = o.now_id AND n.p = o.p
)
"""
SQL = {
    "p3_found": _EVENTS + "SELECT DISTINCT snapshot_id, file_path, change_kind FROM e WHERE change_kind IS NOT NULL",
    "p3_counts": _EVENTS
    + """
SELECT d.id AS snapshot_id, count(*) FILTER (WHERE change_kind = 'added') AS n_added, count(*) FILTER (WHERE change_kind = 'removed') AS n_removed,
       count(*) FILTER (WHERE change_kind = 'changed') AS n_changed, max(d.total_files) AS total_files
FROM d LEFT JOIN (SELECT DISTINCT * FROM e WHERE change_kind IS NOT NULL) e ON e.snapshot_id = d.id WHERE d.seq > 1 GROUP BY d.id""",
}
