"""Queries on snapshots and code metadata."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import metrics as M

HUB = "meridian-hub"
NOW, DAYS = "2023-12-01 00:00:00", 180


def _s(spark, d):
    return table(spark, d, "snapshots")


def _m(spark, d):
    return table(spark, d, "code_metadata")


def _latest_metrics(spark, d):
    last = M.latest(_s(spark, d), "repository_path").select(F.col("id").alias("snapshot_id"))
    return M.file_metrics(_m(spark, d)).join(last, "snapshot_id", "left_semi")


def snapshots_query(spark, d):
    x = M.find_snapshots(_s(spark, d), since=F.to_timestamp(F.lit("2023-01-01")), repository=HUB, trigger="update", limit=50)
    return x.select("id", "ts", "repository", "trigger", "total_files")


def latest_snapshot(spark, d):
    return M.latest(_s(spark, d), "repository_path").select("repository_path", "id", "ts", "total_documents")


def snapshot_by_id(spark, d):
    first = M.once(_s(spark, d), "id").agg(F.min("id").alias("id"))
    return M.once(_s(spark, d), "id").join(F.broadcast(first), "id").select("id", "repository_path", "total_files", "total_vectors")


def file_trend(spark, d):
    x = M.file_trend(_s(spark, d), _m(spark, d), M.busiest_file(_m(spark, d)), 10)
    return x.select("file_path", "snapshot_id", "ts", "commit_count", "lines_of_code", "commit_count_delta", "lines_of_code_delta")


def code_metadata_risky(spark, d):
    x = M.top_files(_latest_metrics(spark, d), "risk_desc", 100, 1000.0)
    return x.select("snapshot_id", "file_path", F.round("risk_score", 4).alias("risk_score"))


def file_metrics(spark, d):
    return M.file_metrics(_m(spark, d)).drop("last_modified").withColumn("risk_score", F.round("risk_score", 4))


def most_active(spark, d):
    return M.top_files(_latest_metrics(spark, d), "commits_desc", 10).select("snapshot_id", "file_path", "commit_count", "activity")


def largest_files(spark, d):
    return M.top_files(_latest_metrics(spark, d), "lines_desc", 10).select("snapshot_id", "file_path", "lines_of_code", "size")


def concentrated_ownership(spark, d):
    return M.concentrated_ownership(_latest_metrics(spark, d), 10).select("snapshot_id", "file_path", "author_count", "ownership")


def snapshot_summary(spark, d):
    return M.snapshot_summary(M.file_metrics(_m(spark, d)))


def metadata_append(spark, d):
    m = M.clean(_m(spark, d))
    old = m.filter(F.length("file_path") % 2 == 0).select("snapshot_id", "file_path", "commit_count", "author_count", "lines_of_code", "num_functions", "num_imports", "risk_score")
    x = M.append_code_metadata(old, m)
    return x.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count("commit_count").alias("with_commits"), F.sum("lines_of_code").alias("loc"))


def prune_old(spark, d):
    s, m = M.prune(M.once(_s(spark, d), "id"), M.clean(_m(spark, d)), F.to_timestamp(F.lit(NOW)), DAYS)
    per = m.groupBy(F.col("snapshot_id").alias("id")).agg(F.count("*").alias("n_files"))
    return s.join(per, "id", "left").select("id", "ts", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def metadata_counts(spark, d):
    return M.clean(_m(spark, d)).groupBy("snapshot_id").agg(F.count("*").alias("n_files"))


_F = (snapshots_query, latest_snapshot, snapshot_by_id, file_trend, code_metadata_risky, file_metrics, most_active, largest_files, concentrated_ownership, snapshot_summary, metadata_append, prune_old, metadata_counts)
QUERIES = {f.__name__: f for f in _F}

_CTE = r"""
WITH s AS (SELECT DISTINCT * FROM snapshots),
mm AS (SELECT DISTINCT ON (snapshot_id, fp) *, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS fp FROM code_metadata),
m AS (SELECT snapshot_id, fp AS file_path, coalesce(commit_count, 0) AS commit_count, coalesce(lines_of_code, 0) AS lines_of_code,
  greatest(coalesce(author_count, 0), 1) AS author_count, coalesce(num_functions, 0) AS num_functions, coalesce(num_imports, 0) AS num_imports,
  coalesce(commit_count, 0) * coalesce(lines_of_code, 0) / greatest(coalesce(author_count, 0), 1)::DOUBLE AS risk_score FROM mm),
l AS (SELECT repository_path, max_by(id, (ts, id)) AS id FROM s GROUP BY repository_path),
x AS (SELECT * FROM m WHERE snapshot_id IN (SELECT id FROM l))
"""
_ACT = "CASE WHEN commit_count >= 100 THEN 'very-high' WHEN commit_count >= 50 THEN 'high' WHEN commit_count >= 20 THEN 'medium' WHEN commit_count >= 5 THEN 'low' ELSE 'minimal' END AS activity"
_SIZE = "CASE WHEN lines_of_code >= 2000 THEN 'very-large' WHEN lines_of_code >= 1000 THEN 'large' WHEN lines_of_code >= 500 THEN 'medium' WHEN lines_of_code >= 100 THEN 'small' ELSE 'tiny' END AS size"
_OWN = "CASE WHEN author_count = 1 THEN 'single' WHEN author_count = 2 THEN 'pair' WHEN author_count <= 5 THEN 'small-team' ELSE 'shared' END AS ownership"
SQL = {
    "snapshots_query": _CTE + f"SELECT id, ts, repository, trigger, total_files FROM s WHERE ts >= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND repository = '{HUB}' AND trigger = 'update' ORDER BY ts DESC, id LIMIT 50",
    "latest_snapshot": _CTE + "SELECT s.repository_path, s.id, ts, total_documents FROM l JOIN s USING (id)",
    "snapshot_by_id": _CTE + "SELECT id, repository_path, total_files, total_vectors FROM s WHERE id = (SELECT min(id) FROM s)",
    "file_trend": _CTE
    + """, b AS (SELECT fp FROM mm GROUP BY fp ORDER BY count(*) DESC, fp LIMIT 1),
t AS (SELECT mm.fp AS file_path, snapshot_id, ts, commit_count, lines_of_code,
  commit_count - lag(commit_count) OVER w AS commit_count_delta, lines_of_code - lag(lines_of_code) OVER w AS lines_of_code_delta
  FROM mm JOIN b USING (fp) JOIN s ON s.id = snapshot_id WINDOW w AS (PARTITION BY repository_path ORDER BY ts, snapshot_id))
SELECT * FROM t ORDER BY ts DESC, snapshot_id LIMIT 10""",
    "code_metadata_risky": _CTE + "SELECT snapshot_id, file_path, round(risk_score, 4) AS risk_score FROM x WHERE risk_score >= 1000 ORDER BY x.risk_score DESC, snapshot_id, file_path LIMIT 100",
    "file_metrics": _CTE + f"SELECT snapshot_id, file_path, commit_count, {_ACT}, lines_of_code, {_SIZE}, author_count, {_OWN}, num_functions, num_imports, round(risk_score, 4) AS risk_score FROM m",
    "most_active": _CTE + f"SELECT snapshot_id, file_path, commit_count, {_ACT} FROM x ORDER BY commit_count DESC, snapshot_id, file_path LIMIT 10",
    "largest_files": _CTE + f"SELECT snapshot_id, file_path, lines_of_code, {_SIZE} FROM x ORDER BY lines_of_code DESC, snapshot_id, file_path LIMIT 10",
    "concentrated_ownership": _CTE
    + f"SELECT snapshot_id, file_path, author_count, {_OWN} FROM (SELECT * FROM x ORDER BY risk_score DESC, snapshot_id, file_path LIMIT 1000) WHERE author_count <= 2 ORDER BY risk_score DESC, snapshot_id, file_path LIMIT 10",
    "snapshot_summary": _CTE
    + """SELECT snapshot_id, count(*) AS total_files, sum(lines_of_code)::BIGINT AS total_loc, sum(num_functions)::BIGINT AS total_functions, round(avg(lines_of_code))::BIGINT AS avg_loc,
count(*) FILTER (commit_count >= 100) AS very_active, count(*) FILTER (commit_count >= 50) AS highly_active, round(count(*) FILTER (commit_count >= 50) * 100.0 / count(*))::BIGINT AS highly_active_percent,
count(*) FILTER (lines_of_code >= 2000) AS very_large, count(*) FILTER (lines_of_code >= 1000) AS large, count(*) FILTER (author_count = 1) AS single_author,
round(count(*) FILTER (author_count = 1) * 100.0 / count(*))::BIGINT AS single_author_percent FROM m GROUP BY snapshot_id""",
    "prune_old": _CTE
    + f"SELECT s.id, any_value(s.ts) AS ts, count(m.file_path) AS n_files FROM s LEFT JOIN m ON m.snapshot_id = s.id WHERE s.ts >= TIMESTAMPTZ '{NOW}+00' - INTERVAL {DAYS} DAY GROUP BY s.id",
    "metadata_append": _CTE
    + "SELECT snapshot_id, count(*) AS n, count(CASE WHEN length(fp) % 2 = 0 THEN commit_count ELSE nullif(commit_count, 0) END) AS with_commits, sum(lines_of_code)::BIGINT AS loc FROM mm GROUP BY snapshot_id",
    "metadata_counts": _CTE + "SELECT snapshot_id, count(*) AS n_files FROM m GROUP BY snapshot_id",
}
