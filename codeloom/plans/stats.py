"""Queries on index statistics."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import metrics as M
from codeloom.operators import stats as S


def _c(spark, d):
    return table(spark, d, "components")


def _packages(spark, d):
    """Package paths: the first two folders of every file."""
    f = _c(spark, d).select(F.array_join(F.slice(F.split("file", "/"), 1, 2), "/").alias("package"), F.size(F.split("file", "/")).alias("n"))
    return f.filter("n > 2").select("package").distinct()


def _half(spark, d, hub):
    c = _c(spark, d)
    return S.by_language(c.filter(F.col("repository") == "meridian-hub") if hub else c.filter(F.col("repository") != "meridian-hub"))


def language_stats(spark, d):
    return S.by_language(_c(spark, d))


def type_stats(spark, d):
    return S.by_type(_c(spark, d))


def package_stats(spark, d):
    x = S.by_package(_c(spark, d), _packages(spark, d))
    return x.select("package", "files", "components", F.map_keys("languages").alias("languages"))


def package_longest_prefix(spark, d):
    nested = _packages(spark, d).union(_packages(spark, d).select(F.concat("package", F.lit("/src"))))
    return S.package_of(_c(spark, d), nested)


def stats_merge(spark, d):
    return S.merge(S.by_language(_c(spark, d)), _half(spark, d, True), _half(spark, d, False), "language")


def stats_diff(spark, d):
    return S.diff(_half(spark, d, True), _half(spark, d, False), "language")


def languages_added_removed(spark, d):
    f = table(spark, d, "file_state")
    # Languages of the index and of the files as they are now, both ways.
    a = f.select(F.lower("language").alias("language")).distinct()
    b = table(spark, d, "source_files").select(F.lower("language").alias("language")).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("removed")).union(b.exceptAll(a).withColumn("side", F.lit("added"))).union(
        a.join(b, "language", "left_semi").withColumn("side", F.lit("kept"))
    )


def stats_trend(spark, d):
    return S.overall_trend(_half(spark, d, True), _half(spark, d, False))


def language_total(spark, d):
    return S.with_grand_total(S.by_language(_c(spark, d)), "language")


def stats_export_csv(spark, d):
    return S.export_rows(S.by_language(_c(spark, d)), "language", "language")


def stats_export_json(spark, d):
    return S.export_json(S.by_language(_c(spark, d)), "language")


def stats_export_markdown(spark, d):
    return S.markdown_rows(S.by_language(_c(spark, d)), "language")


def _now(spark, d):
    """The files of the newest snapshot of each series."""
    last = M.latest(table(spark, d, "snapshots"), "repository_path").select(F.col("id").alias("snapshot_id"))
    return M.file_metrics(table(spark, d, "code_metadata")).join(last, "snapshot_id", "left_semi")


def language_activity(spark, d):
    return S.language_activity(S.by_language(_c(spark, d)).select("language", "files"), _now(spark, d))


def package_activity(spark, d):
    return S.package_activity(_packages(spark, d), _now(spark, d))


def extension_counts(spark, d):
    return S.extension_counts(table(spark, d, "source_files"))


_F = (language_stats, type_stats, package_stats, package_longest_prefix, stats_merge, stats_diff, languages_added_removed, stats_trend, language_total, stats_export_csv, stats_export_json, stats_export_markdown, language_activity, package_activity, extension_counts)
QUERIES = {f.__name__: f for f in _F}

_LANG = "CASE regexp_extract(lower({0}), '\\.([^./\\\\]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' WHEN 'mdx' THEN 'markdown' WHEN 'markdown' THEN 'markdown' ELSE 'unknown' END"
_STAT = "SELECT language, count(*) FILTER (first) AS files, count(*) AS components, sum(greatest(end_line - start_line + 1, 0))::BIGINT AS lines FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start_line, id) = 1 AS first FROM c {0}) GROUP BY language"
_CTE = (
    "WITH c AS (SELECT DISTINCT ON (id) * REPLACE (coalesce(lower(language), 'unknown') AS language) FROM components), stat AS ("
    + _STAT.format("")
    + "), hub AS ("
    + _STAT.format("WHERE repository = 'meridian-hub'")
    + "), rest AS ("
    + _STAT.format("WHERE repository <> 'meridian-hub'")
    + r"""), pk AS (SELECT DISTINCT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS package FROM components WHERE len(string_split(file, '/')) > 2),
s AS (SELECT DISTINCT * FROM snapshots), l AS (SELECT max_by(id, (ts, id)) AS id FROM s GROUP BY repository_path),
m AS (SELECT DISTINCT ON (snapshot_id, file_path) * FROM (SELECT snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, coalesce(commit_count, 0) AS commit_count, last_modified FROM code_metadata) WHERE snapshot_id IN (SELECT id FROM l))
"""
)
SQL = {
    "language_stats": _CTE + "SELECT * FROM stat",
    "type_stats": _CTE + "SELECT type, count(*) AS components, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS percent FROM c GROUP BY type",
    "package_stats": _CTE + "SELECT package, count(DISTINCT file) AS files, count(*) AS components, list_sort(list(DISTINCT language)) AS languages FROM c JOIN pk ON starts_with(file, package || '/') GROUP BY package",
    "package_longest_prefix": _CTE + ", pp AS (SELECT package FROM pk UNION SELECT package || '/src' FROM pk) SELECT f.file, max_by(package, length(package)) AS package FROM (SELECT DISTINCT file FROM c) f LEFT JOIN pp ON starts_with(f.file, package || '/') GROUP BY f.file",
    "stats_merge": _CTE
    + "SELECT language, greatest(sum(f), 0)::BIGINT AS files, greatest(sum(n), 0)::BIGINT AS components, greatest(sum(k), 0)::BIGINT AS lines FROM (SELECT language, files AS f, components AS n, lines AS k FROM stat UNION ALL SELECT language, -files, 0, 0 FROM hub UNION ALL SELECT * FROM rest) GROUP BY language HAVING greatest(sum(f), 0) > 0",
    "stats_diff": _CTE
    + """, u AS (SELECT 'files' AS metric, coalesce(h.language, r.language) AS language, h.language IS NULL AS a, r.language IS NULL AS g, coalesce(h.files, 0) AS b, coalesce(r.files, 0) AS n FROM hub h FULL JOIN rest r USING (language)
UNION ALL SELECT 'components', coalesce(h.language, r.language), h.language IS NULL, r.language IS NULL, coalesce(h.components, 0), coalesce(r.components, 0) FROM hub h FULL JOIN rest r USING (language)
UNION ALL SELECT 'lines', coalesce(h.language, r.language), h.language IS NULL, r.language IS NULL, coalesce(h.lines, 0), coalesce(r.lines, 0) FROM hub h FULL JOIN rest r USING (language))
SELECT language, metric, b::DOUBLE AS before, n::DOUBLE AS after, (n - b)::DOUBLE AS absolute, CASE WHEN b = 0 THEN CASE WHEN n = 0 THEN 0.0 ELSE 100.0 END ELSE round((n - b)::DOUBLE / b * 100, 2) END::DOUBLE AS percent,
CASE WHEN a THEN 'added' WHEN g THEN 'removed' WHEN n <> b THEN 'changed' ELSE 'unchanged' END AS status FROM u""",
    "languages_added_removed": "WITH a AS (SELECT DISTINCT lower(language) AS language FROM file_state), b AS (SELECT DISTINCT lower(language) AS language FROM source_files) (SELECT language, 'removed' AS side FROM (FROM a EXCEPT FROM b)) UNION ALL (SELECT language, 'added' FROM (FROM b EXCEPT FROM a)) UNION ALL SELECT language, 'kept' FROM (FROM a INTERSECT FROM b)",
    "stats_trend": _CTE + "SELECT b AS before, a AS after, CASE WHEN a - b > 10 THEN 'growing' WHEN a - b < -10 THEN 'shrinking' ELSE 'stable' END AS trend FROM (SELECT sum(files)::BIGINT AS b FROM hub), (SELECT sum(files)::BIGINT AS a FROM rest)",
    "language_total": _CTE + "SELECT CASE WHEN grouping(language) = 1 THEN 'Total' ELSE language END AS language, sum(files)::BIGINT AS files, sum(components)::BIGINT AS components, sum(lines)::BIGINT AS lines FROM stat GROUP BY ROLLUP (language)",
    "stats_export_csv": _CTE + "SELECT 'language' AS category, replace(language, ',', ';') AS subcategory, 'files' AS metric, files::VARCHAR AS value FROM stat UNION ALL SELECT 'language', replace(language, ',', ';'), 'components', components::VARCHAR FROM stat UNION ALL SELECT 'language', replace(language, ',', ';'), 'lines', lines::VARCHAR FROM stat",
    "stats_export_json": _CTE + """SELECT language, '{"files":' || files || ',"components":' || components || ',"lines":' || lines || '}' AS json FROM stat""",
    "stats_export_markdown": _CTE + "SELECT language, '| ' || language || ' | ' || files || ' | ' || components || ' | ' || lines || ' |' AS line FROM stat",
    "language_activity": _CTE + ", a AS (SELECT " + _LANG.format("file_path") + " AS language, sum(commit_count)::BIGINT AS t, round(avg(commit_count), 4) AS v, max(last_modified) AS x FROM m GROUP BY 1) SELECT stat.language, files, coalesce(t, 0) AS total_commits, coalesce(v, 0.0) AS avg_commits, x AS last_change FROM stat LEFT JOIN a USING (language)",
    "package_activity": _CTE + "SELECT package, sum(commit_count)::BIGINT AS total_commits, max(last_modified) AS last_change, count(*) AS files FROM m JOIN pk ON starts_with(file_path, package) GROUP BY package",
    "extension_counts": "SELECT regexp_extract(lower(path), '\\.([^./\\\\]+)$', 1) AS extension, " + _LANG.format("path") + " AS language, count(DISTINCT path) AS files FROM source_files GROUP BY ALL",
}
