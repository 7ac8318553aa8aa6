"""Queries on scanned components: filters, joins with files and changes, texts."""

from pyspark.sql import functions as F

from codeloom.functions.classes import LANGUAGE_OF
from codeloom.io import table
from codeloom.operators import components as C
from codeloom.operators import stats as S
from codeloom.plans.stats import _now, _packages

NOW = "2025-06-01 00:00:00"


def _c(spark, d):
    return table(spark, d, "components")


def filter_exported(spark, d):
    return C.by_export(_c(spark, d)).select("id").distinct()


def filter_types(spark, d):
    return C.by_types(_c(spark, d), ["function", "class"]).select("id", "type").distinct()


def filter_languages(spark, d):
    return C.by_languages(_c(spark, d), ["TypeScript", "go"]).select("id").distinct()


def build_code_metadata(spark, d):
    return C.code_metadata(_c(spark, d), table(spark, d, "source_files"), _now(spark, d))


def same_extension_files(spark, d):
    """For the first file of each repository and language."""
    f = table(spark, d, "source_files")
    first = f.filter("path is not null").groupBy("repository", "language").agg(F.min("path").alias("path"))
    return C.same_extension(f, first.select("repository", "path"), 5)


def stale_files(spark, d):
    return C.stale(table(spark, d, "file_state"), F.to_timestamp(F.lit(NOW)))


def index_coverage(spark, d):
    return C.coverage(table(spark, d, "source_files"), table(spark, d, "file_state"))


def package_diff(spark, d):
    """Packages as the index holds them against packages as they were scanned, with their commits."""
    c, p = _c(spark, d), _packages(spark, d)
    held = c.join(table(spark, d, "file_state").select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    commits = S.package_activity(p, _now(spark, d)).select("package", "total_commits")
    return C.package_diff(S.by_package(held, p).drop("languages").withColumn("total_commits", F.lit(0)), S.by_package(c, p).join(commits, "package", "left"))


def component_embedding_texts(spark, d):
    c = _c(spark, d).dropDuplicates(["id"])
    return c.select("id", F.md5(C.embedding_text()).alias("embedding_text"), F.md5(C.text_with_signature()).alias("with_signature"), C.json_tokens().alias("json_tokens"))


def component_lines(spark, d):
    return C.component_lines(_c(spark, d), table(spark, d, "source_files")).select("id", F.md5("lines").alias("digest"))


def language_extensions(spark, d):
    """The extensions of each language that the files of the index have, and how many files have one of them."""
    pairs = spark.createDataFrame([(v, k) for k, v in LANGUAGE_OF.items()], "language string, extension string")
    known = pairs.groupBy("language").agg(F.array_sort(F.collect_list("extension")).alias("extensions"))
    n = S.extension_counts(table(spark, d, "source_files")).groupBy("language").agg(F.sum("files").alias("files"))
    return known.join(n, "language").select("language", "extensions", "files")


_F = (filter_exported, filter_types, filter_languages, build_code_metadata, same_extension_files, stale_files, index_coverage, package_diff, component_embedding_texts, component_lines, language_extensions)
QUERIES = {f.__name__: f for f in _F}
_C = "WITH c AS (SELECT DISTINCT ON (id) * FROM components)"
_M = r"""s AS (SELECT DISTINCT * FROM snapshots), l AS (SELECT max_by(id, (ts, id)) AS id FROM s GROUP BY repository_path),
m AS (SELECT DISTINCT ON (snapshot_id, file_path) * FROM (SELECT snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, coalesce(commit_count, 0) AS commit_count, greatest(coalesce(author_count, 0), 1) AS author_count, last_modified FROM code_metadata) WHERE snapshot_id IN (SELECT id FROM l)),
pk AS (SELECT DISTINCT split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS package FROM components WHERE len(string_split(file, '/')) > 2)"""
_TOKENS = "CASE WHEN {0} = '' THEN 0 ELSE greatest(ceil(length({0}) / 4.5), ceil(len(string_split({0}, ' ')) * 1.25)) END::BIGINT"
SQL = {
    "filter_exported": "SELECT DISTINCT id FROM components WHERE exported",
    "filter_types": "SELECT DISTINCT id, type FROM components WHERE type IN ('function', 'class')",
    "filter_languages": "SELECT DISTINCT id FROM components WHERE language ILIKE 'typescript' OR language ILIKE 'go'",
    "build_code_metadata": _C + ", " + _M + """, i AS (SELECT file, count(DISTINCT u) AS n FROM (SELECT file, unnest(imports) AS u FROM c) GROUP BY file),
p AS (SELECT file, count(*) AS a, count(*) FILTER (type IN ('function', 'method')) AS b FROM c WHERE file IS NOT NULL GROUP BY file),
n AS (SELECT path, max(len(content) - len(replace(content, chr(10), '')) + 1) AS n FROM source_files GROUP BY path),
k AS (SELECT file_path, max(commit_count) AS cc, max(author_count) AS ac, max(last_modified) AS lm FROM m GROUP BY file_path)
SELECT p.file AS file_path, a AS num_components, b AS num_functions, coalesce(i.n, 0) AS num_imports, coalesce(n.n, 0) AS lines_of_code, coalesce(cc, 0) AS commit_count, coalesce(ac, 0) AS author_count, lm AS last_modified
FROM p LEFT JOIN i ON i.file = p.file LEFT JOIN n ON n.path = p.file LEFT JOIN k ON k.file_path = p.file""",
    "same_extension_files": """WITH f AS (SELECT DISTINCT repository, path, lower(string_split(path, '.')[-1]) AS ext FROM source_files), r AS (SELECT repository, language, min(path) AS ref FROM source_files GROUP BY ALL)
SELECT ref, path, position FROM (SELECT ref, path, row_number() OVER (PARTITION BY ref ORDER BY path)::INT AS position FROM (SELECT DISTINCT ref, f.path FROM r JOIN f ON f.repository = r.repository AND f.ext = lower(string_split(ref, '.')[-1]) AND f.path <> ref)) WHERE position <= 5""",
    "stale_files": f"SELECT path, max(last_indexed) IS NULL OR max(last_indexed) < TIMESTAMPTZ '{NOW}+00' - INTERVAL 15 MINUTE AS stale FROM file_state WHERE path IS NOT NULL GROUP BY path",
    "index_coverage": "SELECT repository, count(DISTINCT path) AS files, count(DISTINCT s) AS indexed, round(count(DISTINCT s) * 100.0 / count(DISTINCT path), 2)::DOUBLE AS percent FROM source_files LEFT JOIN (SELECT DISTINCT path, path AS s FROM file_state) USING (path) GROUP BY repository",
    "package_diff": _C + ", " + _M + """, h AS (SELECT package, count(DISTINCT file) AS f, count(*) AS n FROM c JOIN pk ON starts_with(file, package || '/') WHERE file IN (SELECT path FROM file_state) GROUP BY package),
a AS (SELECT package, count(DISTINCT file) AS f, count(*) AS n FROM c JOIN pk ON starts_with(file, package || '/') GROUP BY package), k AS (SELECT package, sum(commit_count)::BIGINT AS t FROM m JOIN pk ON starts_with(file_path, package) GROUP BY package)
SELECT a.package, (a.f - coalesce(h.f, 0))::BIGINT AS files_change, (a.n - coalesce(h.n, 0))::BIGINT AS components_change, coalesce(t, 0) AS total_commits_change FROM a LEFT JOIN h USING (package) LEFT JOIN k USING (package)""",
    "component_embedding_texts": _C + """, j AS (SELECT *, CASE WHEN type = 'variable' AND is_constant THEN 'constant' ELSE type END || ' ' || name || chr(10) || coalesce(signature, '') || CASE WHEN coalesce(docstring, '') = '' THEN '' ELSE chr(10) || docstring END AS e,
type || ': ' || name || CASE WHEN coalesce(signature, '') = '' THEN '' ELSE chr(10) || signature END || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || text END AS w,
'{"name":' || to_json(name) || ',"type":' || to_json(type) || ',"file":' || to_json(file) || ',"start_line":' || start_line || ',"end_line":' || end_line || '}' AS js FROM c)
SELECT id, md5(e) AS embedding_text, md5(w) AS with_signature, """ + _TOKENS.format("js") + " AS json_tokens FROM j",
    "component_lines": _C + ", f AS (SELECT path, min(content) AS content FROM source_files GROUP BY path) SELECT id, md5(array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10))) AS digest FROM c JOIN f ON f.path = c.file",
    "language_extensions": """WITH k AS (SELECT * FROM (VALUES ('typescript', ['ts', 'tsx']), ('javascript', ['cjs', 'js', 'jsx', 'mjs']), ('go', ['go']), ('python', ['py']), ('markdown', ['markdown', 'md', 'mdx'])) v(language, extensions))
SELECT k.language, extensions, count(DISTINCT path) AS files FROM k JOIN source_files ON list_contains(extensions, lower(string_split(path, '.')[-1])) GROUP BY ALL""",
}
