"""Queries on source files and their patterns."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import files as S
from codeloom.operators import patterns as P
from codeloom.operators import scanner as N


def _f(spark, d):
    return table(spark, d, "source_files")


def discover_files(spark, d):
    return S.discover(_f(spark, d)).select("path", "language").distinct()


def validate_files(spark, d):
    return S.validated(_f(spark, d))


def related_tests(spark, d):
    return S.related_tests(_f(spark, d))


def change_detect(spark, d):
    return S.detect_changes(table(spark, d, "file_state"), _f(spark, d))


def update_plan(spark, d):
    return change_detect(spark, d).groupBy("change").agg(F.count("*").alias("files"))


def state_of_components(spark, d):
    return S.state_of(table(spark, d, "components"))


def state_drift(spark, d):
    return S.state_drift(table(spark, d, "file_state"), table(spark, d, "components"))


def incremental_update(spark, d):
    c = table(spark, d, "components").dropDuplicates(["id"]).select("id", "file", "type")
    x = S.apply_update(c, table(spark, d, "file_state"), _f(spark, d), S.declarations(_f(spark, d)).select("id", "file", "type"))
    return x.groupBy("type").agg(F.countDistinct("id").alias("components"))


def scan_declarations(spark, d):
    return S.declarations(_f(spark, d))


def scan_methods(spark, d):
    return S.methods(_f(spark, d))


def scan_agreement(spark, d):
    """How the scanned declarations and methods agree with the components delivered, by type."""
    f = _f(spark, d)
    mine = S.declarations(f).select("file", "name").union(S.methods(f).select("file", "name")).distinct().withColumn("_m", F.lit(1))
    c = table(spark, d, "components").filter("type in ('function', 'method', 'class', 'interface')").select("file", "name", "type").distinct()
    x = c.join(mine, ["file", "name"], "left").groupBy("type").agg(F.count("*").alias("delivered"), F.count("_m").alias("scanned"))
    return x


def scan_spans(spark, d):
    """Classes and interfaces as the scanner sees them, of those that were delivered: their ends, texts and export."""
    s = N.spans(_f(spark, d)).select("file", "name", "start_line", "end_line", "exported", F.md5(F.regexp_replace("snippet", r"\s+", "")).alias("digest"))
    c = table(spark, d, "components").filter("type in ('class', 'interface')").select("id", "file", "name", "start_line").distinct()
    return c.join(s, ["file", "name", "start_line"]).select("id", "end_line", "exported", "digest")


def scan_variables(spark, d):
    """Arrow functions, hooks and constants among the variables of TypeScript and JavaScript files."""
    s = N.spans(_f(spark, d)).filter("type = 'variable'").select("file", "name", "start_line", "end_line", "is_arrow_function", "is_hook", "is_async", "is_constant", "constant_kind")
    c = table(spark, d, "components").filter("type = 'variable'").select("id", "file", "name", "start_line").distinct()
    return c.join(s, ["file", "name", "start_line"]).drop("file", "name", "start_line")


def go_members(spark, d):
    return N.go_members(_f(spark, d)).select("id", "type", "exported", "signature")


def type_parameters(spark, d):
    c = table(spark, d, "components").filter("lower(language) = 'go'").select("id", N.type_parameters(F.coalesce("signature", F.lit(""))).alias("parameters")).distinct()
    return c.filter(F.size("parameters") > 0)


def _markers(path, content):
    for n, line in enumerate(content.split("\n"), 1):
        if "TODO" in line:
            yield {"name": "TODO", "type": "marker", "start_line": n, "end_line": n}


def scan_custom(spark, d):
    """A scanner of one's own: lines that hold a mark."""
    return N.scan_with(_f(spark, d), _markers, ["ts", "go", "py"]).filter("error is null").select("file", "name", "start_line")


def scan_errors(spark, d):
    return N.scan_errors(_f(spark, d))


def go_docs(spark, d):
    return S.doc_lines(_f(spark, d))


def file_imports(spark, d):
    return S.imports(_f(spark, d))


def markdown_sections(spark, d):
    return S.markdown_sections(_f(spark, d)).select("id", "name", "start_line", "docstring", F.md5("text").alias("digest"))


def folder_sizes(spark, d):
    return S.folder_sizes(_f(spark, d))


def file_patterns(spark, d):
    return P.file_patterns(_f(spark, d)).drop("repository")


def import_style(spark, d):
    return P.pattern_mode(P.file_patterns(_f(spark, d)), "import_style", ["repository", "language"])


def error_style(spark, d):
    return P.pattern_mode(P.file_patterns(_f(spark, d)), "error_style", ["repository", "language"])


def type_coverage(spark, d):
    return P.type_coverage(table(spark, d, "components"))


def size_deviation(spark, d):
    return P.size_deviation(P.file_patterns(_f(spark, d)), ["repository", "language"])


def testing_share(spark, d):
    return P.testing_share(P.file_patterns(_f(spark, d)), S.related_tests(_f(spark, d)), ["repository", "language"])


def compare_patterns(spark, d):
    return P.compare(P.file_patterns(_f(spark, d)), P.type_coverage(table(spark, d, "components")), ["repository", "language"])


_F = (discover_files, validate_files, related_tests, change_detect, update_plan, state_of_components, state_drift, incremental_update, scan_declarations, scan_methods, scan_agreement, scan_spans, scan_variables, go_members, type_parameters, scan_custom, scan_errors, go_docs, file_imports, markdown_sections, folder_sizes, file_patterns, import_style, error_style, type_coverage, size_deviation, testing_share, compare_patterns)
QUERIES = {f.__name__: f for f in _F}

_CTE = r"""
WITH f AS (SELECT DISTINCT ON (path) * FROM source_files),
p AS (SELECT path, repository, lower(language) AS language, len(string_split(content, chr(10))) AS lines, length AS bytes,
  len(regexp_extract_all(content, '(?m)^import\s')) AS e, len(regexp_extract_all(content, 'require\s*\(')) AS c,
  (len(regexp_extract_all(content, 'throw\s+new\s+\w*Error')) > 0)::INT AS th, (len(regexp_extract_all(content, 'Result<|\{\s*ok:\s*(?:true|false)')) > 0)::INT AS rs,
  (len(regexp_extract_all(content, '\)\s*:?\s*\([^)]*,\s*error\)')) > 0)::INT AS er, contains(path, '.test.') OR contains(path, '.spec.') AS is_test FROM f),
q AS (SELECT path, repository, language, lines, bytes, CASE WHEN e > 0 AND c > 0 THEN 'mixed' WHEN e > 0 THEN 'esm' WHEN c > 0 THEN 'cjs' ELSE 'unknown' END AS import_style, e + c AS imports,
  CASE WHEN th + rs + er = 0 THEN 'unknown' WHEN th + rs + er > 1 THEN 'mixed' WHEN th = 1 THEN 'throw' WHEN rs = 1 THEN 'result' ELSE 'error-return' END AS error_style, is_test FROM p),
tc AS (SELECT file, annotated, functions, CASE WHEN annotated / functions >= 0.9 THEN 'full' WHEN annotated / functions >= 0.5 THEN 'partial' WHEN annotated > 0 THEN 'minimal' ELSE 'none' END AS coverage FROM
  (SELECT file, count(*) FILTER (regexp_matches(coalesce(signature, ''), '(?:\)|=>)\s*:\s*\w+')) AS annotated, count(*) AS functions FROM (SELECT DISTINCT ON (id) * FROM components) WHERE type IN ('function', 'method') AND file IS NOT NULL GROUP BY file)),
cand AS (SELECT path, unnest([regexp_extract(path, '^(.*)\.[^./]+$', 1) || '.test.' || regexp_extract(path, '\.([^./]+)$', 1), regexp_extract(path, '^(.*)\.[^./]+$', 1) || '.spec.' || regexp_extract(path, '\.([^./]+)$', 1)]) AS test, unnest([0, 1]) AS n FROM p WHERE NOT is_test),
rt AS (SELECT p.path, arg_min(k.test, k.n) AS test FROM p LEFT JOIN (SELECT cand.* FROM cand JOIN f ON f.path = cand.test) k USING (path) WHERE NOT p.is_test GROUP BY p.path),
ch AS (SELECT path, CASE WHEN s.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'deleted' WHEN s.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS change
  FROM (SELECT path, path AS p, max(hash) AS hash FROM file_state GROUP BY path) s FULL JOIN (SELECT path, path AS p, sha256(content) AS hash FROM f) n USING (path)),
ln AS (SELECT path, language, unnest(string_split(regexp_replace(regexp_replace(content, '^\x{FEFF}', ''), '\r', '', 'g'), chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM f)
"""
_MODE = "SELECT repository, language, mode, times, total FROM (SELECT repository, language, {0} AS mode, count(*) AS times, sum(count(*)) OVER (PARTITION BY repository, language)::BIGINT AS total, row_number() OVER (PARTITION BY repository, language ORDER BY count(*) DESC, min(path)) AS r FROM {1} GROUP BY repository, language, {0}) WHERE r = 1"


def _declarations() -> str:
    kind, name = [], []
    for language, rules in S.DECLARATIONS.items():
        test = "language IN ('typescript', 'javascript')" if language == "ecma" else f"language = '{language}'"
        for k, pattern in rules:
            kind.append(f"WHEN {test} AND regexp_matches(line, '{pattern}') THEN '{k}'")
            name.append(f"WHEN {test} AND regexp_matches(line, '{pattern}') THEN regexp_extract(line, '{pattern}', 1)")
    return (
        f", de AS (SELECT path, language, line, line_no, CASE {' '.join(kind)} END AS type, CASE {' '.join(name)} END AS own FROM ln WHERE NOT (language = 'go' AND path IN (SELECT path FROM f WHERE regexp_matches(string_split(content, chr(10))[1], 'Code generated|DO NOT EDIT'))))"
        r" SELECT path || ':' || name || ':' || line_no AS id, path AS file, name, type, line_no AS start_line, trim(regexp_replace(string_split(line, '{')[1], '\s*=>\s*$|\s*=\s*$', '')) AS signature,"
        r" CASE WHEN language IN ('typescript', 'javascript') THEN starts_with(line, 'export') WHEN language = 'go' THEN regexp_matches(own, '^\p{Lu}') ELSE NOT starts_with(own, '_') END AS exported FROM (SELECT *, CASE WHEN type = 'method' THEN regexp_extract(line, '" + S.GO_RECEIVER + r"', 1) || '.' || own ELSE own END AS name FROM de) WHERE type IS NOT NULL"
    )


def _methods() -> str:
    e, p = S.DECLARATIONS["ecma"][1][1], S.DECLARATIONS["python"][1][1]
    ecma = "language IN ('typescript', 'javascript')"
    bad = ", ".join(f"'{w}'" for w in S.NOT_METHODS)
    return (
        f", ow AS (SELECT *, CASE WHEN {ecma} AND regexp_matches(line, '{e}') THEN regexp_extract(line, '{e}', 1) WHEN language = 'python' AND regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 1) WHEN regexp_matches(line, '^\\S') THEN '' END AS o FROM ln WHERE {ecma} OR language = 'python'),"
        f" cf AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner, CASE WHEN {ecma} THEN regexp_extract(line, '{S.METHOD['ecma']}', 1) ELSE regexp_extract(line, '{S.METHOD['python']}', 1) END AS own FROM ow)"
        f" SELECT path || ':' || owner || '.' || own || ':' || line_no AS id, path AS file, owner || '.' || own AS name, line_no AS start_line, trim(regexp_replace(line, '\\s*[{{:]\\s*$', '')) AS signature, regexp_matches(line, '\\basync\\b') AS is_async FROM cf WHERE owner <> '' AND own <> '' AND own NOT IN ({bad})"
    )


SQL = {
    "discover_files": """SELECT DISTINCT path, language FROM source_files WHERE lower(string_split(path, '.')[-1]) IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'go', 'py', 'md', 'mdx', 'markdown') AND contains(path, '.')
AND NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', 'bower_components', 'vendor', 'third_party', 'dist', 'build', 'out', 'target', '.next', '.turbo', '.nuxt', 'mocks', 'testdata', '.git', '.svn', '.hg', '.vscode', '.idea', '.vs', '.fleet', '.cache', '.parcel-cache', '.vite', 'coverage', '.nyc_output', 'logs', 'tmp', 'temp', '__fixtures__', '__snapshots__', 'fixtures', 'analysis-reports', '.research', 'benchmarks'])
AND NOT (ends_with(path, '.pb.go') OR ends_with(path, '.gen.go') OR ends_with(path, '_gen.go') OR ends_with(path, '.pb.gw.go') OR ends_with(path, '.log') OR ends_with(path, '.tmp') OR string_split(path, '/')[-1] IN ('.eslintcache', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'Gemfile.lock', '.DS_Store', 'Thumbs.db') OR (starts_with(string_split(path, '/')[-1], 'mock_') AND ends_with(path, '.go')))""",
    "validate_files": r"SELECT path, CASE WHEN content = '' THEN 'empty' WHEN regexp_replace(content, '\s+', '', 'g') = '' THEN 'blank' WHEN contains(content, chr(0)) THEN 'binary' ELSE 'ok' END AS status FROM (SELECT DISTINCT path, content FROM source_files)",
    "related_tests": _CTE + "SELECT * FROM rt",
    "change_detect": _CTE + "SELECT * FROM ch",
    "update_plan": _CTE + "SELECT change, count(*) AS files FROM ch GROUP BY change",
    "state_of_components": "SELECT file, list_sort(list(DISTINCT id)) AS document_ids, count(DISTINCT id)::INT AS n FROM components WHERE file IS NOT NULL GROUP BY file",
    "state_drift": "SELECT path, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (b IS NULL) AS stale FROM (SELECT DISTINCT path, unnest(document_ids) AS id, 1 AS a FROM file_state) FULL JOIN (SELECT DISTINCT file AS path, id, 1 AS b FROM components) USING (path, id) GROUP BY path HAVING count(*) FILTER (a IS NULL) + count(*) FILTER (b IS NULL) > 0",
    "scan_declarations": _CTE + _declarations(),
    "scan_methods": _CTE + _methods(),
    "scan_agreement": "SELECT type, count(*) AS delivered, count(m) AS scanned FROM (SELECT DISTINCT file, name, type FROM components WHERE type IN ('function', 'method', 'class', 'interface')) LEFT JOIN (SELECT DISTINCT file, name, 1 AS m FROM (SELECT file, name FROM (" + _CTE + _declarations() + ") UNION ALL SELECT file, name FROM (" + _CTE + _methods() + "))) USING (file, name) GROUP BY type",
    "incremental_update": _CTE + ", sd AS (SELECT * FROM (" + (_CTE + _declarations()) + ")), o AS (SELECT DISTINCT ON (id) id, file, type FROM components) SELECT type, count(DISTINCT id) AS components FROM (SELECT id, type FROM o WHERE file NOT IN (SELECT path FROM ch WHERE change IN ('changed', 'deleted')) UNION ALL SELECT id, type FROM sd WHERE file IN (SELECT path FROM ch WHERE change IN ('changed', 'added'))) GROUP BY type",
    "go_docs": _CTE + r""", g AS (SELECT *, starts_with(line, '//') AS c, sum(CASE WHEN starts_with(line, '//') THEN 0 ELSE 1 END) OVER w AS island, lag(starts_with(line, '//')) OVER w AS above FROM ln WHERE ends_with(path, '.go') WINDOW w AS (PARTITION BY path ORDER BY line_no)),
dd AS (SELECT path, island, string_agg(regexp_replace(line, '^//\s?', ''), chr(10) ORDER BY line_no) AS doc FROM g WHERE c GROUP BY ALL)
SELECT g.path AS file, g.line_no, doc FROM g JOIN dd ON dd.path = g.path AND dd.island = g.island - 1 WHERE NOT c AND above AND regexp_matches(line, '^(?:func|type|const|var)\b')""",
    "file_imports": _CTE + r""", i AS (SELECT path, 'esm' AS kind, unnest(list_concat(regexp_extract_all(content, '(?m)^import\s[^''";]*?[''"]([^''"\n]+)[''"]', 1), regexp_extract_all(content, '(?m)^export\s[^''";=(]*?from\s+[''"]([^''"\n]+)[''"]', 1))) AS module FROM f WHERE language IN ('typescript', 'javascript')
UNION ALL SELECT path, 'cjs', unnest(regexp_extract_all(content, '\brequire\s*\(\s*[''"]([^''"\n]+)[''"]', 1)) FROM f WHERE language IN ('typescript', 'javascript')
UNION ALL SELECT path, 'go', unnest(regexp_extract_all(content, '(?m)^\t(?:[\w.]+\s+)?"([^"\n]+)"\r?$', 1)) FROM f WHERE language = 'go'
UNION ALL SELECT path, 'python', unnest(regexp_extract_all(content, '(?m)^(?:from|import)\s+([\w.]+)', 1)) FROM f WHERE language = 'python') SELECT DISTINCT * FROM i""",
    "scan_spans": "SELECT DISTINCT id, end_line, exported, md5(regexp_replace(snippet, '\\s+', '', 'g')) AS digest FROM components WHERE type IN ('class', 'interface')",
    "scan_variables": "SELECT DISTINCT id, end_line, is_arrow_function, is_hook, is_async, is_constant, constant_kind FROM components WHERE type = 'variable' AND regexp_matches(file, '\\.(ts|tsx|js)$') AND regexp_matches(snippet, '^(?:export )?(?:const|let|var) ')",
    "go_members": _CTE + r""", g AS (SELECT path, line, line_no, last_value(CASE WHEN regexp_matches(line, '^const\s*\(') THEN 1 WHEN regexp_matches(line, '^\S') THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS b FROM ln WHERE ends_with(path, '.go') AND path NOT IN (SELECT path FROM f WHERE regexp_matches(string_split(content, chr(10))[1], 'Code generated|DO NOT EDIT'))),
t AS (SELECT *, regexp_extract(line, '^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?:=\s*)?([^\s=(]\w*)', ['n', 'k']) AS a, coalesce(nullif(regexp_extract(line, '^const\s+([A-Z]\w*)\b', 1), ''), CASE WHEN b = 1 THEN nullif(regexp_extract(line, '^\s+([A-Z]\w*)\b', 1), '') END) AS c FROM g),
n AS (SELECT *, CASE WHEN a.n <> '' AND a.k NOT IN ('struct', 'interface') THEN a.n END AS ty FROM t)
SELECT path || ':' || coalesce(ty, c) || ':' || line_no AS id, CASE WHEN ty IS NULL THEN 'variable' ELSE 'type' END AS type, ascii(coalesce(ty, c)) BETWEEN 65 AND 90 AS exported, trim(regexp_replace(line, '\s*//.*$', '')) AS signature FROM n WHERE coalesce(ty, c) IS NOT NULL""",
    "type_parameters": "SELECT DISTINCT id, list_filter(list_transform(string_split(replace(regexp_extract(signature, '\\[([^\\]]+)\\]', 1), ', ', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS parameters FROM components WHERE lower(language) = 'go' AND regexp_matches(signature, '\\[[^\\]]+\\]')",
    "scan_custom": "SELECT DISTINCT path AS file, 'TODO' AS name, line_no AS start_line FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM source_files) WHERE contains(line, 'TODO') AND (ends_with(path, '.ts') OR ends_with(path, '.go') OR ends_with(path, '.py'))",
    "scan_errors": """SELECT language, error, count(*) AS files FROM (SELECT DISTINCT path, CASE string_split(path, '.')[-1] WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language,
CASE WHEN contains(content, chr(0)) THEN 'binary' WHEN length(regexp_replace(content, '\\s+', '', 'g')) = 0 THEN 'empty' WHEN ends_with(path, '.go') AND regexp_matches(split_part(content, chr(10), 1), 'Code generated|DO NOT EDIT') THEN 'generated' END AS error FROM source_files) WHERE error IS NOT NULL GROUP BY ALL""",
    "markdown_sections": _CTE + r""", a AS (SELECT path, line, line_no, regexp_matches(line, '^\s{0,3}(?:```|~~~)') AS fence, sum(regexp_matches(line, '^\s{0,3}(?:```|~~~)')::INT) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS open FROM ln WHERE regexp_matches(path, '\.(md|mdx|markdown)$')),
h AS (SELECT *, NOT fence AND NOT open AND regexp_matches(line, '^#{1,6}(?:\s|$)') AS head FROM a),
k AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY line_no) AS section, CASE WHEN fence OR open THEN 'code' WHEN NOT head AND trim(line, ' ') <> '' AND NOT regexp_matches(line, '^\s*(?:[-*+]\s|\d+[.)]\s|>|\||<!--|(?:[-*_]\s*){3,}$)') THEN 'prose' END AS kind FROM h),
b AS (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY line_no) AS before FROM k),
pc AS (SELECT *, CASE WHEN fence AND open OR kind = 'prose' AND before IS DISTINCT FROM 'prose' THEN chr(10) ELSE '' END || line AS piece FROM b WHERE section > 0),
s AS (SELECT path, section, min(line_no) FILTER (head) AS start_line, any_value(trim(regexp_replace(regexp_replace(line, '^#+\s*', ''), '\s+#+\s*$', ''), ' ')) FILTER (head) AS name, regexp_replace(string_agg(piece, chr(10) ORDER BY line_no) FILTER (kind IS NOT NULL), '^\n', '') AS content FROM pc GROUP BY ALL)
SELECT path || ':' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || ':' || start_line AS id, name, start_line, substr(content, 1, 200) AS docstring, md5(name || chr(10) || chr(10) || content) AS digest FROM s WHERE content <> ''""",
    "folder_sizes": _CTE + "SELECT array_to_string(string_split(path, '/')[1:least(len(string_split(path, '/')) - 1, 2)], '/') AS folder, count(*) AS files, sum(length)::BIGINT AS bytes FROM f GROUP BY 1",
    "file_patterns": _CTE + "SELECT path, language, lines, bytes, import_style, imports, error_style, is_test FROM q",
    "import_style": _CTE + _MODE.format("import_style", "q"),
    "error_style": _CTE + _MODE.format("error_style", "q"),
    "type_coverage": _CTE + "SELECT * FROM tc",
    "size_deviation": _CTE + ", g AS (SELECT repository, language, avg(lines) AS m, list_sort(list(lines))[(count(*) // 2 + 1)::INT] AS median, min(lines) AS smallest, max(lines) AS largest FROM q GROUP BY ALL) SELECT path, repository, language, lines, round(m)::BIGINT AS average, median, smallest, largest, CASE WHEN abs(lines - m) / m > 0.2 THEN CASE WHEN lines > m THEN 'larger' ELSE 'smaller' END ELSE 'similar' END AS deviation FROM q JOIN g USING (repository, language)",
    "testing_share": _CTE + "SELECT repository, language, count(*) AS files, count(test) AS tested, round(count(test) * 100.0 / count(*))::BIGINT AS percent FROM q JOIN rt USING (path) GROUP BY ALL",
    "compare_patterns": _CTE + ", x AS (SELECT q.*, coalesce(coverage, 'none') AS coverage FROM q LEFT JOIN tc ON tc.file = q.path), a AS (" + _MODE.format("import_style", "x") + "), b AS (" + _MODE.format("error_style", "x") + "), c AS (" + _MODE.format("coverage", "x") + ") SELECT path, x.repository, x.language, import_style, a.mode AS common_import_style, error_style, b.mode AS common_error_style, coverage, c.mode AS common_coverage FROM x JOIN a USING (repository, language) JOIN b USING (repository, language) JOIN c USING (repository, language)",
}
