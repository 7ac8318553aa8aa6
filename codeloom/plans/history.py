"""Queries on commits and issues: search, history, budgets."""

from pyspark.sql import functions as F

from codeloom.io import table
from codeloom.operators import history as H
from codeloom.operators import texts as X
from codeloom.plans.embedding_sql import distances, embedded

QUERY = "merge the batch of a private scanner"
REF = 25


def _d(spark, d):
    return table(spark, d, "documents")


def commit_search(spark, d):
    return H.commit_search(_d(spark, d), QUERY, 10).select("doc_id", F.round("score", 4).alias("score"))


def related_commits(spark, d):
    """For every issue whose number is divisible by 100."""
    docs = _d(spark, d)
    return H.related_commits(docs.filter("kind = 'issue' and doc_id % 100 = 0"), docs, 3)


def file_history(spark, d):
    return H.file_history(_d(spark, d)).select("file", "position", "doc_id")


def search_queries(spark, d):
    x = X.title_and_body(X.once(_d(spark, d)))
    return x.select("doc_id", F.md5(H.search_query()).alias("query"), F.md5(H.clean_description(F.col("text"))).alias("description"))


def acceptance_criteria(spark, d):
    return H.acceptance_criteria(_d(spark, d))


def related_by_title(spark, d):
    return H.related_by_title(_d(spark, d), REF)


def commit_budget(spark, d):
    return H.commit_budget(_d(spark, d), "repository", 2000).select("repository", "doc_id", "tokens", "used")


def insights(spark, d):
    """For every hundredth vector as a pattern, with labels in place of files."""
    v = table(spark, d, "embeddings")
    return H.insights(v, v.filter("vec_id % 100 = 0"), "label", 0.25)


def update_warnings(spark, d):
    return H.incremental_updates(table(spark, d, "snapshots"))


def issue_links(spark, d):
    """What each text refers to among the documents of its repository: issues, then pull requests."""
    docs = _d(spark, d)
    return X.related_with_pulls(docs, docs.select(F.col("doc_id").alias("number"), "doc_id", "repository"))


def relevance_labels(spark, d):
    """Relevance to a pattern, with kind and source as labels."""
    return X.ranked(_d(spark, d).withColumn("labels", F.array("kind", "source")), "review|filter", 20, labels="labels", pattern=True).select("doc_id", "relevance")


_F = (commit_search, related_commits, file_history, search_queries, acceptance_criteria, related_by_title, commit_budget, insights, update_warnings, issue_links, relevance_labels)
QUERIES = {f.__name__: f for f in _F}
_D = r"WITH d AS (SELECT DISTINCT ON (doc_id) *, split_part(text, chr(10), 1) AS title, trim(regexp_replace(text, '^[^\n]*\n?', ''), ' ') AS body FROM documents)"
_K = ", k AS (SELECT doc_id AS id, text FROM d WHERE kind = 'commit')"
_Q = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', coalesce(title, ''), substr(coalesce(body, ''), 1, 500)), '(?s)```.*?```', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#*_`]', '', 'g'), '^\s+|\s+$', '', 'g')"
_TOKENS = r"CASE WHEN {0} = '' THEN 0 ELSE greatest(ceil(length({0}) / 4.5), ceil(len(string_split({0}, ' ')) * 1.25)) END::BIGINT"
_FLAT = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
SQL = {
    "commit_search": _D + _K + f", qs AS (SELECT 'q' AS id, '{QUERY}' AS text)," + embedded("qe", "qs") + "," + embedded("ke", "k") + "," + distances("hit", "qe", "ke", "k") + " SELECT id AS doc_id, round(exp(-distance * distance), 4) AS score FROM hit ORDER BY distance, id LIMIT 10",
    "related_commits": _D + _K + f", qs AS (SELECT doc_id AS id, {_Q} AS text FROM d WHERE kind = 'issue' AND doc_id % 100 = 0)," + embedded("qe", "qs") + "," + embedded("ke", "k") + "," + distances("hit", "qe", "ke", "k") + """
SELECT query_id, id AS doc_id, rank, greatest(0.5, round(1 - (rank - 1) * 0.1, 1))::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM hit) WHERE rank <= 3""",
    "file_history": _D + "SELECT file, position, doc_id FROM (SELECT file, doc_id, row_number() OVER (PARTITION BY file ORDER BY created_at DESC NULLS LAST, doc_id DESC)::INT AS position FROM d WHERE kind = 'commit' AND file IS NOT NULL) WHERE position <= 20",
    "search_queries": _D + f", q AS (SELECT doc_id, {_Q} AS q, regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM d) SELECT doc_id, md5(q) AS query, md5(t) AS description FROM q",
    "acceptance_criteria": _D + r""", a AS (SELECT doc_id, regexp_extract_all(regexp_extract(text || chr(10) || '##', '(?is)##\s*Acceptance Criteria\s*\n(.*?)\n##', 1), '- \[ \] ([^\n\r]+)', 1) AS x, regexp_extract_all(text, '- \[ \] ([^\n\r]+)', 1) AS y FROM d),
b AS (SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE y END AS z FROM a) SELECT doc_id, unnest(range(0, len(z)))::INT AS position, trim(unnest(z)) AS criterion FROM b""",
    "related_by_title": _D + f""", r AS (SELECT lower(title) AS q FROM d WHERE doc_id = {REF}), x AS (SELECT doc_id, ((length(title) - length(replace(lower(title), q, ''))) / length(q) * 20 + (length(body) - length(replace(lower(body), q, ''))) / length(q) * 5 + CASE WHEN lower(title) = q THEN 20 ELSE 0 END)::BIGINT AS relevance FROM d, r WHERE doc_id <> {REF})
SELECT doc_id, relevance FROM x WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 5""",
    "commit_budget": _D + f", t AS (SELECT repository, doc_id, created_at, {_FLAT.format('title')} AS s, {_FLAT.format('concat_ws(chr(10), title, body)')} AS l FROM d WHERE kind = 'commit' AND repository IS NOT NULL), n AS (SELECT repository, doc_id, row_number() OVER w AS r, CASE WHEN row_number() OVER w = 1 THEN {_TOKENS.format('l')} ELSE {_TOKENS.format('s')} END AS tokens, created_at FROM t WINDOW w AS (PARTITION BY repository ORDER BY created_at DESC NULLS LAST, doc_id DESC)),"
    " u AS (SELECT *, sum(tokens) OVER (PARTITION BY repository ORDER BY r)::BIGINT AS used FROM n) SELECT repository, doc_id, tokens, used FROM u WHERE r = 1 OR used + 50 <= 2000",
    "insights": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM p), h AS (SELECT * FROM r WHERE r <= 100 AND exp(-dist * dist) >= 0.25), g AS (SELECT query_id, label, count(*) AS c, min(r) AS r FROM h GROUP BY ALL)
SELECT query_id, sum(c)::BIGINT AS count, (list(label ORDER BY r))[1:10] AS groups FROM g GROUP BY query_id ORDER BY sum(c) DESC, query_id LIMIT 10""",
    "update_warnings": "WITH s AS (SELECT DISTINCT id, repository_path, ts, trigger FROM snapshots WHERE repository_path IS NOT NULL), f AS (SELECT repository_path, max(ts) AS full_ts FROM s WHERE trigger = 'index' GROUP BY 1) SELECT repository_path, count(*) FILTER (trigger = 'update' AND (full_ts IS NULL OR ts > full_ts)) AS updates, count(*) FILTER (trigger = 'update' AND (full_ts IS NULL OR ts > full_ts)) > 10 AS warning FROM s LEFT JOIN f USING (repository_path) GROUP BY 1",
    "issue_links": _D + r""", i AS (SELECT doc_id, repository, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?:#|GH-)(\d+)', 1), lambda x: x::BIGINT), lambda n: n > 0))) AS number, 0 AS pr FROM d),
p AS (SELECT doc_id, repository, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:PR\s*#|pull\s+request\s*#)(\d+)', 1), lambda x: x::BIGINT))) AS number, 1 AS pr FROM d),
u AS (SELECT u.doc_id, u.pr, d.doc_id AS other FROM (FROM i UNION ALL FROM p) u JOIN d ON d.doc_id = u.number AND d.repository = u.repository AND d.doc_id <> u.doc_id)
SELECT doc_id, coalesce(list_sort(list(other) FILTER (pr = 0)), []) AS issues, coalesce(list_sort(list(other) FILTER (pr = 1)), []) AS pulls FROM u GROUP BY doc_id""",
    "relevance_labels": _D + r""", x AS (SELECT doc_id, (len(regexp_extract_all(lower(title), 'review|filter')) * 20 + len(regexp_extract_all(lower(body), 'review|filter')) * 5 + CASE WHEN contains(lower(coalesce(kind, '')), 'review|filter') THEN 10 ELSE 0 END + CASE WHEN contains(lower(coalesce(source, '')), 'review|filter') THEN 10 ELSE 0 END + CASE WHEN lower(title) = 'review|filter' THEN 20 ELSE 0 END)::BIGINT AS relevance FROM d)
SELECT * FROM x WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 20""",
}
