"""Queries on issues, commits and other documents."""

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.io import table
from codeloom.operators import texts as X

QUERY = "filter"


def _d(spark, d):
    return table(spark, d, "documents")


def issue_refs(spark, d):
    return X.references(_d(spark, d)).select("doc_id", "issues", "others")


def referenced_numbers(spark, d):
    return X.referenced_numbers(_d(spark, d))


def issue_context(spark, d):
    docs = _d(spark, d)
    return X.related(docs, docs.select(F.col("doc_id").alias("number"), "doc_id", "repository"))


def mentions_paths(spark, d):
    x = X.once(_d(spark, d)).select("doc_id", T.file_paths(F.col("text")).alias("paths"), T.mentions(F.col("text")).alias("mentions"))
    return x.filter((F.size("paths") > 0) | (F.size("mentions") > 0))


def keywords(spark, d):
    return X.keywords(_d(spark, d), 10)


def topic_words(spark, d):
    return X.topic_words(_d(spark, d), "repository", 10)


def relevance_score(spark, d):
    return X.ranked(_d(spark, d), QUERY, 20).select("doc_id", "relevance")


def text_match(spark, d):
    return X.matching(_d(spark, d), QUERY).select("doc_id")


def commits(spark, d):
    return X.commits(_d(spark, d))


def commit_documents(spark, d):
    return X.commit_documents(_d(spark, d)).select("doc_id", F.md5("embed_text").alias("digest"))


def document_counts(spark, d):
    return X.counts_by(_d(spark, d)).drop("level")


def checkboxes(spark, d):
    return X.checkboxes(_d(spark, d))


def late_documents(spark, d):
    return X.late(_d(spark, d), 24)


def token_estimate(spark, d):
    return X.once(_d(spark, d)).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def slugs(spark, d):
    x = X.title_and_body(X.once(_d(spark, d)))
    return x.select("doc_id", T.slug(F.col("title")).alias("slug"), T.truncate(F.col("title"), 40).alias("short"))


def storage_keys(spark, d):
    x = _d(spark, d).select("repository").distinct()
    u = F.concat(F.lit("git@code.example.org:Team/"), "repository", F.lit(".git"))
    return x.select("repository", T.remote_key(u).alias("key"), T.storage_key(u).alias("folder"))


_F = (issue_refs, referenced_numbers, issue_context, mentions_paths, keywords, topic_words, relevance_score, text_match, commits, commit_documents, document_counts, checkboxes, late_documents, token_estimate, slugs, storage_keys)
QUERIES = {f.__name__: f for f in _F}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"
_CTE = r"""
WITH d AS (SELECT DISTINCT ON (doc_id) *, split_part(text, chr(10), 1) AS title, trim(regexp_replace(text, '^[^\n]*\n?', '')) AS body FROM documents),
r AS (SELECT doc_id, repository, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?:#|GH-)(\d+)', 1), lambda x: x::BIGINT), lambda n: n > 0))) AS issues FROM d),
u AS (SELECT doc_id, repository, unnest(issues) AS number FROM r)
"""
_RELEVANCE = f"((length(title) - length(replace(lower(title), '{QUERY}', ''))) / {len(QUERY)} * 20 + (length(body) - length(replace(lower(body), '{QUERY}', ''))) / {len(QUERY)} * 5 + CASE WHEN lower(title) = '{QUERY}' THEN 20 ELSE 0 END)::BIGINT"
SQL = {
    "issue_refs": _CTE + "SELECT doc_id, issues, list_transform(list_distinct(regexp_extract_all(text, '#(\\d+)', 1)), lambda x: x::BIGINT) AS others FROM r JOIN d USING (doc_id) WHERE len(issues) > 0",
    "referenced_numbers": _CTE + "SELECT repository, number, count(*) AS documents FROM u GROUP BY ALL",
    "issue_context": _CTE + "SELECT u.doc_id, list(d.doc_id ORDER BY number, d.doc_id) AS related FROM u JOIN d ON d.doc_id = number AND d.repository IS NOT DISTINCT FROM u.repository WHERE d.repository IS NOT NULL AND d.doc_id <> u.doc_id GROUP BY u.doc_id",
    "mentions_paths": _CTE + r""", e AS (SELECT '\.(?:tsx?|jsx?|py|go|rs|java|md)' AS x), q AS (SELECT doc_id, list_concat(regexp_extract_all(text, '(?i)```\w*\n(?://|#)\s*([^\n]+' || x || ')', 1), list_concat(regexp_extract_all(text, '(?i)`([^\n`]+' || x || ')`', 1),
list_concat(list_filter(string_split(replace(replace(replace(replace(text, chr(9), ' '), chr(13), ' '), chr(10), ' '), chr(11), ' '), ' '), lambda w: regexp_full_match(w, '[A-Za-z0-9_./-]+' || x)), regexp_extract_all(text, '(?i)((?:src|packages|libs?|tests?)/[A-Za-z0-9_./-]+' || x || ')', 1)))) AS p,
regexp_extract_all(regexp_replace(text, '@[A-Za-z0-9][-A-Za-z0-9]*\.', '.', 'g'), '(?:^|[^A-Za-z0-9])@([A-Za-z0-9][-A-Za-z0-9]*)', 1) AS m FROM d, e),
z AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(p, lambda w: trim(trim(w), '`''"')), lambda w: length(w) > 3 AND length(w) < 200))) AS paths, list_sort(list_distinct(m)) AS mentions FROM q)
SELECT * FROM z WHERE len(paths) > 0 OR len(mentions) > 0""",
    "keywords": _CTE + f""", w AS (SELECT doc_id, {_WORDS} AS w FROM d), x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM w),
g AS (SELECT doc_id, word, count(*) AS times, min(pos) AS first FROM x GROUP BY ALL)
SELECT doc_id, rank, word, times FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, first)::INT AS rank FROM g) WHERE rank <= 10""",
    "topic_words": _CTE + f""", x AS (SELECT DISTINCT doc_id, repository, unnest({_WORDS}) AS word FROM d), g AS (SELECT repository, word, count(*) AS documents FROM x GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY documents DESC, word)::INT AS rank FROM g) WHERE rank <= 10""",
    "relevance_score": _CTE + f"SELECT doc_id, {_RELEVANCE} AS relevance FROM d WHERE {_RELEVANCE} > 0 ORDER BY relevance DESC, doc_id LIMIT 20",
    "text_match": _CTE + f"SELECT doc_id FROM d WHERE contains(lower(concat_ws(' ', text, kind, repository, doc_id::VARCHAR, '#' || doc_id)), '{QUERY}')",
    "commits": _CTE + r"""SELECT doc_id, nullif(regexp_extract(title, '^(\w+)(?:\(([^)]*)\))?(!)?: (.*)$', 1), '') AS commit_kind, nullif(regexp_extract(title, '^(\w+)(?:\(([^)]*)\))?(!)?: (.*)$', 2), '') AS scope,
regexp_extract(title, '^(\w+)(?:\(([^)]*)\))?(!)?: (.*)$', 3) = '!' AS breaking, coalesce(nullif(regexp_extract(title, '^(\w+)(?:\(([^)]*)\))?(!)?: (.*)$', 4), ''), title) AS subject, body FROM d WHERE kind = 'commit'""",
    "commit_documents": _CTE + "SELECT doc_id, md5(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(body, ''), nullif(file, ''))) AS digest FROM d WHERE kind = 'commit'",
    "document_counts": _CTE + "SELECT kind, source, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM d GROUP BY ROLLUP (kind, source)",
    "checkboxes": _CTE + r"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*[-*] \[[xX]\]'))::INT AS done, len(regexp_extract_all(text, '(?m)^\s*[-*] \[ \]'))::INT AS open FROM d) WHERE done + open > 0",
    "late_documents": _CTE + "SELECT kind, count(*) AS documents, count(*) FILTER (floor(epoch(ingested_at)) - floor(epoch(created_at)) > 86400) AS late FROM d GROUP BY kind",
    "token_estimate": _CTE + r", t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM d) SELECT doc_id, CASE WHEN t = '' OR t IS NULL THEN 0 ELSE greatest(ceil(length(t) / 4.5), ceil(len(string_split(t, ' ')) * 1.25)) END::BIGINT AS tokens FROM t",
    "slugs": _CTE + "SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN length(title) <= 40 THEN title ELSE substr(title, 1, 37) || '...' END AS short FROM d",
    "storage_keys": "SELECT DISTINCT repository, 'team/' || lower(repository) AS key, substr(md5('team/' || lower(repository)), 1, 8) AS folder FROM documents",
}
