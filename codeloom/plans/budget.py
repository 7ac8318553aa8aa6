"""Queries on token budgets, requests and queues."""

from pyspark.sql import functions as F

from codeloom.functions.text import clean_document, document_text, signature_of, slug, snippet_head, truncate_to_tokens
from codeloom.io import table
from codeloom.operators import budget as B
from codeloom.operators import requests as R

BUDGET = 2000


def _ranked(spark, d):
    """Components of each file by their place, as ranked results with the tokens of each form."""
    c = table(spark, d, "components").dropDuplicates(["id"]).filter("file is not null")
    c = c.select("id", "file", "type", "name", "start_line", "signature", "snippet")
    return B.result_forms(B.rank_rows(c, ["file"], [F.col("start_line"), F.col("id")])).drop("signature", "snippet")


def token_budget_cut(spark, d):
    return B.budget_cut(_ranked(spark, d), ["file"], "t_full", BUDGET).select("id", "file", "rank", "used")


def detail_levels(spark, d):
    return _ranked(spark, d).select("id", "rank", B.detail_level(F.col("rank")).alias("level"))


def token_budget_verbose(spark, d):
    forms = {"full": "t_full", "signature": "t_signature", "minimal": "t_minimal"}
    return B.adaptive_cut(_ranked(spark, d), ["file"], forms, BUDGET, 500, 150).select("id", "file", "rank", "level", "tokens")


def token_budget_adaptive(spark, d):
    forms = {"full": "t_full", "signature": "t_signature", "minimal": "t_minimal"}
    return B.adaptive_cut(_ranked(spark, d), ["file"], forms, BUDGET).select("id", "file", "rank", "level", "tokens")


def component_texts(spark, d):
    c = table(spark, d, "components").dropDuplicates(["id"])
    t = document_text(F.col("type"), F.col("name"), F.col("text"))
    texts = {"text": t, "cut": truncate_to_tokens(t, 50), "clean": clean_document(F.col("snippet")), "head": snippet_head(F.col("snippet"), 10), "signature": signature_of(F.col("snippet"))}
    return c.select("id", slug(F.col("name")).alias("slug"), *[F.md5(v).alias(k) for k, v in texts.items()])


def _e(spark, d):
    return table(spark, d, "events")


def request_metrics(spark, d):
    return R.latency(_e(spark, d).withColumn("scope", F.lit("all")), ["scope"])


def request_by_tool(spark, d):
    return R.latency(_e(spark, d), ["event_type"])


def request_health(spark, d):
    return R.outcomes(_e(spark, d))


def health_status(spark, d):
    return R.worst_status(_e(spark, d), "user_id", {"error": 2, "click": 1})


def event_props(spark, d):
    return R.property_stats(_e(spark, d))


def recent_history(spark, d):
    return R.recent(_e(spark, d), "event_type", 20).select("event_type", "age", "event_id")


def request_correlation(spark, d):
    return R.correlate(_e(spark, d), "view", "purchase", "user_id", 3600)


def daily_events(spark, d):
    return R.daily(_e(spark, d))


def task_order(spark, d):
    return R.next_tasks(table(spark, d, "orders"), 3).select("o_custkey", "place", "o_orderkey")


def task_counts(spark, d):
    return R.status_counts(table(spark, d, "orders"), ["F", "O", "P"])


_F = (token_budget_cut, detail_levels, token_budget_adaptive, token_budget_verbose, component_texts, request_metrics, request_by_tool, request_health, health_status, event_props, recent_history, request_correlation, daily_events, task_order, task_counts)
QUERIES = {f.__name__: f for f in _F}


def _tokens(e: str) -> str:
    t = rf"trim(regexp_replace({e}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {t} = '' THEN 0 ELSE greatest(ceil(length({t}) / 4.5), ceil(len(string_split({t}, ' ')) * 1.25)) END::BIGINT"


_CTE = f"""
WITH RECURSIVE c AS (SELECT DISTINCT ON (id) * FROM components),
r0 AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY start_line, id) - 1)::INT AS rank FROM c WHERE file IS NOT NULL),
r1 AS (SELECT id, file, rank, '[' || type || '] ' || name || ' - ' || file || ':' || start_line AS m, nullif(signature, '') AS g, nullif(snippet, '') AS b FROM r0 WHERE rank < 50),
r AS (SELECT id, file, rank, {_tokens("m")} AS tm, {_tokens("concat_ws(chr(10), m, g)")} AS ts, {_tokens("concat_ws(chr(10), concat_ws(chr(10), m, g), b)")} AS tf FROM r1)
"""
_LAT = "SELECT {0} count(*) AS requests, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL {1}"
SQL = {
    "token_budget_cut": _CTE + f", u AS (SELECT *, sum(tf) OVER (PARTITION BY file ORDER BY rank) AS used FROM r), s AS (SELECT *, max(CASE WHEN used > {BUDGET} AND rank > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY rank) AS s FROM u) SELECT id, file, rank, used::BIGINT AS used FROM s WHERE s = 0",
    "detail_levels": _CTE + "SELECT id, rank, CASE WHEN rank < 3 THEN 'full' WHEN rank < 7 THEN 'signature' ELSE 'minimal' END AS level FROM r",
    "token_budget_adaptive": _CTE
    + f""", w AS (
SELECT id, file, rank, used, level, tokens FROM (SELECT *, CASE WHEN {BUDGET} > 300 THEN 'full' WHEN {BUDGET} > 100 THEN 'signature' ELSE 'minimal' END AS level, CASE WHEN {BUDGET} > 300 THEN tf WHEN {BUDGET} > 100 THEN ts ELSE tm END AS tokens, CASE WHEN {BUDGET} > 300 THEN tf WHEN {BUDGET} > 100 THEN ts ELSE tm END AS used FROM r WHERE rank = 0)
UNION ALL
SELECT id, file, rank, prior + tokens, level, tokens FROM (SELECT r.id, r.file, r.rank, w.used AS prior,
 CASE WHEN r.rank < 3 AND {BUDGET} - w.used > 300 THEN 'full' WHEN r.rank < 7 AND {BUDGET} - w.used > 100 THEN 'signature' ELSE 'minimal' END AS level,
 CASE WHEN r.rank < 3 AND {BUDGET} - w.used > 300 THEN r.tf WHEN r.rank < 7 AND {BUDGET} - w.used > 100 THEN r.ts ELSE r.tm END AS tokens
 FROM w JOIN r ON r.file = w.file AND r.rank = w.rank + 1) WHERE prior + tokens <= {BUDGET})
SELECT id, file, rank, level, tokens FROM w""",
    "component_texts": _CTE + r""", t AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN coalesce(name, '') <> '' THEN concat_ws(': ', type, name) END, nullif(text, '')) AS t FROM c)
SELECT id, md5(t) AS text, md5(CASE WHEN """ + _tokens("t") + r""" <= 50 THEN t ELSE substr(t, 1, 197) || '...' END) AS cut,
md5(trim(regexp_replace(regexp_replace(snippet, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS clean,
md5(CASE WHEN len(string_split(snippet, chr(10))) <= 10 THEN snippet ELSE array_to_string(string_split(snippet, chr(10))[1:10], chr(10)) || chr(10) || '// ... ' || (len(string_split(snippet, chr(10))) - 10) || ' more lines' END) AS head,
regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, md5(trim(string_split(snippet, '{')[1], ' ')) AS signature FROM t""",
    "request_metrics": _LAT.format("'all' AS scope,", ""),
    "request_by_tool": _LAT.format("event_type,", "GROUP BY event_type"),
    "request_health": "SELECT *, CASE WHEN errors / requests > 0.1 THEN 'unhealthy' WHEN errors > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*) * 100, 2) AS error_percent FROM events GROUP BY user_id)",
    "event_props": "SELECT event_type, count(k) AS n, count(DISTINCT k) AS distinct_k, sum(k)::BIGINT AS sum_k FROM (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) GROUP BY event_type",
    "recent_history": "SELECT event_type, age, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS age FROM events) WHERE age <= 20",
    "request_correlation": """SELECT event_id, user_id, CASE WHEN us <= 3600000000 THEN e.event_id END AS end_id, CASE WHEN us <= 3600000000 THEN round(us / 1e6, 3) END AS seconds FROM (
SELECT *, epoch_us(e.ts) - epoch_us(ts) AS us FROM (SELECT event_id, user_id, event_type, ts, first(CASE WHEN event_type = 'purchase' THEN {'ts': ts, 'event_id': event_id} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e
FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'view')""",
    "daily_events": "SELECT *, events - lag(events) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)",
    "task_order": "SELECT o_custkey, place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS place FROM orders WHERE o_orderstatus = 'O') WHERE place <= 3",
    "task_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
}

SQL["token_budget_verbose"] = SQL["token_budget_adaptive"].replace(" > 300 ", " > 500 ").replace(" > 100 ", " > 150 ")
SQL["health_status"] = "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'unhealthy' WHEN bool_or(event_type = 'click') THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id"
