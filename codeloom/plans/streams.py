"""Streaming queries, replayed over the event and snapshot tables."""

from pyspark.sql import functions as F

from codeloom.streaming import state as S
from codeloom.streaming.replay import read_table_stream, replayed


def _e(spark, d):
    return read_table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rate_limit_stream(spark, d):
    x = replayed(S.rate_limited(_e(spark, d).select("event_id", "ts", "user_id", "event_type"), "event_type", 20.0, 0.02))
    return x.select("event_type", "event_id", "allowed", "retry_after")


def request_correlation_stream(spark, d):
    return replayed(S.correlated(_e(spark, d), "view", "purchase", "user_id", "1 hour")).select("user_id", "start_id", "end_id")


def windowed_stream(spark, d):
    return replayed(S.windowed_counts(_e(spark, d), "event_type"), "update", latest_by=["event_type", "start"]).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def recent_history_stream(spark, d):
    x = replayed(S.recent_history(_e(spark, d).select("event_id", "ts", "event_type"), "event_type", 20), "update", latest_by=["event_type"])
    return x.select("event_type", F.array_sort("event_ids").alias("event_ids"))


def snapshot_stream(spark, d):
    x = read_table_stream(spark, d, "snapshots").select("id", "ts", "repository_path", "total_files")
    return replayed(x, "append", lambda path: S.table_writer(path, ["id"])).dropDuplicates(["id"])


_F = (rate_limit_stream, request_correlation_stream, windowed_stream, recent_history_stream, snapshot_stream)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "rate_limit_stream": """WITH RECURSIVE e AS (SELECT event_type AS k, event_id AS i, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT k, i, t, 1::BIGINT AS r, 19.0::DOUBLE AS left_, true AS ok FROM e WHERE r = 1
UNION ALL SELECT e.k, e.i, e.t, e.r, x.now_ - CASE WHEN x.now_ >= 1 THEN 1 ELSE 0 END, x.now_ >= 1 FROM b JOIN e ON e.k = b.k AND e.r = b.r + 1, LATERAL (SELECT least(20.0::DOUBLE, b.left_ + (e.t - b.t) / 1e6::DOUBLE * 0.02::DOUBLE) AS now_) x)
SELECT k AS event_type, i AS event_id, ok AS allowed, CASE WHEN NOT ok THEN 50 END::BIGINT AS retry_after FROM b""",
    "request_correlation_stream": "SELECT s.user_id, s.event_id AS start_id, e.event_id AS end_id FROM events s JOIN events e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR WHERE s.event_type = 'view' AND e.event_type = 'purchase'",
    "windowed_stream": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS start, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "recent_history_stream": "SELECT event_type, list_sort(list(event_id)) AS event_ids FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY event_type",
    "snapshot_stream": "SELECT DISTINCT id, ts, repository_path, total_files FROM snapshots",
}
