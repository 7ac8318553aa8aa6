"""Request latencies, event properties, recent history and ordered queues over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.io import running_total


def latency(events: DataFrame, by: list[str], duration: str = "value") -> DataFrame:
    """by, requests, mean, p50, p95, p99. Percentiles are taken over (value, count) rows, counted before the shuffle and
    added up range by range, so no task holds all values of a group."""
    per = events.filter(F.col(duration).isNotNull()).groupBy(*by, duration).agg(F.count("*").alias("n"))
    c = running_total(per, by, [duration], "n")
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col(duration))).alias(f"p{round(p * 100)}")
    return c.groupBy(*by).agg(F.sum("n").alias("requests"), F.round(F.sum(F.col(duration) * F.col("n")) / F.sum("n"), 4).alias("mean"), at(0.5), at(0.95), at(0.99))


def outcomes(events: DataFrame) -> DataFrame:
    """user_id, requests, errors, error_percent, health: error above a tenth is unhealthy, any is degraded."""
    x = events.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    share = F.col("errors") / F.col("requests")
    return x.withColumn("error_percent", F.round(share * 100, 2)).withColumn("health", F.when(share > 0.1, "unhealthy").when(share > 0, "degraded").otherwise("healthy"))


def worst_status(events: DataFrame, by: str, severity: dict[str, int]) -> DataFrame:
    """by, status: the worst of a group's checks. severity maps kinds of events to 2 (error: unhealthy) or 1 (warning:
    degraded); all others are 0."""
    n = F.coalesce(F.max(F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])[F.col("event_type")]), F.lit(0)) if severity else F.lit(0)
    x = events.groupBy(by).agg(n.alias("n"))
    return x.select(by, F.when(F.col("n") >= 2, "unhealthy").when(F.col("n") == 1, "degraded").otherwise("healthy").alias("status"))


def properties(events: DataFrame) -> DataFrame:
    """event_id, k: from the JSON properties; malformed JSON gives null."""
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def property_stats(events: DataFrame) -> DataFrame:
    x = properties(events).join(events.select("event_id", "event_type"), "event_id")
    return x.groupBy("event_type").agg(F.count("k").alias("n"), F.countDistinct("k").alias("distinct_k"), F.sum("k").alias("sum_k"))


def recent(events: DataFrame, by: str, n: int) -> DataFrame:
    """The last n events of each group, oldest first, and their mean: a bounded history."""
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def correlate(events: DataFrame, start: str, end: str, by: str, within_seconds: int) -> DataFrame:
    """Each start with the first end of the same key that follows it within the time, and the seconds between; starts
    without one stay open (null). Time is cut into slots of that length; an end is put into its own slot and the one
    before, so a window holds one key's events of two slots and a hot key is spread over its slots."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    x = events.filter(F.col("event_type").isin(start, end) & F.col("ts").isNotNull()).select("event_id", by, "ts", "event_type", micros.alias("us"))
    slot = F.floor(F.col("us") / (within_seconds * 1_000_000))
    slots = F.when(F.col("event_type") == end, F.array(slot, slot - 1)).otherwise(F.array(slot))
    x = x.withColumn("slot", F.explode(slots))
    later = Window.partitionBy(by, "slot").orderBy("us", "event_id").rowsBetween(1, Window.unboundedFollowing)
    e = F.first(F.when(F.col("event_type") == end, F.struct("us", "event_id")), ignorenulls=True).over(later)
    x = x.withColumn("e", e).filter(F.col("event_type") == start)
    gap = F.col("e.us") - F.col("us")
    near = gap <= within_seconds * 1_000_000
    return x.select("event_id", by, F.when(near, F.col("e.event_id")).alias("end_id"), F.when(near, F.round(gap / 1e6, 3)).alias("seconds"))


def daily(events: DataFrame) -> DataFrame:
    """day, event_type, events, users: with the change against the day before."""
    x = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    w = Window.partitionBy("event_type").orderBy("day")
    return x.withColumn("delta", F.col("events") - F.lag("events").over(w))


def next_tasks(orders: DataFrame, n: int) -> DataFrame:
    """The first n open orders of each customer's queue by priority and date: priority names begin with their rank."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return orders.filter("o_orderstatus = 'O'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def status_counts(orders: DataFrame, statuses: list[str]) -> DataFrame:
    """priority and one count per status, zeros included."""
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", statuses).count().na.fill(0)
