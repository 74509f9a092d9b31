"""Streaming queries over the events table, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.streaming import events as E


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_available(E.windowed_counts(E.read_stream(spark, sf_dir, "events"), "ts", "event_type"), "counts", "update")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = E.read_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return E.run_available(E.distinct_events(doubled.union(E.read_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")), "ts", "event_id"), "distinct").select("event_id", "user_id")


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = E.read_stream(spark, sf_dir, "events").where("event_type = 'error'")
    return E.run_available(E.cooled_alerts(errors, "user_id", "ts", "event_id", 86_400.0), "cooldown").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"))


def stream_balance_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = E.read_stream(spark, sf_dir, "events").withColumn("a", F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")))
    return E.run_available(E.balance_watch(signed, "user_id", "ts", "event_id", "a", 1000.0), "watch").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "balance")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_distinct, stream_cooldown, stream_balance_watch)}

SQL = {
    "stream_daily_counts": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_distinct": "SELECT event_id, user_id FROM events",
    "stream_balance_watch": """WITH RECURSIVE n AS MATERIALIZED (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS balance, 0.0::DOUBLE AS told, false AS says FROM n WHERE i = 1
      UNION ALL SELECT n.user_id, n.i, n.event_id, greatest(0.0, f.balance + n.a), CASE WHEN abs(greatest(0.0, f.balance + n.a) - f.told) >= 1000 THEN greatest(0.0, f.balance + n.a) ELSE f.told END, abs(greatest(0.0, f.balance + n.a) - f.told) >= 1000
        FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
    SELECT user_id, event_id, round(balance, 4) AS balance FROM f WHERE says""",
    "stream_cooldown": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
    o AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
      UNION ALL SELECT o.user_id, (SELECT min(ts) FROM e WHERE e.user_id = o.user_id AND e.ts >= o.ts + INTERVAL 1 DAY) FROM o WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = o.user_id AND e.ts >= o.ts + INTERVAL 1 DAY))
    SELECT e.user_id, e.event_id FROM e JOIN o ON o.user_id = e.user_id AND o.ts = e.ts""",
}
