"""Streams run to completion; complete mode gives what the batch query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.queries import Book
from terrace.streaming import events

BOOK = Book()


@BOOK.add("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.tumbling(events.read_stream(spark, sf_dir, "events.parquet"), "ts", "1 hour", ["event_type"], "10 minutes", "value")
    return events.run(rows, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@BOOK.add("""
SELECT w AS window_start, count(*) AS n, round(max(value), 4) AS most FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.sliding(events.read_stream(spark, sf_dir, "events.parquet"), "ts", "2 hours", "1 hour", "10 minutes", "value")
    return events.run(rows, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@BOOK.add("SELECT event_id, user_id FROM events")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.read_stream(spark, sf_dir, "events.parquet")
    return events.run(events.unique(rows, "ts", ["event_id"], "10 minutes").select("event_id", "user_id"), "append")


@BOOK.add("""
SELECT a.event_id, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS""")
def stream_click_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda kind: events.read_stream(spark, sf_dir, "events.parquet").where(F.col("event_type") == kind)
    pairs = events.interval_join(rows("click"), rows("purchase"), "user_id", "ts", "6 HOURS", "1 hour")
    return events.run(pairs.select(F.col("a.event_id"), F.col("b.event_id").alias("bought")), "append")


@BOOK.add("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.running_totals(events.read_stream(spark, sf_dir, "events.parquet").select("user_id", "value"), "user_id", "value")
    return events.run(rows, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")).withColumn("total", F.round("total", 4))


@BOOK.add("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked),
whole AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s)
SELECT * FROM whole WHERE session_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: the sessions that the watermark has closed."""
    rows = events.run(events.sessions(events.read_stream(spark, sf_dir, "events.parquet"), "ts", "30 minutes", ["user_id"], "10 minutes"), "append")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
