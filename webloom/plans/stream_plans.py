"""Queries that run a stream over the events table and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.plans.base import query
from webloom.streaming import fetch_log


@query(
    """SELECT CAST(user_id AS VARCHAR) AS host, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id)),
  lambda m, e: CASE WHEN e < 0 THEN least(32.0, m * 2) ELSE greatest(1.0, m / 1.15) END), 6) AS multiplier FROM events GROUP BY user_id"""
)
def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", fetch_log.STATE_STORE)
    log = fetch_log.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    path = session.place(spark, "throttle")
    fetch_log.drain_updates(fetch_log.throttle(log), path)
    rows = spark.read.schema("host string, multiplier double, n long, batch int").parquet(path)
    return rows.groupBy("host").agg(F.round(F.max_by("multiplier", "batch"), 6).alias("multiplier"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def outcome_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", fetch_log.STATE_STORE)
    path = session.place(spark, "windows")
    fetch_log.drain(fetch_log.outcome_counts(fetch_log.events(spark, sf_dir).select("ts", "event_id", "event_type")), path)
    rows = spark.read.schema("start timestamp, event_type string, n long").parquet(path)
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
