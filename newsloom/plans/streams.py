"""Streams worked off once over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.streaming import feeds as S


def daily(spark, d):
    out = S.run_once(S.daily_counts(S.events(spark, f"{d}/events.parquet"), "ts", ["event_type"]), "sm5", "complete")
    return out.where(F.col("_batch") == out.agg(F.max("_batch")).first()[0]).drop("_batch")


def first_seen(spark, d):
    x = S.fresh(S.events(spark, f"{d}/events.parquet"), "ts").withColumn("event_key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return S.run_once(S.first_of_key(x, ["event_key"]).select("event_key"), "sm2", "append").drop("_batch")


def lifecycle(spark, d):
    x = S.events(spark, f"{d}/events.parquet").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("event_key"), "ts", "value")
    out = S.run_once(S.lifecycle(x, "event_key", "value"), "sm6", "update")
    return out.groupBy("event_key").agg(F.max_by("status", "_batch").alias("status"), F.max("seen").alias("seen"), F.round(F.max("greatest"), 6).alias("greatest"))


QUERIES = {"sm2_first_of_key": first_seen, "sm5_daily_counts": daily, "sm6_lifecycle": lifecycle}
SQL = {
    "sm2_first_of_key": "SELECT DISTINCT concat_ws(':', user_id, event_type) AS event_key FROM events",
    "sm5_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sm6_lifecycle": """SELECT event_key, CASE WHEN coalesce(bool_or(value - prev >= 8), false) THEN 'ESCALATING' WHEN count(*) > 1 THEN 'DEVELOPING' ELSE 'NEW' END AS status, count(*) AS seen, round(max(value), 6) AS greatest FROM (
  SELECT event_key, value, max(value) OVER (PARTITION BY event_key ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT concat_ws(':', user_id, event_type) AS event_key, ts, value FROM events) e) t GROUP BY event_key""",
}
