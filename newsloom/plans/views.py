"""Views that bind the operators' inputs to the tables of a data folder, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import table


def learning(spark: SparkSession, d: str) -> DataFrame:
    """Scored stories with outcomes: one row for each line item."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.to_date("l_shipdate").alias("run_date"), F.col("l_orderkey").cast("string").alias("event_id"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("story_id"),
        F.col("l_suppkey").cast("string").alias("source"), F.col("l_returnflag").alias("category"), (F.col("l_linestatus") == "F").alias("selected"),
        (2 * F.col("l_quantity")).alias("score"), (10 * F.col("l_discount")).alias("outcome"), (F.col("l_linenumber") != 7).alias("mature"),
    )


LEARNING = """learning_v AS (SELECT CAST(l_shipdate AS DATE) AS run_date, CAST(l_orderkey AS VARCHAR) AS event_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS story_id, CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS category,
  l_linestatus = 'F' AS selected, 2 * l_quantity AS score, 10 * l_discount AS outcome, l_linenumber <> 7 AS mature FROM lineitem)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Daily runs: one row for each sighting of an event key on a day."""
    x = table(spark, d, "events")
    return x.select(F.to_date("ts").alias("run_date"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("event_key"), "event_type", "value")


RUNS = "runs_v AS (SELECT CAST(ts AS DATE) AS run_date, concat_ws(':', user_id, event_type) AS event_key, event_type, value FROM events)"
