"""Structured Streaming counterparts of the daily runs: late data, keyed dedup, windows and a lifecycle per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; future stamps beyond six hours of the clock are left to the watermark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():  # a stream reads folders
        stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    else:
        stream = spark.readStream.schema(EVENTS).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def fresh(stream: DataFrame, at: str, late: str = "72 hours") -> DataFrame:
    return stream.withWatermark(at, late)


def first_of_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, at: str, by: list[str]) -> DataFrame:
    g = stream.groupBy(F.window(at, "1 day"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *by, "n", "total")


def lifecycle(stream: DataFrame, key: str, value: str, rise: float = 8.0) -> DataFrame:
    """key, status, seen, greatest: NEW, DEVELOPING from the second sighting, ESCALATING once the value rose by rise (kept)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, greatest, rising = state.get if state.exists else (0, None, False)
        for pdf in batches:
            for v in pdf.sort_values(["ts", value], na_position="last")[value]:
                rising = rising or (greatest is not None and v == v and v - greatest >= rise)
                greatest = greatest if v != v else v if greatest is None else max(greatest, v)
                seen += 1
        state.update((seen, greatest, rising))
        yield pd.DataFrame({key: [k[0]], "status": ["ESCALATING" if rising else "DEVELOPING" if seen > 1 else "NEW"], "seen": [seen], "greatest": [greatest]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, status string, seen long, greatest double", "seen long, greatest double, rising boolean", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Work off what is there and give the result as a table of the shared folder (append), or of the last state (complete, update)."""
    import uuid

    from newsloom.session import shared_dir

    base = f"{shared_dir(stream.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{base}/out")
