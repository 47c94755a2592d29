"""Session helpers: shared folder, table loading, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or on one machine (tests) a new local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jsc.get() if jsc.isDefined() else ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. What was staged is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(clear_staged, spark)
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables staged so far; results not yet computed from them are lost."""
    while _STAGED:
        path = _STAGED.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session is gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast of an object of this package as bytes that pickle.loads turns back where the package is not installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast df only after counting it (at most max_rows rows); beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
