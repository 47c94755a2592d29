"""Readers and writers: CSV, JSON, feed XML, binary artifacts, keyed appends and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.errors import AnalysisException

FEED_ENTRY = "title STRING, link STRING, guid STRING, pubDate STRING, description STRING, category STRING"


def _or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header by an explicit schema; a missing path is an empty table, malformed values are null."""
    schema = T.StructType.fromDDL(ddl)
    return _or_empty(spark, schema, lambda: spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"'))


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored Parquet table by an explicit schema; a missing path is an empty table."""
    schema = T.StructType.fromDDL(ddl)
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON documents, one each file, with the file they come from."""
    schema = T.StructType.fromDDL(ddl)
    return _or_empty(spark, T.StructType.fromDDL(ddl + ", file STRING"), lambda: spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.input_file_name()))


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", ddl: str = FEED_ENTRY, limit: int | None = None) -> DataFrame:
    """Entries of landed RSS files that have a title and a link, with the file they come from; of each file the first `limit`."""
    x = spark.read.format("xml").option("rowTag", row_tag).schema(T.StructType.fromDDL(ddl)).load(path)
    x = x.where("trim(title) != '' and trim(link) != ''").withColumns({"file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    if limit is not None:
        x = x.withColumn("_k", F.row_number().over(W.partitionBy("file").orderBy("_at"))).where(F.col("_k") <= limit).drop("_k")
    return x.drop("_at")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def schema_issues(df: DataFrame, ddl: str) -> list[str]:
    """What keeps df from the schema: missing:, type: and extra: with column names."""
    want, have = {f.name: f.dataType for f in T.StructType.fromDDL(ddl)}, {f.name: f.dataType for f in df.schema}
    return [f"missing:{c}" for c in want if c not in have] + [f"type:{c}" for c in want if c in have and have[c] != want[c]] + [f"extra:{c}" for c in have if c not in want]


def reconciled(df: DataFrame, ddl: str) -> DataFrame:
    """df in the schema's columns and order: unknown columns dropped, absent ones null, types cast where possible."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in T.StructType.fromDDL(ddl)])


def append_absent(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows of new whose keys are not in the Parquet table at path yet (first of equal ones); returns how many."""
    spark = new.sparkSession
    new = new.dropDuplicates(keys)
    try:
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    from newsloom.session import stage

    fresh = stage(new, "append")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df holds rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
