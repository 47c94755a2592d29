from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsloom.llm import registry

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")
@pytest.mark.parametrize("kind", ["empty", "nulls", "copies"])
def test_every_query_takes_odd_tables(spark, tmp_path, kind):
    """Empty tables, rows of nulls, and every row three times over."""
    for f in SMALL.glob("*.parquet"):
        x = spark.read.parquet(str(f))
        none = x.limit(5).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in x.schema])
        few = x.limit(40)
        x = {"empty": x.limit(0), "nulls": few.unionByName(none), "copies": few.unionAll(few).unionAll(few)}[kind]
        x.coalesce(1).write.parquet(str(tmp_path / "t"))
        next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / f.name)
        __import__("shutil").rmtree(tmp_path / "t")
    for name, q in registry.queries().items():
        try:
            q(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
        except Exception as err:
            raise AssertionError(name) from err
