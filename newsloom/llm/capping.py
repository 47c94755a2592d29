"""Problem 2: at most so many records of each contributor, the best kept.

The order of a contributor's records is (worse quality later, non-finite quality last, then larger id later). Histograms of it are
counts per contributor and bin, so they merge by adding; a cumulative count names the borderline bin, in which the cap
falls. Bins better than it stay, worse ones go. Where more than MOST records are left in a borderline bin, the bin
is cut again between its own smallest and largest quality, however skewed they are, and once they all tie, by id; what is left of at
most MOST records a contributor is ranked. No step sorts more of a hot contributor than that.

Defined results: null, NaN and infinite quality count lowest (they tie, the smaller id stays); a null
contributor is left alone; repeated ids are ranked one after another; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from newsloom.session import broadcast_if_small, stage, table

BINS = 1024
MOST = 10_000  # records of one contributor that are ranked
SMALL = 100_000


def _finite(q: Column) -> Column:
    return F.when(q.isNotNull() & ~F.isnan(q) & (F.abs(q) != F.lit(float("inf"))), q)


def _cutoff(hist: DataFrame) -> DataFrame:
    """who, cut, left: the first bin at which the cumulative count of a contributor (who, bin, room, n) passes its room, and the room left in it."""
    w = W.partitionBy("who").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    x = hist.withColumn("upto", F.sum("n").over(w)).where("upto > room")
    return x.groupBy("who").agg(F.min(F.struct("bin", (F.col("room") - F.col("upto") + F.col("n")).alias("left"))).alias("c")).select("who", F.col("c.bin").alias("cut"), F.col("c.left").alias("left"))


def over_cap(df: DataFrame, who: str, quality: str, row_id: str, cap: int, bins: int = BINS, most: int = MOST) -> DataFrame:
    """row_id of each record beyond the cap of its contributor."""
    x = df.where(F.col(who).isNotNull()).select(F.col(who).alias("who"), F.coalesce(-_finite(F.col(quality).cast("double")), F.lit(float("inf"))).alias("worse"), F.col(row_id).alias("id"))
    heavy = x.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("who", F.lit(cap).cast("bigint").alias("room"))
    x = stage(x.join(broadcast_if_small(heavy, SMALL), "who"), "p2-heavy")
    out = []
    number = {"worse": F.when(F.col("worse") != float("inf"), F.col("worse") / 2), "id": F.col("id").cast("decimal(38,0)")}  # halves: differences stay finite
    for key in ("worse", "id"):
        while True:
            of = x.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.min(number[key]).alias("lo"), F.max(number[key]).alias("hi"), F.count_if(F.col("worse") == float("inf")).alias("infinite"))
            of = stage(of, "p2-edges")
            tied = (F.col("lo").isNull() | (F.col("lo") == F.col("hi")) & ((F.col("infinite") == 0) | F.lit(key == "id")))
            open_ = of.where((F.col("n") > most) & ~tied)
            if not open_.limit(1).count():
                break
            y = x.join(broadcast_if_small(open_.select("who", "lo", "hi"), SMALL), "who", "left")
            at = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.least(F.floor((number[key] - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
            y = y.withColumn("bin", F.when(F.col("hi").isNotNull(), F.when(number[key].isNull(), F.lit(bins)).otherwise(at.cast("int"))))
            cut = _cutoff(y.where("bin is not null").groupBy("who", "bin", "room").agg(F.count(F.lit(1)).alias("n")))
            y = stage(y.join(broadcast_if_small(cut, SMALL), "who", "left").drop("lo", "hi"), "p2-cut")
            out.append(y.where("bin > cut").select("id"))
            x = y.where("bin is null or bin = cut").select("who", "worse", "id", F.coalesce("left", "room").alias("room"))
    # rows that agree in all are told apart by counting
    x = x.groupBy("who", "worse", "id", "room").agg(F.count(F.lit(1)).alias("n"))
    last = x.withColumn("upto", F.sum("n").over(W.partitionBy("who").orderBy("worse", "id").rowsBetween(W.unboundedPreceding, 0))).where("upto > room")
    gone = last.select(F.explode(F.array_repeat("id", F.least("n", F.col("upto") - F.col("room")).cast("int"))).alias("id"))
    for y in out:
        gone = gone.unionAll(y)
    return gone.select(F.col("id").alias(row_id))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    cap = a.count() * 3 // 100
    return over_cap(a, "source", "importance", "row_id", cap)


def p2_kept_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source before and after the cap."""
    a = table(spark, d, "articles").select("row_id", "source", "importance")
    gone = p2_found(spark, d).withColumn("gone", F.lit(1))
    return a.join(gone, "row_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("gone", F.lit(0))).alias("n_dropped"), F.max(F.when(F.col("gone").isNull(), 1).otherwise(0)).alias("any_kept"))


QUERIES = {"p2_found": p2_found, "p2_kept_shares": p2_kept_shares}
_P2 = """SELECT row_id FROM (
  SELECT row_id, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN importance IS NULL OR isnan(importance) OR isinf(importance) THEN 1 ELSE 0 END,
    CASE WHEN importance IS NULL OR isnan(importance) OR isinf(importance) THEN 0 ELSE -importance END, row_id) AS r
  FROM articles WHERE source IS NOT NULL) t
WHERE r > (SELECT count(*) * 3 // 100 FROM articles)"""
SQL = {
    "p2_found": _P2,
    "p2_kept_shares": f"""SELECT a.source, count(*) AS n_rows, CAST(sum(CASE WHEN g.row_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped,
  max(CASE WHEN g.row_id IS NULL THEN 1 ELSE 0 END) AS any_kept
FROM articles a LEFT JOIN ({_P2}) g ON g.row_id = a.row_id GROUP BY a.source""",
}
