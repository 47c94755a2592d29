"""Outcome statistics: shrunk reliabilities, backtests, threshold sweeps, calibration and drift.

Inputs carry source, category, score, outcome (0 to 1), selected and mature (the outcome is final). Null scores and outcomes
are left out of the figures they would enter; groups of null source or category are groups of their own.
Every operator aggregates before it shuffles; what is joined back is one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

POSITIVE = 0.5


def shrunk(total: Column, n: Column, prior: float, mean: Column | float) -> Column:
    """Mean of n values pulled towards a mean held by prior further ones."""
    return (total + prior * mean) / (n + prior)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def profile(rows: DataFrame, prior: float = 4.0) -> DataFrame:
    """dimension, value, n, reliability of each source and each category over selected mature rows, in one pass of grouping sets."""
    x = rows.where("selected and mature and outcome is not null")
    g = x.groupingSets([["source"], ["category"]], "source", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("total"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 1, "source").otherwise("category")
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), shrunk(F.col("total"), F.col("n"), prior, 0.5)))
    return g.select(dim.alias("dimension"), F.when(F.col("gid") == 1, F.col("source")).otherwise(F.col("category")).alias("value"), "n", F.round(r, 6).alias("reliability"))


def metrics(rows: DataFrame, success: float = 0.45) -> DataFrame:
    """One row: rows, selected rows, share of successes among the selected, of failures among them, and of positives missed."""
    x = rows.where("mature and outcome is not null")
    chosen, hit = F.col("selected"), F.col("outcome") >= success
    n = F.count_if(chosen)
    return x.agg(
        F.count(F.lit(1)).alias("n_rows"), n.alias("n_selected"), F.round(_ratio(F.count_if(chosen & hit), n), 6).alias("success_rate"),
        F.round(_ratio(F.count_if(chosen & (F.col("outcome") == 0)), n), 6).alias("false_positive_rate"),
        F.round(_ratio(F.count_if(~chosen & hit), F.count_if(hit)), 6).alias("miss_rate"),
    )


def confusion(rows: DataFrame, thresholds: list[float], by: list[str] | None = None, beta: float = 1.0) -> DataFrame:
    """Per threshold (and group): tp, fp, fn, tn, precision, recall, f1 of score >= threshold against outcome >= 0.5.

    The input is first reduced to counts per distinct score, so the sweep does not multiply the rows.
    """
    by = by or []
    cells = rows.where("outcome is not null and score is not null").groupBy(*by, "score").agg(F.count_if(F.col("outcome") >= POSITIVE).alias("p"), F.count_if(F.col("outcome") < POSITIVE).alias("n"))
    x = cells.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    over = F.col("score") >= F.col("threshold")
    s = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = x.groupBy(*by, "threshold").agg(s("p", over).alias("tp"), s("n", over).alias("fp"), s("p", ~over).alias("fn"), s("n", ~over).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": F.round(_ratio(tp, tp + fp), 6), "recall": F.round(_ratio(tp, tp + fn), 6), "f1": F.round(f1(tp, fp, fn), 6)})


def best_threshold(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """The threshold of greatest f1, then precision, then recall, then the smaller one."""
    x = confusion(rows, thresholds)
    return x.withColumn("r", F.row_number().over(W.orderBy(F.desc("f1"), F.desc("precision"), F.desc("recall"), "threshold"))).where("r = 1").drop("r")


def score_buckets(rows: DataFrame) -> DataFrame:
    """Rows, mean outcome and mean absolute error in the score bands 0, 50, 70, 85."""
    band = F.when(F.col("score") < 50, "00-50").when(F.col("score") < 70, "50-70").when(F.col("score") < 85, "70-85").otherwise("85-100")
    x = rows.where("score is not null and outcome is not null")
    return x.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("outcome"), 6).alias("mean_outcome"), F.round(F.avg(F.abs(F.col("score") / 100 - F.col("outcome"))), 6).alias("mae"))


def bucket_metrics(rows: DataFrame) -> DataFrame:
    """Overall, per category, per source and per score band in one pass of grouping sets."""
    x = rows.where("mature and outcome is not null").withColumn("band", F.when(F.col("score") < 50, "low").when(F.col("score") < 75, "mid").otherwise("high"))
    g = x.groupingSets([[], ["category"], ["source"], ["band"]], "category", "source", "band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"), F.round(F.avg("outcome"), 6).alias("mean_outcome"), F.grouping_id().alias("gid")
    )
    dim = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "source").otherwise("band")
    return g.select(dim.alias("dimension"), F.coalesce("category", "source", "band", F.lit("all")).alias("value"), "n", "n_selected", "mean_outcome")


def event_level(rows: DataFrame, threshold: float = 50.0) -> DataFrame:
    """One row: confusion over events (best score and best outcome of each) and the share of rows that repeat an event."""
    key = F.coalesce(F.nullif(F.trim("event_id"), F.lit("")), F.nullif(F.trim("story_id"), F.lit("")))
    e = rows.where("outcome is not null and score is not null").groupBy(key.alias("key")).agg(F.max("score").alias("score"), F.max("outcome").alias("outcome"), F.count(F.lit(1)).alias("n"))
    over, pos = F.col("score") >= threshold, F.col("outcome") >= POSITIVE
    return e.agg(
        F.count(F.lit(1)).alias("events"), F.sum("n").alias("n_rows"), F.count_if(over & pos).alias("tp"), F.count_if(over & ~pos).alias("fp"), F.count_if(~over & pos).alias("fn"),
        F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("repeat_share"),
    )


def calibration_bins(rows: DataFrame, full: int = 20) -> DataFrame:
    """Observed rate of each decile of the score, in percent; sparse bins lean on a tenth of the bin's number."""
    b = F.floor(F.least(F.lit(99.0), F.greatest(F.lit(0.0), F.col("score"))) / 10) * 10
    g = rows.where("score is not null and outcome is not null").groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("outcome") >= POSITIVE).cast("double"))).alias("observed"))
    w = F.least(F.lit(1.0), F.col("n") / full)
    return g.select("bin", "n", F.round("observed", 6).alias("observed"), F.round(w * F.col("observed") + (1 - w) * 0.1 * F.col("bin"), 6).alias("calibrated"))


def feature_rates(rows: DataFrame, feature: str, prior: float = 6.0) -> DataFrame:
    """Rate of positives of each value, shrunk towards the overall rate; the overall rate comes from the same groups."""
    g = rows.where("outcome is not null").groupBy(F.col(feature).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") >= POSITIVE).alias("p"))
    whole = g.agg((F.sum("p") / F.sum("n")).alias("overall"))
    return g.crossJoin(F.broadcast(whole)).select("value", "n", F.round(shrunk(F.col("p"), F.col("n"), prior, F.col("overall")), 6).alias("rate"))  # one row


def calibration_monitor(rows: DataFrame, share: float = 0.7, prior: float = 8.0) -> DataFrame:
    """Bins fitted on the earlier dates (share of the distinct dates), judged on the later: rows, expected calibration error and Brier score."""
    dates = rows.select("run_date").distinct().withColumn("r", F.percent_rank().over(W.orderBy("run_date")))  # one row per day
    x = rows.where("score is not null and outcome is not null").join(F.broadcast(dates), "run_date")
    x = x.select((F.floor(F.least(F.col("score"), F.lit(99.0)) / 10)).cast("int").alias("bin"), (F.col("outcome") >= POSITIVE).cast("int").alias("y"), (F.col("r") < share).alias("early"))
    g = x.groupBy("bin").agg(*[F.sum(F.when(F.col("early") == early, v).otherwise(0)).alias(k) for k, early, v in (("n0", True, F.lit(1)), ("p0", True, F.col("y")), ("n1", False, F.lit(1)), ("p1", False, F.col("y")))])
    whole = g.agg((F.sum("p0") / F.sum("n0")).alias("overall"))
    g = g.crossJoin(F.broadcast(whole)).withColumn("rate", shrunk(F.col("p0"), F.col("n0"), prior, F.col("overall")))  # one row
    gap = F.abs(F.col("p1") - F.col("n1") * F.col("rate"))
    brier = F.col("p1") * (1 - F.col("rate")) ** 2 + (F.col("n1") - F.col("p1")) * F.col("rate") ** 2
    return g.agg(F.sum("n0").alias("n_fit"), F.sum("n1").alias("n_test"), F.round(F.sum(gap) / F.sum("n1"), 6).alias("ece"), F.round(F.sum(brier) / F.sum("n1"), 6).alias("brier"))


def drift(rows: DataFrame, feature: str, recent_days: int = 30, limit: float = 0.2, least: int = 20) -> DataFrame:
    """One row: total variation distance between the feature's distribution in the last days and before them."""
    last = rows.agg(F.max("run_date").alias("last"))
    x = rows.crossJoin(F.broadcast(last)).withColumn("recent", F.col("run_date") > F.date_sub("last", recent_days))  # one row
    g = x.groupBy(feature).agg(F.count_if("recent").alias("a"), F.count_if(~F.col("recent")).alias("b"))
    whole = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    g = g.crossJoin(F.broadcast(whole)).where("na > 0 and nb > 0")
    out = g.agg(F.max("na").alias("n_recent"), F.max("nb").alias("n_before"), F.round(0.5 * F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))), 6).alias("distance"))
    return out.withColumn("status", F.when((F.col("n_recent") < least) | (F.col("n_before") < least), "UNKNOWN").when(F.col("distance") >= limit, "DRIFT").otherwise("STABLE"))


def adjusted(rows: DataFrame, reliabilities: DataFrame, weight: float = 4.0) -> DataFrame:
    """rows plus adjusted: score moved by both reliabilities (from profile) within +-weight, and kept in 0 to 100."""
    side = lambda k: reliabilities.where(F.col("dimension") == k).select(F.col("value").alias(k), F.col("reliability").alias(f"r_{k}"))
    x = rows.join(side("source"), "source", "left").join(side("category"), "category", "left")
    bonus = weight * (F.coalesce("r_source", F.lit(0.5)) - 0.5) + weight * (F.coalesce("r_category", F.lit(0.5)) - 0.5)
    bonus = F.least(F.lit(weight), F.greatest(F.lit(-weight), bonus))
    return x.withColumn("adjusted", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score") + bonus)), 6)).drop("r_source", "r_category")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def rolling_backtest(rows: DataFrame, thresholds: list[float], train_days: int, window_days: int, low: bool = False) -> DataFrame:
    """Rolling origin over days: each fold's threshold has the best f1 on all days before it (ties: the higher, or with low the lower), its figures are of its own days.

    Rows are reduced to counts per day and score before the folds are formed.
    """
    first = rows.agg(F.min("run_date").alias("first"))
    x = rows.where("score is not null and outcome is not null").crossJoin(F.broadcast(first)).withColumn("fold", F.floor((F.datediff("run_date", "first") - train_days) / window_days).cast("int"))  # one row
    x = x.withColumn("fold", F.greatest(F.col("fold"), F.lit(-1)))
    cells = x.groupBy("fold", "score").agg(F.count_if(F.col("outcome") >= POSITIVE).alias("p"), F.count_if(F.col("outcome") < POSITIVE).alias("n"))
    t = cells.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    over = F.col("score") >= F.col("threshold")
    s = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    per = t.groupBy("fold", "threshold").agg(s("p", over).alias("tp"), s("n", over).alias("fp"), s("p", ~over).alias("fn"))
    w = W.partitionBy("threshold").orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    past = per.withColumns({f"past_{c}": F.sum(c).over(w) for c in ("tp", "fp", "fn")}).where("fold >= 0")
    past = past.withColumn("train_f1", F.round(f1(F.col("past_tp"), F.col("past_fp"), F.col("past_fn")), 6))
    best = past.withColumn("r", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("train_f1"), F.asc("threshold") if low else F.desc("threshold")))).where("r = 1")
    return best.select("fold", "threshold", "train_f1", "tp", "fp", "fn", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("test_f1"))


def horizon_labels(runs: DataFrame, horizons: list[int]) -> DataFrame:
    """run_date, event_key and for each horizon h whether the key is in the first run at least h days later (null: no such run).

    The day of a horizon is found by a window over the days and days moved back by it; the labels are joins on (day, key), both shuffled by the key.
    """
    seen = runs.select("run_date", "event_key").distinct()
    days = seen.select("run_date").distinct()
    out = seen
    for h in horizons:
        # days as they are, marked, among days as they are wanted: the first marked one at or after each
        both = days.select(F.col("run_date").alias("at"), F.col("run_date").alias("day"), F.lit(None).cast("date").alias("of")).unionAll(days.select(F.date_add("run_date", h), F.lit(None).cast("date"), F.col("run_date")))
        first = F.min("day").over(W.orderBy(F.unix_date("at")).rangeBetween(0, W.unboundedFollowing))  # a row a day
        later = both.withColumn("_at", first).where("of is not null").select(F.col("of").alias("run_date"), "_at")
        hit = seen.select(F.col("run_date").alias("_at"), "event_key", F.lit(True).alias("_hit"))
        out = out.join(later, "run_date", "left").join(hit, ["_at", "event_key"], "left")
        out = out.withColumn(f"seen_{h}d", F.when(F.col("_at").isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_at", "_hit")
    return out


def upsert_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as an upsert in that order would leave it; rows with a null key are kept as a key of their own."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
