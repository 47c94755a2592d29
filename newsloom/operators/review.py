"""Offline evaluation: agreement, consolidation, paired policies, bootstrap and hash-chained history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _share(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b), 6)


def decision_quality(rows: DataFrame, included: Column, relevant: Column) -> DataFrame:
    """One row: confusion, precision, recall, specificity, balanced accuracy, f1 (null on a zero denominator); rows with a null label are left out."""
    x = rows.select(included.alias("i"), relevant.alias("r")).where("i is not null and r is not null")
    g = x.agg(F.count_if(F.expr("i and r")).alias("tp"), F.count_if(F.expr("i and not r")).alias("fp"), F.count_if(F.expr("not i and r")).alias("fn"), F.count_if(F.expr("not i and not r")).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return g.withColumns({
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "specificity": _share(tn, tn + fp),
        "balanced": F.round((F.when(tp + fn > 0, tp / (tp + fn)) + F.when(tn + fp > 0, tn / (tn + fp))) / 2, 6), "f1": _share(2 * tp, 2 * tp + fp + fn),
    })


def agreement(reviews: DataFrame) -> DataFrame:
    """candidate, reviewers, n_reviews, n_labels, status of each candidate (candidate, reviewer, label): duplicate_reviewer before disagreement before single before agreed."""
    g = reviews.where("label is not null").groupBy("candidate").agg(F.countDistinct("reviewer").alias("reviewers"), F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("label").alias("n_labels"))
    status = F.when(F.col("n_reviews") > F.col("reviewers"), "duplicate_reviewer").when(F.col("n_labels") > 1, "disagreement").when(F.col("reviewers") == 1, "single").otherwise("agreed")
    return g.withColumn("status", status)


def paired(rows: DataFrame, a: Column, b: Column, relevant: Column) -> DataFrame:
    """One row: how two policies decide the same rows, and the difference of their precision and recall."""
    x = rows.select(a.alias("a"), b.alias("b"), relevant.alias("r")).where("a is not null and b is not null and r is not null")
    n = lambda c: F.count_if(F.expr(c))
    g = x.agg(n("a and r").alias("tpa"), n("a").alias("na"), n("b and r").alias("tpb"), n("b").alias("nb"), n("r").alias("nr"), n("a and not b").alias("only_a"), n("b and not a").alias("only_b"), F.count(F.lit(1)).alias("n"))
    return g.select("n", "only_a", "only_b", _share(F.col("tpa"), F.col("na")).alias("precision_a"), _share(F.col("tpb"), F.col("nb")).alias("precision_b"), _share(F.col("tpa"), F.col("nr")).alias("recall_a"), _share(F.col("tpb"), F.col("nr")).alias("recall_b"))


def bootstrap_interval(rows: DataFrame, block: str, a: Column, b: Column, relevant: Column, draws: int = 200, seed: int = 1) -> DataFrame:
    """One row: 95 % interval of precision_b - precision_a over Poisson resamples of blocks (days), weights from a hash.

    Rows are reduced to counts per block first; only blocks times draws are multiplied out.
    """
    x = rows.select(F.col(block).alias("k"), a.alias("a"), b.alias("b"), relevant.alias("r")).where("k is not null")
    cells = x.groupBy("k").agg(F.count_if(F.expr("a and r")).alias("tpa"), F.count_if(F.expr("a")).alias("na"), F.count_if(F.expr("b and r")).alias("tpb"), F.count_if(F.expr("b")).alias("nb"))
    t = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("k").cast("string"), F.col("draw").cast("string"), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("bigint") + 0.5) / float(1 << 32)
    # inverse distribution function of the Poisson law of mean 1
    weight, total, term = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        weight = F.when(u > total, k).otherwise(weight)
        term /= k
        total += term
    d = t.withColumn("w", weight).groupBy("draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tpa", "na", "tpb", "nb")])
    delta = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("tpb") / F.col("nb") - F.col("tpa") / F.col("na"))
    return d.select(delta.alias("d")).agg(F.count("d").alias("draws"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"))


def chained(entries: DataFrame, order: str, text: str) -> DataFrame:
    """One row: length and last digest of the chain sha256(previous or GENESIS + ":" + sha256(entry)) over a history of runs in order (a row a run)."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, F.sha2(text, 256).alias("h")))), lambda x: x["h"])
    return entries.agg(steps.alias("s")).select(F.size("s").alias("n"), F.aggregate("s", F.lit("GENESIS"), lambda acc, h: F.sha2(F.concat_ws(":", acc, h), 256)).alias("digest"))


def chain_audit(entries: DataFrame, order: str, digest: str, previous: str, run: str) -> DataFrame:
    """run and broken_link, repeated_run of each history entry."""
    w = W.orderBy(order)  # a row a run
    return entries.withColumn("_p", F.lag(digest).over(w)).select(run, (~F.col(previous).eqNullSafe(F.coalesce("_p", F.lit("GENESIS")))).alias("broken_link"), (F.count(F.lit(1)).over(W.partitionBy(run)) > 1).alias("repeated_run"))
