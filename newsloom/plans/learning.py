"""Queries over outcomes, runs and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import learning as L
from newsloom.plans import views as V

SWEEP = [float(t) for t in range(35, 90, 5)]


def flagship(spark, d):
    """Best adjusted stories of each category."""
    rows = V.learning(spark, d)
    x = L.adjusted(rows.where("selected and mature"), L.profile(rows))
    order = [F.desc("adjusted"), F.desc("outcome"), F.asc("run_date"), F.asc("story_id"), F.desc("score")]
    return L.top_per_group(x, "category", order, 10).select("category", "rank", "story_id", "source", "adjusted")


QUERIES = {
    "flagship_outcome_profile": flagship,
    "ag1_profile": lambda s, d: L.profile(V.learning(s, d)),
    "ag2_metrics": lambda s, d: L.metrics(V.learning(s, d)),
    "ag8_backtest": lambda s, d: L.confusion(V.learning(s, d).where("mature"), [50.0]),
    "ag8_buckets": lambda s, d: L.score_buckets(V.learning(s, d).where("mature")),
    "ag10_sweep": lambda s, d: L.confusion(V.learning(s, d).where("mature"), SWEEP),
    "ag10_best_threshold": lambda s, d: L.best_threshold(V.learning(s, d).where("mature"), SWEEP),
    "ag12_bucket_metrics": lambda s, d: L.bucket_metrics(V.learning(s, d)),
    "ag13_event_level": lambda s, d: L.event_level(V.learning(s, d).where("mature")),
    "ag14_upsert_learning": lambda s, d: L.upsert_last(V.learning(s, d), ["run_date", "event_id"], [F.desc("story_id"), F.desc("score"), F.desc("outcome")]).select(F.col("run_date").cast("string").alias("run_date"), "event_id", "story_id", "score"),
    "ag15_calibration_bins": lambda s, d: L.calibration_bins(V.learning(s, d).where("mature")),
    "ag17_source_rates": lambda s, d: L.feature_rates(V.learning(s, d).where("mature"), "source"),
    "ag19_calibration_monitor": lambda s, d: L.calibration_monitor(V.learning(s, d).where("mature")),
    "ag20_drift": lambda s, d: L.drift(V.learning(s, d).where("mature"), "category", 180),
    "pr15_apply_learning": lambda s, d: L.adjusted(V.learning(s, d), L.profile(V.learning(s, d))).select("story_id", "source", "category", "score", "outcome", "adjusted"),
    "wn3_rolling_backtest": lambda s, d: L.rolling_backtest(V.learning(s, d).where("mature"), [55.0, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0], 365, 180),
    "wn8_chronological": lambda s, d: chronological(s, d),
    "jn14_horizon_labels": lambda s, d: L.horizon_labels(V.runs(s, d), [1, 2, 7]).withColumn("run_date", F.col("run_date").cast("string")),
    "ag21_daily_trend": lambda s, d: V.runs(s, d).groupBy(F.col("run_date").cast("string").alias("run_date"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_key").alias("keys"), F.round(F.avg("value"), 6).alias("mean_value")),
    "ag36_last_days": lambda s, d: last_days(s, d),
}


def chronological(spark, d):
    """The threshold of best f1 on the first 70 % of the dates (ties: the higher), judged on the rest beside a fixed 50."""
    x = V.learning(spark, d).where("mature and outcome is not null and score is not null")
    from pyspark.sql import Window as W

    dates = x.select("run_date").distinct().withColumn("share", F.dense_rank().over(W.orderBy("run_date")) / F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    x = x.join(dates, "run_date").withColumn("part", F.when(F.col("share") <= 0.7, "train").otherwise("test"))
    c = L.confusion(x, [float(t) for t in range(50, 100, 5)], ["part"])
    best = c.where("part = 'train'").orderBy(F.desc("f1"), F.desc("threshold")).limit(1).select(F.col("threshold").alias("best"))
    c = c.where("part = 'test'").crossJoin(F.broadcast(best)).where("threshold = best or threshold = 50.0")  # one row
    return c.select("threshold", (F.col("threshold") == F.col("best")).alias("chosen"), "tp", "fp", "fn", "precision", "recall", "f1")


def last_days(spark, d, days: int = 7):
    x = V.learning(spark, d).where("mature")
    last = x.agg(F.max("run_date").alias("last"))
    x = x.crossJoin(F.broadcast(last)).where(F.col("run_date") >= F.date_sub("last", days))  # one row
    return x.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("outcome"), 6).alias("mean_outcome"), F.round(F.avg("score"), 6).alias("mean_score"))


_L = f"WITH {V.LEARNING}"
_PROFILE = """profile AS (SELECT dimension, value, n, round(least(1.0, greatest(0.0, (total + 2.0) / (n + 4))), 6) AS reliability FROM (
  SELECT 'source' AS dimension, source AS value, count(*) AS n, sum(outcome) AS total FROM learning_v WHERE selected AND mature GROUP BY source
  UNION ALL SELECT 'category', category, count(*), sum(outcome) FROM learning_v WHERE selected AND mature GROUP BY category) t)"""
_ADJ = """adj AS (SELECT l.*, round(least(100.0, greatest(0.0, score + least(4.0, greatest(-4.0, 4.0 * (coalesce(ps.reliability, 0.5) - 0.5) + 4.0 * (coalesce(pc.reliability, 0.5) - 0.5))))), 6) AS adjusted
  FROM learning_v l LEFT JOIN profile ps ON ps.dimension = 'source' AND ps.value = l.source LEFT JOIN profile pc ON pc.dimension = 'category' AND pc.value = l.category)"""


def _conf(thresholds: str, rows: str = "learning_v WHERE mature", by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (
  SELECT {b}threshold, CAST(count(*) FILTER (score >= threshold AND outcome >= 0.5) AS BIGINT) AS tp, CAST(count(*) FILTER (score >= threshold AND outcome < 0.5) AS BIGINT) AS fp,
    CAST(count(*) FILTER (score < threshold AND outcome >= 0.5) AS BIGINT) AS fn, CAST(count(*) FILTER (score < threshold AND outcome < 0.5) AS BIGINT) AS tn
  FROM (SELECT * FROM {rows}) r, (SELECT CAST(unnest({thresholds}) AS DOUBLE) AS threshold) t GROUP BY {b}threshold) c"""


_SWEEP = str(SWEEP)
SQL = {
    "flagship_outcome_profile": f"""{_L}, {_PROFILE}, {_ADJ} SELECT category, rank, story_id, source, adjusted FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY adjusted DESC, outcome DESC, run_date, story_id, score DESC) AS INTEGER) AS rank FROM adj WHERE selected AND mature) t WHERE rank <= 10""",
    "ag1_profile": f"{_L}, {_PROFILE} SELECT * FROM profile",
    "ag2_metrics": f"""{_L} SELECT count(*) AS n_rows, count(*) FILTER (selected) AS n_selected,
  round(count(*) FILTER (selected AND outcome >= 0.45) / count(*) FILTER (selected), 6) AS success_rate, round(count(*) FILTER (selected AND outcome = 0) / count(*) FILTER (selected), 6) AS false_positive_rate,
  round(count(*) FILTER (NOT selected AND outcome >= 0.45) / count(*) FILTER (outcome >= 0.45), 6) AS miss_rate FROM learning_v WHERE mature""",
    "ag8_backtest": f"{_L} {_conf('[50.0]')}",
    "ag8_buckets": f"""{_L} SELECT CASE WHEN score < 50 THEN '00-50' WHEN score < 70 THEN '50-70' WHEN score < 85 THEN '70-85' ELSE '85-100' END AS band, count(*) AS n, round(avg(outcome), 6) AS mean_outcome,
  round(avg(abs(score / 100 - outcome)), 6) AS mae FROM learning_v WHERE mature GROUP BY 1""",
    "ag10_sweep": f"{_L} {_conf(_SWEEP)}",
    "ag10_best_threshold": f"{_L} SELECT * FROM ({_conf(_SWEEP)}) s ORDER BY f1 DESC, precision DESC, recall DESC, threshold LIMIT 1",
    "ag12_bucket_metrics": f"""{_L}, b AS (SELECT *, CASE WHEN score < 50 THEN 'low' WHEN score < 75 THEN 'mid' ELSE 'high' END AS band FROM learning_v WHERE mature)
  SELECT CASE grouping_id(category, source, band) WHEN 7 THEN 'overall' WHEN 3 THEN 'category' WHEN 5 THEN 'source' ELSE 'band' END AS dimension, coalesce(category, source, band, 'all') AS value,
  count(*) AS n, count(*) FILTER (selected) AS n_selected, round(avg(outcome), 6) AS mean_outcome FROM b GROUP BY GROUPING SETS ((), (category), (source), (band))""",
    "ag13_event_level": f"""{_L} SELECT count(*) AS events, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (score >= 50 AND outcome >= 0.5) AS tp, count(*) FILTER (score >= 50 AND outcome < 0.5) AS fp,
  count(*) FILTER (score < 50 AND outcome >= 0.5) AS fn, round(1 - count(*) / sum(n), 6) AS repeat_share FROM (SELECT event_id, max(score) AS score, max(outcome) AS outcome, count(*) AS n FROM learning_v WHERE mature GROUP BY event_id) e""",
    "ag14_upsert_learning": f"""{_L} SELECT CAST(run_date AS VARCHAR) AS run_date, event_id, m.story_id AS story_id, m.score AS score FROM (
  SELECT run_date, event_id, max(struct_pack(story_id := story_id, score := score)) AS m FROM learning_v GROUP BY run_date, event_id) t""",
    "ag15_calibration_bins": f"""{_L} SELECT bin, n, round(observed, 6) AS observed, round(least(1.0, n / 20) * observed + (1 - least(1.0, n / 20)) * 0.1 * bin, 6) AS calibrated FROM (
  SELECT CAST(floor(least(99.0, greatest(0.0, score)) / 10) * 10 AS INTEGER) AS bin, count(*) AS n, 100 * avg(CASE WHEN outcome >= 0.5 THEN 1.0 ELSE 0.0 END) AS observed FROM learning_v WHERE mature GROUP BY 1) t""",
    "ag17_source_rates": f"""{_L}, g AS (SELECT source AS value, count(*) AS n, count(*) FILTER (outcome >= 0.5) AS p FROM learning_v WHERE mature GROUP BY source)
  SELECT value, n, round((p + 6.0 * (SELECT sum(p) / sum(n) FROM g)) / (n + 6.0), 6) AS rate FROM g""",
    "ag19_calibration_monitor": f"""{_L}, d AS (SELECT run_date, percent_rank() OVER (ORDER BY run_date) AS r FROM (SELECT DISTINCT run_date FROM learning_v WHERE mature) q),
  x AS (SELECT CAST(floor(least(score, 99.0) / 10) AS INTEGER) AS bin, CASE WHEN outcome >= 0.5 THEN 1 ELSE 0 END AS y, d.r < 0.7 AS early FROM learning_v l JOIN d USING (run_date) WHERE mature),
  g AS (SELECT bin, count(*) FILTER (early) AS n0, coalesce(sum(y) FILTER (early), 0) AS p0, count(*) FILTER (NOT early) AS n1, coalesce(sum(y) FILTER (NOT early), 0) AS p1 FROM x GROUP BY bin),
  r AS (SELECT *, (p0 + 8.0 * (SELECT sum(p0) / sum(n0) FROM g)) / (n0 + 8.0) AS rate FROM g)
  SELECT CAST(sum(n0) AS BIGINT) AS n_fit, CAST(sum(n1) AS BIGINT) AS n_test, round(sum(abs(p1 - n1 * rate)) / sum(n1), 6) AS ece, round(sum(p1 * (1 - rate) * (1 - rate) + (n1 - p1) * rate * rate) / sum(n1), 6) AS brier FROM r""",
    "ag20_drift": f"""{_L}, g AS (SELECT category, count(*) FILTER (run_date > last - 180) AS a, count(*) FILTER (run_date <= last - 180) AS b FROM learning_v, (SELECT max(run_date) AS last FROM learning_v WHERE mature) m WHERE mature GROUP BY category),
  t AS (SELECT sum(a) AS na, sum(b) AS nb FROM g), o AS (SELECT CAST(max(na) AS BIGINT) AS n_recent, CAST(max(nb) AS BIGINT) AS n_before, round(0.5 * sum(abs(a / na - b / nb)), 6) AS distance FROM g, t WHERE na > 0 AND nb > 0)
  SELECT *, CASE WHEN n_recent < 20 OR n_before < 20 THEN 'UNKNOWN' WHEN distance >= 0.2 THEN 'DRIFT' ELSE 'STABLE' END AS status FROM o""",
    "pr15_apply_learning": f"{_L}, {_PROFILE}, {_ADJ} SELECT story_id, source, category, score, outcome, adjusted FROM adj",
    "wn3_rolling_backtest": f"""{_L}, x AS (SELECT *, greatest(-1, CAST(floor((date_diff('day', first, run_date) - 365) / 180.0) AS INTEGER)) AS fold FROM learning_v, (SELECT min(run_date) AS first FROM learning_v WHERE mature) m WHERE mature),
  p AS (SELECT fold, threshold, count(*) FILTER (score >= threshold AND outcome >= 0.5) AS tp, count(*) FILTER (score >= threshold AND outcome < 0.5) AS fp, count(*) FILTER (score < threshold AND outcome >= 0.5) AS fn
    FROM x, (SELECT CAST(unnest([55, 60, 65, 70, 75, 80, 85]) AS DOUBLE) AS threshold) t GROUP BY fold, threshold),
  c AS (SELECT *, sum(tp) OVER w AS ptp, sum(fp) OVER w AS pfp, sum(fn) OVER w AS pfn FROM p WINDOW w AS (PARTITION BY threshold ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, round(CASE WHEN 2 * ptp + pfp + pfn > 0 THEN 2 * ptp / (2 * ptp + pfp + pfn) ELSE 0 END, 6) AS train_f1 FROM c WHERE fold >= 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_f1 DESC, threshold DESC) AS k FROM f)
  SELECT fold, threshold, train_f1, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS test_f1 FROM r WHERE k = 1""",
    "wn8_chronological": f"""{_L}, d AS (SELECT run_date, dense_rank() OVER (ORDER BY run_date) / count(*) OVER () AS share FROM (SELECT DISTINCT run_date FROM learning_v WHERE mature) q),
  x AS (SELECT l.*, CASE WHEN d.share <= 0.7 THEN 'train' ELSE 'test' END AS part FROM learning_v l JOIN d USING (run_date) WHERE mature),
  c AS ({_conf('[50, 55, 60, 65, 70, 75, 80, 85, 90, 95]', 'x', 'part')}), b AS (SELECT threshold AS best FROM c WHERE part = 'train' ORDER BY f1 DESC, threshold DESC LIMIT 1)
  SELECT threshold, threshold = best AS chosen, tp, fp, fn, precision, recall, f1 FROM c, b WHERE part = 'test' AND (threshold = best OR threshold = 50)""",
    "jn14_horizon_labels": f"""WITH {V.RUNS}, s AS (SELECT DISTINCT run_date, event_key FROM runs_v), dd AS (SELECT DISTINCT run_date FROM runs_v),
  n AS (SELECT a.run_date, min(b.run_date) FILTER (b.run_date >= a.run_date + 1) AS d1, min(b.run_date) FILTER (b.run_date >= a.run_date + 2) AS d2, min(b.run_date) FILTER (b.run_date >= a.run_date + 7) AS d7 FROM dd a, dd b GROUP BY a.run_date)
  SELECT CAST(s.run_date AS VARCHAR) AS run_date, s.event_key, CASE WHEN n.d1 IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM s t WHERE t.run_date = n.d1 AND t.event_key = s.event_key) END AS seen_1d,
    CASE WHEN n.d2 IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM s t WHERE t.run_date = n.d2 AND t.event_key = s.event_key) END AS seen_2d,
    CASE WHEN n.d7 IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM s t WHERE t.run_date = n.d7 AND t.event_key = s.event_key) END AS seen_7d FROM s JOIN n USING (run_date)""",
    "ag21_daily_trend": f"WITH {V.RUNS} SELECT CAST(run_date AS VARCHAR) AS run_date, event_type, count(*) AS n, count(DISTINCT event_key) AS keys, round(avg(value), 6) AS mean_value FROM runs_v GROUP BY run_date, event_type",
    "ag36_last_days": f"""{_L} SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) AS n, round(avg(outcome), 6) AS mean_outcome, round(avg(score), 6) AS mean_score FROM learning_v, (SELECT max(run_date) AS last FROM learning_v WHERE mature) m
  WHERE mature AND run_date >= last - 7 GROUP BY run_date""",
}
