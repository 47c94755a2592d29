"""Queries over sightings, reviews, links and stored tables: lookups back in time, joins of review sheets, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from newsloom.functions.text import token_set
from newsloom.operators import matching as M, search as Q, similarity as S
from newsloom.operators.coverage import finite
from newsloom.plans import views as V
from newsloom.session import shared_dir, stage, table
from newsloom.sources import tables as IO


def continuing(spark, d):
    """Sightings of each day and how many of their keys were seen exactly the day before."""
    seen = V.runs(spark, d).select("run_date", "event_key").distinct()
    before = seen.select(F.date_add("run_date", 1).alias("run_date"), "event_key", F.lit(1).alias("again"))
    x = seen.join(before, ["run_date", "event_key"], "left")
    return x.groupBy(F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("keys"), F.count("again").alias("continuing"), (F.count(F.lit(1)) - F.count("again")).alias("new_keys"))


def anomalies(spark, d, days: int = 7):
    """Counts of each type in the last days against the days before: share of all, and a flag for types frequent now that were rare."""
    x = V.runs(spark, d)
    last = x.agg(F.max("run_date").alias("last"))
    x = x.crossJoin(F.broadcast(last)).withColumn("now", F.col("run_date") > F.date_sub("last", days))  # one row
    g = x.groupBy("event_type").agg(F.count_if("now").alias("current"), F.count_if(~F.col("now")).alias("earlier"))
    whole = g.agg(F.sum("earlier").alias("all_earlier"))
    g = g.crossJoin(F.broadcast(whole))  # one row
    base = F.when(F.col("all_earlier") > 0, F.col("earlier") / F.col("all_earlier")).otherwise(0.0)
    return g.select("event_type", "current", "earlier", F.round(base, 6).alias("baseline"), ((F.col("current") >= 3) & (base < 0.08)).alias("anomaly"))


def weekly(spark, d):
    """Events opened each week (calendar year and ISO week), and their categories."""
    x = table(spark, d, "news_events").where("first_seen is not null")
    label = F.concat(F.year("first_seen").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("first_seen").cast("string"), 2, "0"))
    return x.groupBy(label.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("category").alias("categories"), F.round(F.avg(finite(F.col("importance"))), 6).alias("mean_importance"))


def copies(spark, d):
    """Reports that copy each other: rows with the same title words, summary words and presence of a summary are one class, named by its first row.

    Two classes are copies if their summaries overlap by 0.82 with ten shared words, or, where one has no summary, their titles by 0.78 with six.
    """
    some = F.trim(F.coalesce("summary", F.lit(""))) != ""
    x = table(spark, d, "article_feed").select("feed_pos", F.sort_array(M.stopped(F.col("title"))).alias("t"), F.sort_array(M.stopped(F.col("summary"))).alias("s"), some.alias("has"))
    x = stage(x.groupBy("t", "s", "has").agg(F.min("feed_pos").alias("id"), F.count(F.lit(1)).alias("n")), "jn7-classes")
    by_text = S.self_join(x.where("size(s) >= 10").select("id", F.col("s").alias("tokens")), "id", 0.82).select("id_a", "id_b")
    titles = x.where("size(t) >= 6").select("id", "has", F.col("t").alias("tokens"))
    bare = titles.where("not has").select(F.col("id").alias("_b"), "tokens")
    by_title = S.similarity_join(bare, titles.select("id", "tokens"), "_b", "id", 0.78).where("_b != id").select(F.least("_b", "id").alias("id_a"), F.greatest("_b", "id").alias("id_b"))
    p = by_text.withColumn("text", F.lit(True)).unionAll(by_title.withColumn("text", F.lit(False))).groupBy("id_a", "id_b").agg(F.bool_or("text").alias("text"))
    side = lambda k: x.select(F.col("id").alias(f"id_{k}"), F.col("t").alias(f"t_{k}"), F.col("s").alias(f"s_{k}"), F.col("n").alias(f"n_{k}"))
    p = p.join(side("a"), "id_a").join(side("b"), "id_b")
    shared = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    return p.where((F.col("text") & (shared("s") >= 10)) | (~F.col("text") & (shared("t") >= 6))).select("id_a", "id_b", "n_a", "n_b")


def related_history(spark, d):
    """For each queried incoming headline (of at least three distinctive words) the best five accepted ones dated before it, with three shared words and an overlap of 0.34."""
    tok = lambda c: F.array_except(M.stopped(F.col(c)), M.words(M.GENERIC_QUERY))
    q = table(spark, d, "incoming_articles").where("row_id % 50 = 0").select("row_id", tok("headline").alias("tokens"), F.substring("date", 1, 10).alias("day")).where("size(tokens) >= 3")
    h = table(spark, d, "articles").select(F.col("row_id").alias("old"), tok("headline").alias("tokens"), F.substring("date", 1, 10).alias("at"))
    return Q.search(q, h, "row_id", "old", 0.34, shared=3, most=5, order=["overlap", "shared", "at", "r"], before="day", at="at").select("row_id", "old", "shared", F.round("overlap", 6).alias("overlap"), "rank")


def related_count(spark, d):
    """Accepted articles whose headline overlaps each queried event's by a quarter, and by a half."""
    tok = lambda c: token_set(F.col(c), S.WORDS4)
    ev = table(spark, d, "news_events").where("event_no % 50 = 0").select("event_no", tok("headline").alias("tokens"))
    a = table(spark, d, "articles").select("row_id", tok("headline").alias("tokens"))
    n = Q.search(ev, a, "event_no", "row_id", 0.25).groupBy("event_no").agg(F.count(F.lit(1)).alias("related"), F.count_if(F.col("overlap") >= 0.5).alias("close"))
    return ev.select("event_no").join(n, "event_no", "left").select("event_no", F.coalesce("related", F.lit(0)).alias("related"), F.coalesce("close", F.lit(0)).alias("close"))


def changed_since(spark, d):
    """Each event first seen the day after another one whose headline overlaps its own by 0.48: continuing, else new."""
    x = S.with_tokens(table(spark, d, "news_events").where("first_seen is not null").select("event_no", "first_seen", "headline"), "headline")
    today = x.select("event_no", "tokens", F.date_sub("first_seen", 1).cast("string").alias("day"))
    before = x.select(F.col("event_no").alias("old"), "tokens", F.col("first_seen").cast("string").alias("day"))
    hit = S.similarity_join(today, before, "event_no", "old", 0.48, ["day"]).select("event_no").distinct().withColumn("hit", F.lit(True))
    return x.select("event_no").join(hit, "event_no", "left").select("event_no", F.when(F.col("hit"), "Continuing").otherwise("New today").alias("change"))


def sheet_check(spark, d):
    """Feed articles against accepted articles by id: on both sides, missing on one, or with differing titles."""
    f = table(spark, d, "article_feed").where("article_id is not null").groupBy("article_id").agg(F.max_by("title", "feed_pos").alias("title"))
    a = table(spark, d, "articles").where("article_id is not null").groupBy("article_id").agg(F.max_by("headline", "row_id").alias("headline"))
    x = f.join(a, "article_id", "full_outer")
    state = F.when(F.col("headline").isNull(), "feed_only").when(F.col("title").isNull(), "accepted_only").when(F.col("title") == F.col("headline"), "same").otherwise("differs")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def last_delivery(spark, d):
    """Feed rows whose article was delivered again later, with what the last delivery says (last wins)."""
    x = table(spark, d, "article_feed").where("article_id is not null")
    last = x.groupBy("article_id").agg(F.max("feed_pos").alias("last_pos"), F.max_by("published", "feed_pos").alias("last_published"))
    return x.select("feed_pos", "article_id").join(last, "article_id").where("feed_pos < last_pos").select("feed_pos", "last_pos", "last_published")


def capped_targets(spark, d):
    """The ten most important events, three a region at most (rank in the region first, then over all)."""
    x = table(spark, d, "news_events").select("event_no", F.coalesce("region", F.lit("none")).alias("region"), finite(F.col("importance")).alias("importance"))
    x = x.withColumn("in_region", F.row_number().over(W.partitionBy("region").orderBy(F.desc("importance"), "event_no"))).where("in_region <= 3")
    return x.orderBy(F.desc("importance"), "event_no").limit(10).select("event_no", "region", "importance")


def pool_union(spark, d):
    """Accepted and incoming urls in one pool, the first row of each url."""
    u = table(spark, d, "articles").select("row_id", "url").unionByName(table(spark, d, "incoming_articles").select("row_id", "url"))
    return u.where("url is not null").groupBy("url").agg(F.min("row_id").alias("row_id"))


def changed_terms(spark, d):
    """Words that only the first or only the last report of an event has in its headline (symmetric difference)."""
    x = table(spark, d, "articles").where("event_id is not null")
    g = x.groupBy("event_id").agg(F.min_by("headline", "row_id").alias("a"), F.max_by("headline", "row_id").alias("b"))
    t = lambda c: token_set(F.col(c), S.WORDS4)
    return g.select("event_id", F.array_join(F.sort_array(F.array_union(F.array_except(t("a"), t("b")), F.array_except(t("b"), t("a")))), " ").alias("terms")).where("terms != ''")


def quality_trend(spark, d):
    """Each day of collection: share of rows with a summary, and its change against the day before."""
    x = table(spark, d, "article_feed").where("collected_at is not null").groupBy(F.date_format("collected_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.trim("summary") != "").cast("double")).alias("share"))
    # one row a day, so one window over all days
    return x.select("day", "n", F.round("share", 6).alias("share"), F.round(F.col("share") - F.lag("share").over(W.orderBy("day")), 6).alias("change"))


def stored(spark, d, kind: str):
    """Events written to the shared folder as CSV or JSON and read back by an explicit schema."""
    ddl = "event_no BIGINT, event_id STRING, headline STRING, category STRING"
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    x = table(spark, d, "news_events").select("event_no", "event_id", "headline", "category")
    if kind == "csv":
        x.write.option("header", True).option("escape", '"').csv(path)
        return IO.read_csv(spark, path, ddl)
    x.write.json(path)
    return spark.read.schema(ddl).json(path)


def first_per_family(spark, d):
    """The first event of each family (category and region); events without a region stay."""
    x = table(spark, d, "news_events").select("event_no", "category", "region")
    g = x.where("region is not null").groupBy("category", "region").agg(F.min("event_no").alias("event_no"))
    return g.select("event_no").unionAll(x.where("region is null").select("event_no"))


QUERIES = {
    "jn11_continuing": continuing, "jn11_changed_since": changed_since, "ag32_anomalies": anomalies, "ag35_weekly": weekly, "jn7_copies": copies, "jn8_related_history": related_history, "jn17_related_count": related_count,
    "jn21_sheet_check": sheet_check, "jn22_last_delivery": last_delivery, "sr5_capped_targets": capped_targets, "st1_pool_union": pool_union, "st4_changed_terms": changed_terms, "wn11_quality_trend": quality_trend,
    "sc3_csv_round_trip": lambda s, d: stored(s, d, "csv"), "sc5_json_round_trip": lambda s, d: stored(s, d, "json"), "sr4_first_per_family": first_per_family,
    "ag16_source_category": lambda s, d: V.learning(s, d).where("mature and selected").groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"), F.round((F.count_if(F.col("outcome") >= 0.5) + 2) / (F.count(F.lit(1)) + 4), 6).alias("rate")),
}


def _tok(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{4,}}'))"


def _j(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b})))"


def _stop(x: str, words: list[str] = M.STOP) -> str:
    return f"list_filter({_tok(x)}, lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in words) + "], w))"


_FIN = "CASE WHEN importance IS NULL OR isnan(importance) OR isinf(importance) THEN 0 ELSE importance END"
SQL = {
    "jn11_continuing": f"""WITH {V.RUNS}, s AS (SELECT DISTINCT run_date, event_key FROM runs_v) SELECT CAST(s.run_date AS VARCHAR) AS run_date, count(*) AS keys, count(p.event_key) AS continuing, count(*) - count(p.event_key) AS new_keys
  FROM s LEFT JOIN s p ON p.event_key = s.event_key AND p.run_date = s.run_date - 1 GROUP BY s.run_date""",
    "ag32_anomalies": f"""WITH {V.RUNS}, g AS (SELECT event_type, count(*) FILTER (run_date > last - 7) AS current, count(*) FILTER (run_date <= last - 7) AS earlier FROM runs_v, (SELECT max(run_date) AS last FROM runs_v) m GROUP BY event_type),
  b AS (SELECT *, earlier / (SELECT sum(earlier) FROM g) AS base FROM g) SELECT event_type, current, earlier, round(base, 6) AS baseline, current >= 3 AND base < 0.08 AS anomaly FROM b""",
    "ag35_weekly": f"""SELECT year(first_seen) || '-W' || lpad(CAST(weekofyear(first_seen) AS VARCHAR), 2, '0') AS week, count(*) AS n, count(DISTINCT category) AS categories, round(avg({_FIN}), 6) AS mean_importance
  FROM news_events WHERE first_seen IS NOT NULL GROUP BY 1""",
    "jn7_copies": f"""WITH f AS (SELECT feed_pos, list_sort({_stop('title')}) AS t, list_sort({_stop('summary')}) AS s, trim(coalesce(summary, '')) <> '' AS has FROM article_feed), c AS (SELECT t, s, has, min(feed_pos) AS id, count(*) AS n FROM f GROUP BY t, s, has),
  u AS (SELECT id, unnest(s) AS tok FROM c WHERE len(s) >= 10), v AS (SELECT id, has, unnest(t) AS tok FROM c WHERE len(t) >= 6),
  p AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.tok = y.tok AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 10),
  r AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.tok = y.tok AND x.id < y.id AND NOT (x.has AND y.has) GROUP BY 1, 2 HAVING count(*) >= 6),
  k AS (SELECT p.a, p.b FROM p JOIN c x ON x.id = p.a JOIN c y ON y.id = p.b WHERE {_j('x.s', 'y.s')} >= 0.82 - 1e-12 UNION SELECT r.a, r.b FROM r JOIN c x ON x.id = r.a JOIN c y ON y.id = r.b WHERE {_j('x.t', 'y.t')} >= 0.78 - 1e-12)
  SELECT k.a AS id_a, k.b AS id_b, x.n AS n_a, y.n AS n_b FROM k JOIN c x ON x.id = k.a JOIN c y ON y.id = k.b""",
    "jn8_related_history": f"""WITH q AS (SELECT row_id, {_stop('headline', M.STOP + M.GENERIC_QUERY)} AS w, substr(date, 1, 10) AS day FROM incoming_articles WHERE row_id % 50 = 0), h AS (SELECT row_id AS old, {_stop('headline', M.STOP + M.GENERIC_QUERY)} AS v, coalesce(substr(date, 1, 10), '') AS dated FROM articles),
  g AS (SELECT row_id, old, dated, len(list_intersect(w, v)) AS shared, {_j('w', 'v')} AS o FROM q, h WHERE len(w) >= 3 AND len(list_intersect(w, v)) >= 3 AND (dated = '' OR dated < coalesce(day, '')))
  SELECT row_id, old, CAST(shared AS INTEGER) AS shared, round(o, 6) AS overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o DESC, shared DESC, dated, old) AS rank FROM g WHERE o >= 0.34) t WHERE rank <= 5""",
    "jn17_related_count": f"""WITH e AS (SELECT event_no, {_tok('headline')} AS tokens FROM news_events WHERE event_no % 50 = 0), a AS (SELECT {_tok('headline')} AS t FROM articles),
  p AS (SELECT event_no, {_j('e.tokens', 'a.t')} AS o FROM e, a) SELECT event_no, count(*) FILTER (o >= 0.25) AS related, count(*) FILTER (o >= 0.5) AS close FROM p GROUP BY event_no""",
    "jn11_changed_since": f"""WITH x AS (SELECT event_no, first_seen, {_tok('headline')} AS w FROM news_events WHERE first_seen IS NOT NULL)
  SELECT a.event_no, CASE WHEN EXISTS (SELECT 1 FROM x b WHERE b.first_seen = a.first_seen - 1 AND {_j('a.w', 'b.w')} >= 0.48 - 1e-12) THEN 'Continuing' ELSE 'New today' END AS change FROM x a""",
    "jn21_sheet_check": """WITH f AS (SELECT article_id, arg_max(title, feed_pos) AS title FROM article_feed WHERE article_id IS NOT NULL GROUP BY article_id), a AS (SELECT article_id, arg_max(headline, row_id) AS headline FROM articles WHERE article_id IS NOT NULL GROUP BY article_id)
  SELECT CASE WHEN a.headline IS NULL THEN 'feed_only' WHEN f.title IS NULL THEN 'accepted_only' WHEN f.title = a.headline THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM f FULL OUTER JOIN a ON a.article_id = f.article_id GROUP BY 1""",
    "jn22_last_delivery": """SELECT f.feed_pos, g.p AS last_pos, l.published AS last_published FROM article_feed f JOIN (SELECT article_id, max(feed_pos) AS p FROM article_feed WHERE article_id IS NOT NULL GROUP BY article_id) g ON g.article_id = f.article_id
  JOIN article_feed l ON l.feed_pos = g.p WHERE f.feed_pos < g.p""",
    "sr5_capped_targets": f"""SELECT event_no, region, importance FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY importance DESC, event_no) AS r FROM (SELECT event_no, coalesce(region, 'none') AS region, {_FIN} AS importance FROM news_events) e) t
  WHERE r <= 3 ORDER BY importance DESC, event_no LIMIT 10""",
    "st1_pool_union": "SELECT url, min(row_id) AS row_id FROM (SELECT row_id, url FROM articles UNION ALL SELECT row_id, url FROM incoming_articles) u WHERE url IS NOT NULL GROUP BY url",
    "wn11_quality_trend": """WITH g AS (SELECT strftime(collected_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, avg(CASE WHEN trim(summary) <> '' THEN 1.0 WHEN summary IS NULL THEN NULL ELSE 0.0 END) AS share FROM article_feed WHERE collected_at IS NOT NULL GROUP BY 1)
  SELECT day, n, round(share, 6) AS share, round(share - lag(share) OVER (ORDER BY day), 6) AS change FROM g""",
    "sc3_csv_round_trip": "SELECT event_no, event_id, headline, category FROM news_events",
    "sc5_json_round_trip": "SELECT event_no, event_id, headline, category FROM news_events",
    "sr4_first_per_family": "SELECT min(event_no) AS event_no FROM news_events WHERE region IS NOT NULL GROUP BY category, region UNION ALL SELECT event_no FROM news_events WHERE region IS NULL",
    "ag16_source_category": f"WITH {V.LEARNING} SELECT source, category, count(*) AS n, round((count(*) FILTER (outcome >= 0.5) + 2) / (count(*) + 4), 6) AS rate FROM learning_v WHERE mature AND selected GROUP BY source, category",
    "st4_changed_terms": f"""WITH g AS (SELECT event_id, arg_min(headline, row_id) AS a, arg_max(headline, row_id) AS b FROM articles WHERE event_id IS NOT NULL GROUP BY event_id),
  t AS (SELECT event_id, {_tok('a')} AS x, {_tok('b')} AS y FROM g), m AS (SELECT event_id, array_to_string(list_sort(list_concat(list_filter(x, lambda w: NOT list_contains(y, w)), list_filter(y, lambda w: NOT list_contains(x, w)))), ' ') AS terms FROM t)
  SELECT event_id, terms FROM m WHERE terms <> ''""",
}
