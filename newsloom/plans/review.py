"""Queries over reviews, paired policies, first-wins dedup and corroboration."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import folds, matching as M, review as R, similarity as S
from newsloom.operators.coverage import publisher
from newsloom.plans import similarity, views as V
from newsloom.plans.coverage import _PUB
from newsloom.session import stage, table


def reviews(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("candidate"), (F.col("l_suppkey") % 50).alias("reviewer"), F.col("l_returnflag").alias("label"))


REVIEWS = "reviews_v AS (SELECT l_orderkey AS candidate, l_suppkey % 50 AS reviewer, l_returnflag AS label FROM lineitem)"


def policies():
    return F.col("score") >= 50, F.col("score") >= 60, F.col("outcome") >= 0.5


def deduplicated(spark, d):
    """Feed rows kept by first-wins dedup: dropped if a kept earlier row has the same url, or the same source (case and outer blanks aside) and a title overlapping by 0.62."""
    x = table(spark, d, "article_feed").select("feed_pos", F.lower(F.trim("source")).alias("src"), "title", "url")
    pairs = stage(S.self_join(S.with_tokens(x.where("src is not null"), "title").select("feed_pos", "src", "tokens"), "feed_pos", 0.62, ["src"]).select("id_a", "id_b"), "jn1-pairs")
    return folds.first_wins(x, pairs, "feed_pos", x.select("feed_pos", F.col("url").alias("key")))


def corroboration(spark, d):
    """Independent reports of each queried news event: feed titles that match its headline (a score of 0.55, or a strong or relaxed event match), best first, one a publisher, copies left out, eight at most."""
    feed = M.words_of(table(spark, d, "article_feed").select("feed_pos", "title", "source", "url"), "feed_pos", "title", publisher(F.col("source"), F.col("url")).alias("publisher"))
    got = M.independent_reports(similarity.event_queries(spark, d), feed).withColumnsRenamed({"q": "event_no", "r": "feed_pos"})
    return got.select("event_no", "accepted", "feed_pos", "publisher", "score")


def verified(spark, d):
    """Each queried event with its independent reports, its tier and the confidence that tier gives."""
    n = corroboration(spark, d).groupBy("event_no").agg(F.count(F.lit(1)).alias("independent"))
    x = similarity.queried(spark, d, M.event_tokens).select("event_no").join(n, "event_no", "left").withColumn("independent", F.coalesce("independent", F.lit(0)))
    tier = F.when(F.col("independent") >= 2, "multi-source").when(F.col("independent") == 1, "multi-report").otherwise("single-source")
    sure = F.when(F.col("independent") >= 2, F.least(F.lit(99), 78 + 5 * F.least(F.col("independent") - 1, F.lit(4)))).when(F.col("independent") == 1, 70).otherwise(55)
    return x.select("event_no", "independent", tier.alias("tier"), sure.cast("int").alias("confidence"))


def clustered(spark, d):
    """Incoming rows of each batch in clusters of headlines, named by their first row."""
    x = table(spark, d, "incoming_articles").select(F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), "row_id", S.token_set(F.col("headline"), S.EXTENDED).alias("tokens"))
    return folds.leader_clusters(x, "batch_no", "row_id", "tokens")


def weekly_terms(spark, d):
    """The ten commonest words of four letters or more among the thirty commonest of the incoming headlines, and how often the accepted ones have them."""
    count = lambda t: table(spark, d, t).select(F.explode(S.token_set(F.col("headline"), S.EXTENDED)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    now = count("incoming_articles").orderBy(F.desc("n"), "entity").limit(30).where(F.length("entity") >= 4).orderBy(F.desc("n"), "entity").limit(10)
    return F.broadcast(now).join(count("articles").withColumnRenamed("n", "earlier"), "entity", "left").select("entity", F.col("n").alias("current"), F.coalesce("earlier", F.lit(0)).alias("historical"))  # ten rows


def history_chain(spark, d):
    x = V.runs(spark, d).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"))
    return R.chained(x.select(F.col("run_date").cast("string").alias("run"), F.concat_ws("|", F.col("run_date").cast("string"), F.col("n").cast("string")).alias("entry")), "run", "entry")


QUERIES = {
    "ev5_decision_quality": lambda s, d: R.decision_quality(V.learning(s, d), F.col("selected"), F.col("outcome") >= 0.5),
    "ev7_agreement": lambda s, d: R.agreement(reviews(s, d)),
    "ev8_status_counts": lambda s, d: R.agreement(reviews(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_reviews").alias("n_reviews")),
    "ev11_paired_policies": lambda s, d: R.paired(V.learning(s, d), *policies()),
    "wn10_bootstrap": lambda s, d: R.bootstrap_interval(V.learning(s, d), "run_date", *policies()),
    "wn12_history_chain": history_chain,
    "jn1_first_wins": deduplicated,
    "jn5_corroboration": corroboration, "jn6_verified": verified, "sr8_clusters": clustered, "ag32_weekly_terms": weekly_terms,
}
_AGREE = """SELECT candidate, reviewers, n_reviews, n_labels, CASE WHEN n_reviews > reviewers THEN 'duplicate_reviewer' WHEN n_labels > 1 THEN 'disagreement' WHEN reviewers = 1 THEN 'single' ELSE 'agreed' END AS status FROM (
  SELECT candidate, count(DISTINCT reviewer) AS reviewers, count(*) AS n_reviews, count(DISTINCT label) AS n_labels FROM reviews_v WHERE label IS NOT NULL GROUP BY candidate) g"""
def _poisson() -> str:
    out, total, term = "0", 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        out = f"CASE WHEN u > {total!r} THEN {k} ELSE {out} END"
        term /= k
        total += term
    return out


def _dropped(pairs: str) -> str:
    """Common table expressions that end in gone(ids): what a scan in the order of ids drops, given pairs (a, b), a < b."""
    return f"""e AS (SELECT b AS id, list(a) AS ps FROM {pairs} GROUP BY b), l AS (SELECT list([struct_pack(id := id, ps := ps)] ORDER BY id) AS l FROM e),
  gone AS (SELECT list_transform(coalesce(list_reduce(list_prepend([struct_pack(id := CAST(-1 AS BIGINT), ps := CAST([] AS BIGINT[]))], l), lambda acc, x: CASE WHEN len(list_filter(x[1].ps, lambda p: NOT list_contains(list_transform(acc, lambda s: s.id), p))) > 0 THEN list_concat(acc, x) ELSE acc END), []), lambda s: s.id) AS ids FROM l)"""


_POISSON = _poisson()
_ACCEPTED = f"""{similarity.match_parts('article_feed', 'feed_pos', 'title')}, c AS (SELECT s.event_no, s.row_id AS pos, round(greatest(research, CASE WHEN strong THEN 0.58 ELSE 0 END), 6) AS score, {_PUB} AS pub, list_filter({similarity._tok('title')}, lambda w: NOT list_contains({similarity._list(M.STOP)}, w)) AS t
    FROM s JOIN article_feed f ON f.feed_pos = s.row_id WHERE common >= 4 AND (research >= 0.55 OR strong OR relaxed)),
  accepted AS (SELECT event_no, list_reduce(list([struct_pack(pub := pub, t := t, pos := pos, score := score)] ORDER BY score DESC, pos), lambda acc, x: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda a: a.pub = x[1].pub OR len(list_intersect(a.t, x[1].t)) / greatest(1, len(a.t) + len(x[1].t) - len(list_intersect(a.t, x[1].t))) >= 0.78)) = 0 THEN list_concat(acc, x) ELSE acc END) AS l FROM c GROUP BY event_no)"""
_TK5 = similarity._tok("headline", S.EXTENDED)
_SIMS = f"list_transform(acc, lambda k: {similarity._j('k.t', 'x[1].t')})"
SQL = {
    "ev5_decision_quality": f"""WITH {V.LEARNING}, g AS (SELECT count(*) FILTER (selected AND outcome >= 0.5) AS tp, count(*) FILTER (selected AND outcome < 0.5) AS fp, count(*) FILTER (NOT selected AND outcome >= 0.5) AS fn, count(*) FILTER (NOT selected AND outcome < 0.5) AS tn FROM learning_v)
  SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""",
    "ev7_agreement": f"WITH {REVIEWS} {_AGREE}",
    "ev8_status_counts": f"WITH {REVIEWS} SELECT status, count(*) AS n, CAST(sum(n_reviews) AS BIGINT) AS n_reviews FROM ({_AGREE}) a GROUP BY status",
    "ev11_paired_policies": f"""WITH {V.LEARNING}, x AS (SELECT score >= 50 AS a, score >= 60 AS b, outcome >= 0.5 AS r FROM learning_v)
  SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, round(count(*) FILTER (a AND r) / count(*) FILTER (a), 6) AS precision_a, round(count(*) FILTER (b AND r) / count(*) FILTER (b), 6) AS precision_b,
  round(count(*) FILTER (a AND r) / count(*) FILTER (r), 6) AS recall_a, round(count(*) FILTER (b AND r) / count(*) FILTER (r), 6) AS recall_b FROM x""",
    "wn12_history_chain": f"""WITH {V.RUNS}, r AS (SELECT CAST(run_date AS VARCHAR) AS run, count(*) AS n FROM runs_v GROUP BY 1), h AS (SELECT list(sha256(run || '|' || n) ORDER BY run) AS l FROM r)
  SELECT CAST(len(l) AS INTEGER) AS n, list_reduce(list_prepend('GENESIS', l), lambda a, x: sha256(a || ':' || x)) AS digest FROM h""",
    "wn10_bootstrap": f"""WITH {V.LEARNING}, c AS (SELECT run_date AS k, count(*) FILTER (score >= 50 AND outcome >= 0.5) AS tpa, count(*) FILTER (score >= 50) AS na, count(*) FILTER (score >= 60 AND outcome >= 0.5) AS tpb, count(*) FILTER (score >= 60) AS nb FROM learning_v WHERE run_date IS NOT NULL GROUP BY 1),
  t AS (SELECT *, (CAST('0x' || substr(sha256(CAST(k AS VARCHAR) || '|' || draw || '|1'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM c, (SELECT unnest(range(1, 201)) AS draw) r), w AS (SELECT *, {_POISSON} AS w FROM t),
  s AS (SELECT draw, sum(w * tpb) / nullif(sum(w * nb), 0) - sum(w * tpa) / nullif(sum(w * na), 0) AS d FROM w GROUP BY draw) SELECT count(d) AS draws, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM s""",
    "jn5_corroboration": f"WITH {_ACCEPTED} SELECT event_no, x.n AS accepted, x.pos AS feed_pos, x.pub AS publisher, x.score AS score FROM (SELECT event_no, unnest(list_transform(l, lambda a, i: struct_pack(n := CAST(i AS INTEGER), pos := a.pos, pub := a.pub, score := a.score))) AS x FROM accepted) t",
    "jn6_verified": f"""WITH {_ACCEPTED}, n AS (SELECT e.event_no, coalesce(len(l), 0) AS independent FROM (SELECT event_no FROM news_events WHERE event_no % 50 = 0) e LEFT JOIN accepted a ON a.event_no = e.event_no)
  SELECT event_no, independent, CASE WHEN independent >= 2 THEN 'multi-source' WHEN independent = 1 THEN 'multi-report' ELSE 'single-source' END AS tier, CAST(CASE WHEN independent >= 2 THEN least(99, 78 + 5 * least(independent - 1, 4)) WHEN independent = 1 THEN 70 ELSE 55 END AS INTEGER) AS confidence FROM n""",
    "jn1_first_wins": f"""WITH f AS (SELECT feed_pos AS k, lower(trim(source)) AS src, url, {similarity._tok('title')} AS w FROM article_feed), u AS (SELECT k, src, w, unnest(w) AS tok FROM f WHERE src IS NOT NULL),
  p AS (SELECT DISTINCT x.k AS a, y.k AS b FROM u x JOIN u y ON x.tok = y.tok AND x.src = y.src AND x.k < y.k WHERE {similarity._j('x.w', 'y.w')} >= 0.62 - 1e-12 UNION SELECT x.k, y.k FROM f x JOIN f y ON x.url = y.url AND x.k < y.k), {_dropped('p')}
  SELECT k AS feed_pos, NOT list_contains((SELECT ids FROM gone), k) AS kept FROM f""",
    "sr8_clusters": rf"""WITH x AS (SELECT coalesce(batch_no, -1) AS batch_no, row_id, {_TK5} AS t FROM incoming_articles),
  g AS (SELECT batch_no, list_reduce(list([struct_pack(id := row_id, t := t, ids := [row_id])] ORDER BY row_id), lambda acc, x: CASE WHEN coalesce(list_max({_SIMS}), 0) >= 0.28
    THEN list_transform(acc, lambda c, i: CASE WHEN i = list_position({_SIMS}, list_max({_SIMS})) THEN struct_pack(id := c.id, t := list_distinct(list_concat(c.t, x[1].t)), ids := list_concat(c.ids, x[1].ids)) ELSE c END) ELSE list_concat(acc, x) END) AS l FROM x GROUP BY batch_no),
  u AS (SELECT batch_no, unnest(l) AS c FROM g) SELECT batch_no, unnest(c.ids) AS row_id, c.id AS leader FROM u""",
    "ag32_weekly_terms": f"""WITH n AS (SELECT w AS entity, count(*) AS n FROM (SELECT unnest({_TK5}) AS w FROM incoming_articles) q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30), a AS (SELECT w AS entity, count(*) AS n FROM (SELECT unnest({_TK5}) AS w FROM articles) q GROUP BY 1)
  SELECT n.entity, n.n AS current, coalesce(a.n, 0) AS historical FROM (SELECT * FROM n WHERE length(entity) >= 4 ORDER BY n DESC, entity LIMIT 10) n LEFT JOIN a ON a.entity = n.entity""",
}
