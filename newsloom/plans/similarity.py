"""Queries over token overlaps of headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import matching as M, search as Q, similarity as S
from newsloom.session import broadcast_if_small, table

EVERY = 50  # of searches, the rows whose id it divides are the queries


def events(spark, d):
    return S.with_tokens(table(spark, d, "news_events").select("event_no", "category", "headline"), "headline")


def near_titles(spark, d):
    """Pairs of feed rows of one source (whatever its case and outer blanks) with titles overlapping by 0.62."""
    x = table(spark, d, "article_feed").where("source is not null").select("feed_pos", F.lower(F.trim("source")).alias("src"), "title")
    return S.self_join(S.with_tokens(x, "title").drop("title"), "feed_pos", 0.62, ["src"]).select("id_a", "id_b", F.round("overlap", 6).alias("overlap"))


def repeated_headlines(spark, d):
    """Each accepted article that recurs among the news events: by event_id, or by headlines overlapping by 0.55, and how many of these there are."""
    a = table(spark, d, "articles").select("row_id", "event_id", "headline")
    sets = S.with_tokens(a, "headline").select("row_id", "tokens")
    near = S.similarity_join(events(spark, d).select("event_no", "tokens"), sets, "event_no", "row_id", 0.55).groupBy("row_id").agg(F.count(F.lit(1)).alias("n_headlines"))
    known = table(spark, d, "news_events").where("event_id is not null").select("event_id").distinct().withColumn("by_id", F.lit(True))
    x = a.select("row_id", "event_id").join(known, "event_id", "left").join(near, "row_id", "left")
    return x.where("by_id or n_headlines > 0").select("row_id", F.coalesce("by_id", F.lit(False)).alias("by_id"), F.coalesce("n_headlines", F.lit(0)).alias("n_headlines"))


def queried(spark, d, tokens):
    """event_no, headline, tokens of the events that are queries."""
    return table(spark, d, "news_events").where(F.col("event_no") % EVERY == 0).select("event_no", "headline", tokens(F.col("headline")).alias("tokens"))


def event_queries(spark, d):
    """The queried events' words for event matches."""
    return M.words_of(table(spark, d, "news_events").where(F.col("event_no") % EVERY == 0), "event_no", "headline")


def similar_events(spark, d):
    """For each queried event the eight most similar of all accepted headlines, from an overlap of 0.12 on; ties go to the earlier row."""
    tok = lambda c: S.token_set(c, S.EXTENDED)
    old = table(spark, d, "articles").select("row_id", tok(F.col("headline")).alias("tokens"))
    return Q.search(queried(spark, d, tok), old, "event_no", "row_id", 0.12, most=8).select("event_no", "row_id", F.round("overlap", 6).alias("overlap"), "rank")


def asked(spark, d):
    """Answers to each queried event's headline taken as a question: the three accepted headlines that hold the greatest share of its words."""
    tok = lambda c: S.token_set(c, S.EXTENDED)
    old = table(spark, d, "articles").select("row_id", tok(F.col("headline")).alias("tokens"))
    q = queried(spark, d, tok)
    got = Q.search(q, old, "event_no", "row_id", 0.0, most=3, order=["shared", "r"])
    return got.join(broadcast_if_small(q.select("event_no", F.size("tokens").alias("n")), 100_000), "event_no").select("event_no", "row_id", F.round(F.col("shared") / F.col("n"), 6).alias("contained"), "rank")


def matched(spark, d):
    """Queried events and accepted headlines sharing two words, with the scores and verdicts of the four event matches; pairs that none of them accepts are left out."""
    old = table(spark, d, "articles").select("row_id", "headline")
    x = M.event_matches(event_queries(spark, d), M.words_of(old, "row_id", "headline")).withColumnsRenamed({"q": "event_no", "r": "row_id"})
    x = x.withColumns({c: F.round(c, 6) for c in ("selection", "research")})
    return x.where("selection >= 0.64 or research > 0 or strong or relaxed")


def linked(spark, d):
    """The first twenty pairs of queried events, in their order, that share two words or more, and how many."""
    q = queried(spark, d, lambda c: S.token_set(c, S.EXTENDED))
    got = Q.search(q, q.select(F.col("event_no").alias("other"), "tokens"), "event_no", "other", 0.0, shared=2).where("event_no < other")
    return got.orderBy("event_no", "other").limit(20).select("event_no", "other", F.col("shared").alias("strength"))


def trends(spark, d):
    return S.trend_terms(table(spark, d, "news_events"), table(spark, d, "articles"), "event_no", "headline", "headline")


def novelty(spark, d):
    """1 - greatest overlap of each incoming headline with the last 1000 accepted headlines (the bound is part of the definition)."""
    inc = S.with_tokens(table(spark, d, "incoming_articles").select("row_id", "headline"), "headline").drop("headline")
    last = S.with_tokens(table(spark, d, "articles").orderBy(F.desc("row_id")).limit(1000).select("headline"), "headline")
    return Q.greatest_overlap(inc, "row_id", last).select("row_id", F.round(100 * (1 - F.col("best")), 4).alias("novelty"))


def tokens_per_row(spark, d):
    """Counts of the five kinds of tokens of each feed title."""
    from newsloom.functions.text import token_set

    x = table(spark, d, "article_feed").select("feed_pos", "title")
    kinds = {"tk1": (S.WORDS4, True), "tk4": (S.WORDS3, True), "tk5": (S.EXTENDED, True), "names": (r"\b[A-Z][A-Za-z.'-]{2,}\b", False)}
    return x.select("feed_pos", *[F.size(token_set(F.col("title"), p, low)).alias(k) for k, (p, low) in kinds.items()])


QUERIES = {
    "jn1_near_titles": near_titles, "jn13_repeated_headlines": repeated_headlines, "jn15_similar_events": similar_events,
    "jn2_jn3_jn4_event_matches": matched, "jn16_linked_events": linked, "jn19_asked": asked,
    "wn1_novelty": novelty, "wn2_trend_terms": trends, "tk_token_counts": tokens_per_row,
}


def _tok(text: str, pattern: str = "[a-z]{4,}") -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '{pattern}'))"


def _j(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b})))"


def _pairs(t: float, a: str, b: str, ka: str, kb: str, extra: str = "") -> str:
    """Pairs by any shared token: exact, and quadratic only in the tokens' frequencies."""
    return f"""(SELECT DISTINCT x.k AS {ka}, y.k AS {kb}, round({_j('x.tokens', 'y.tokens')}, 6) AS overlap, {_j('x.tokens', 'y.tokens')} AS raw
  FROM (SELECT *, unnest(tokens) AS tok FROM {a}) x JOIN (SELECT *, unnest(tokens) AS tok FROM {b}) y ON x.tok = y.tok {extra} WHERE {_j('x.tokens', 'y.tokens')} >= {t} - 1e-12)"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def match_parts(other: str, key: str, title: str) -> str:
    """Common table expressions that end in s(event_no, row_id, common, selection, research, strong, relaxed) for queried events and the rows of another table that share two event words."""
    inflected = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.ALIASES.items()) + "}"
    ev = lambda c: f"list_distinct(list_transform(list_filter({_tok(c, '[a-z]{3,}')}, lambda w: NOT list_contains({_list(M.STOP)}, w)), lambda w: coalesce({inflected}[w], w)))"
    caps = lambda c: rf"list_transform(regexp_extract_all(coalesce({c}, ''), '\b[A-Z][A-Za-z.''-]{{2,}}\b'), lambda w: lower(w))"
    nm = lambda c, stop: f"list_distinct(list_filter({caps(c)}, lambda w: NOT list_contains({_list(M.NO_NAMES + (M.STOP if stop else []))}, w)))"
    strip = lambda x: f"list_distinct(list_transform({x}, lambda w: trim(w, '.,')))"
    cols = lambda k, c: f"{k} AS k, {_tok(c)} AS w, {ev(c)} AS e, {nm(c, False)} AS n, {strip(nm(c, True))} AS m"
    among = lambda v: f"len(list_intersect(c, {_list(v)}))"
    beyond = lambda v: f"len(c) - len(list_intersect(c, {_list(v)}))"
    return f"""q AS (SELECT {cols('event_no', 'headline')} FROM news_events WHERE event_no % 50 = 0), a AS (SELECT {cols(key, title)} FROM {other}),
  p AS (SELECT q.k AS event_no, a.k AS row_id, list_intersect(q.e, a.e) AS c, {_j('q.e', 'a.e')} AS base, list_intersect(q.w, a.w) AS wc, {_j('q.w', 'a.w')} AS wb, len(list_intersect(q.n, a.n)) > 0 AS nn, len(list_intersect(q.m, a.m)) > 0 AS mm FROM q, a WHERE len(list_intersect(q.e, a.e)) >= 2),
  s AS (SELECT event_no, row_id, len(c) AS common, round(CASE WHEN wb >= 0.72 THEN 0.90 WHEN nn AND len(list_intersect(wc, {_list(M.SELECTION_EVENTS)})) >= 1 AND len(wc) >= 2 THEN greatest(wb, 0.76) WHEN nn AND len(wc) >= 4 THEN greatest(wb, 0.70) WHEN wb >= 0.50 AND len(wc) >= 4 THEN greatest(wb, 0.64) ELSE wb END, 6) AS selection,
    round(CASE WHEN base >= 0.72 AND len(c) >= 5 THEN base WHEN ({among(M.RESEARCH_EVENTS)} >= 1 AND len(c) >= 4 AND {beyond(M.RESEARCH_GENERIC)} >= 3 AND base >= 0.25) OR ({among(M.RESEARCH_EVENTS)} >= 2 AND len(c) >= 5 AND base >= 0.30) THEN greatest(base, 0.56) ELSE 0.0 END, 6) AS research,
    {among(M.STRONG_EVENTS)} >= 1 AND {beyond(M.STRONG_GENERIC)} >= (CASE WHEN mm THEN 4 ELSE 5 END) AS strong, mm AND {among(M.RELAXED_EVENTS)} >= 1 AND {beyond(M.RELAXED_GENERIC)} >= 2 AND len(c) >= 4 AS relaxed FROM p)"""


_Q5 = f"q AS (SELECT event_no AS k, {_tok('headline', S.EXTENDED)} AS tokens FROM news_events WHERE event_no % 50 = 0)"
_A5 = f"a AS (SELECT row_id AS k, {_tok('headline', S.EXTENDED)} AS tokens FROM articles)"
_E = f"e AS (SELECT event_no AS k, {_tok('headline')} AS tokens FROM news_events)"
_A = f"a AS (SELECT row_id AS k, {_tok('headline')} AS tokens FROM articles)"
_I = f"i AS (SELECT row_id AS k, {_tok('headline')} AS tokens FROM incoming_articles)"
SQL = {
    "jn1_near_titles": f"WITH f AS (SELECT feed_pos AS k, lower(trim(source)) AS src, {_tok('title')} AS tokens FROM article_feed WHERE source IS NOT NULL) SELECT id_a, id_b, overlap FROM {_pairs(0.62, 'f', 'f', 'id_a', 'id_b', 'AND x.src = y.src AND x.k < y.k')} p",
    "jn13_repeated_headlines": f"""WITH {_E}, {_A}, n AS (SELECT a.k, count(*) AS n FROM e, a WHERE {_j('e.tokens', 'a.tokens')} >= 0.55 - 1e-12 GROUP BY a.k)
  SELECT r.row_id, r.event_id IN (SELECT event_id FROM news_events) AND r.event_id IS NOT NULL AS by_id, coalesce(n.n, 0) AS n_headlines FROM articles r LEFT JOIN n ON n.k = r.row_id WHERE n.n > 0 OR r.event_id IN (SELECT event_id FROM news_events)""",
    "jn15_similar_events": f"""WITH {_Q5}, {_A5}, p AS (SELECT q.k AS event_no, a.k AS row_id, {_j('q.tokens', 'a.tokens')} AS o FROM q, a WHERE len(a.tokens) > 0)
  SELECT event_no, row_id, round(o, 6) AS overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY o DESC, row_id) AS rank FROM p WHERE o >= 0.12) t WHERE rank <= 8""",
    "jn19_asked": f"""WITH {_Q5}, {_A5}, p AS (SELECT q.k AS event_no, a.k AS row_id, len(list_intersect(q.tokens, a.tokens)) AS s, len(q.tokens) AS n FROM q, a)
  SELECT event_no, row_id, round(s / n, 6) AS contained, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_no ORDER BY s DESC, row_id) AS rank FROM p WHERE s > 0) t WHERE rank <= 3""",
    "jn16_linked_events": f"""WITH {_Q5} SELECT a.k AS event_no, b.k AS other, CAST(len(list_intersect(a.tokens, b.tokens)) AS INTEGER) AS strength FROM q a, q b WHERE a.k < b.k AND len(list_intersect(a.tokens, b.tokens)) >= 2 ORDER BY a.k, b.k LIMIT 20""",
    "jn2_jn3_jn4_event_matches": f"WITH {match_parts('articles', 'row_id', 'headline')} SELECT event_no, row_id, selection, research, strong, relaxed FROM s WHERE selection >= 0.64 OR research > 0 OR strong OR relaxed",
    "wn1_novelty": f"""WITH {_I}, l AS (SELECT {_tok('headline')} AS tokens FROM (SELECT headline FROM articles ORDER BY row_id DESC LIMIT 1000) t), b AS (SELECT i.k, max({_j('i.tokens', 'l.tokens')}) AS best FROM i, l GROUP BY i.k)
  SELECT i.k AS row_id, round(100 * (1 - coalesce(b.best, 0)), 4) AS novelty FROM i LEFT JOIN b ON b.k = i.k""",
    "wn2_trend_terms": f"""WITH df AS (SELECT tok, count(*) AS df FROM (SELECT unnest({_tok('headline')}) AS tok FROM articles) q GROUP BY tok), w AS (SELECT event_no, unnest({_tok('headline')}) AS tok FROM news_events)
  SELECT n.event_no, count(*) FILTER (df >= 2) AS repeated, count(*) FILTER (df >= 3) AS strong, count(*) FILTER (w.tok IS NOT NULL AND df IS NULL) AS novel FROM news_events n LEFT JOIN w ON w.event_no = n.event_no LEFT JOIN df ON df.tok = w.tok GROUP BY n.event_no""",
    "tk_token_counts": rf"""SELECT feed_pos, CAST(len({_tok('title')}) AS INTEGER) AS tk1, CAST(len({_tok('title', '[a-z]{3,}')}) AS INTEGER) AS tk4, CAST(len({_tok('title', '[a-z][a-z0-9&.-]{2,}')}) AS INTEGER) AS tk5,
  CAST(len(list_distinct(regexp_extract_all(coalesce(title, ''), '\b[A-Z][A-Za-z.''-]{{2,}}\b'))) AS INTEGER) AS names FROM article_feed""",
}
