"""Queries over sources, categories, identities and entities."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from newsloom.operators import coverage as C
from newsloom.operators.timestamps import host_of
from newsloom.session import table


def identities(spark, d):
    """Identities of each feed row: article, story and order-free event ids, and the key of its longer tokens."""
    from newsloom.functions.text import token_set
    from newsloom.operators.similarity import EXTENDED, WORDS4

    x = table(spark, d, "article_feed")
    t = F.coalesce("title", F.lit(""))
    return x.select(
        "feed_pos", F.substring(F.sha2(F.concat_ws("|", F.lower(t), F.coalesce("url", F.lit(""))), 256), 1, 16).alias("article_key"), F.substring(F.sha1(F.lower(t)), 1, 16).alias("story_key"),
        F.substring(F.sha1(F.array_join(F.slice(F.sort_array(token_set(t, WORDS4)), 1, 32), " ")), 1, 16).alias("event_key"), F.array_join(F.slice(F.sort_array(token_set(t, EXTENDED)), 1, 12), "|").alias("token_key"),
    )


def clean_summaries(spark, d):
    """Whitespace collapsed, trimmed, no space before punctuation, 1600 characters at most; blank becomes null."""
    s = F.regexp_replace(F.trim(F.regexp_replace("summary", r"\s+", " ")), r" ([.,;:!?])", "$1")
    return table(spark, d, "article_feed").select("feed_pos", F.nullif(F.substring(s, 1, 1600), F.lit("")).alias("summary"))


def first_delivery(spark, d):
    """First delivery of each article by collection, and how often it came."""
    x = table(spark, d, "article_feed").where("article_id is not null")
    return x.groupBy("article_id").agg(F.min("feed_pos").alias("feed_pos"), F.count(F.lit(1)).alias("deliveries"), F.min_by("title", "feed_pos").alias("title"))


def restored_metadata(spark, d):
    """Accepted articles with source and category of the last feed row of the same url, where it has them."""
    f = table(spark, d, "article_feed").where("url is not null").groupBy("url").agg(F.max_by(F.struct("source", "category"), "feed_pos").alias("last"))
    a = table(spark, d, "articles").select("row_id", "url", "source", "category")
    x = a.join(f, "url", "left")
    has = lambda c: F.coalesce(F.nullif(F.trim(F.col("last")[c]), F.lit("")), F.col(c))
    return x.select("row_id", has("source").alias("source"), has("category").alias("category"))


def events_upsert(spark, d):
    """Events as the mirror store keeps them: first and last date, greatest source count, the rest from the row opened last."""
    x = table(spark, d, "news_events")
    g = x.groupBy("event_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("source_count").alias("source_count"), F.max_by(F.struct("headline", "category"), "event_no").alias("m"))
    return g.select("event_id", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "source_count", "m.headline", "m.category")


def uncovered(spark, d):
    """Events without any recorded source (anti join), the gap list."""
    s = table(spark, d, "event_sources").where("event_id is not null").select("event_id").distinct()
    return table(spark, d, "news_events").join(s, "event_id", "left_anti").select("event_no", "event_id")


def sources_per_event(spark, d):
    """Distinct sources and urls of each event, duplicates of whole rows aside."""
    x = table(spark, d, "event_sources").where("event_id is not null")
    return x.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("sources"), F.countDistinct("url").alias("urls"), F.countDistinct("event_id", "source", "url", "date").alias("full_rows"))


def sampled(spark, d):
    """Ten articles of each category in the order of a seeded hash (reproducible stratified sample), and each stratum's rate."""
    x = table(spark, d, "articles").select("row_id", F.coalesce("category", F.lit("none")).alias("stratum"))
    key = F.sha2(F.concat_ws("|", F.lit("seed-1"), "stratum", F.col("row_id").cast("string")), 256)
    # ranked with a limit to each group, counted apart, so that no stratum is sorted whole
    first = x.withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy(key, "row_id"))).where("rank <= 10")
    n = x.groupBy("stratum").agg(F.count(F.lit(1)).alias("eligible"))
    return first.join(n, "stratum").select("stratum", "rank", "row_id", "eligible", F.round(F.least(F.lit(10), "eligible") / F.col("eligible"), 6).alias("rate"))


QUERIES = {
    "ag5_source_health": lambda s, d: C.source_health(table(s, d, "articles"), "source", "url", "importance"),
    "ag7_category_counts": lambda s, d: table(s, d, "article_feed").groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "ag23_coverage": lambda s, d: table(s, d, "article_feed").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("category").alias("categories")),
    "ag27_entities": lambda s, d: C.entity_mentions(table(s, d, "news_events"), "headline"),
    "ag28_entity_profiles": lambda s, d: C.entity_profiles(table(s, d, "news_events"), "headline", table(s, d, "articles"), "headline"),
    "jn12_restored_metadata": restored_metadata,
    "jn20_edges": lambda s, d: C.edges(table(s, d, "news_events"), "event_id", "headline"),
    "ag14_events_upsert": events_upsert,
    "ag29_sources_per_event": sources_per_event,
    "fl8_uncovered_events": uncovered,
    "fx5_identities": identities,
    "fx2_clean_summaries": clean_summaries,
    "fx15_hosts": lambda s, d: table(s, d, "article_feed").groupBy(F.coalesce(host_of(F.col("url")), F.lit("unknown")).alias("host")).agg(F.count(F.lit(1)).alias("n")),
    "ev4_field_coverage": lambda s, d: C.field_coverage(table(s, d, "article_feed"), ["summary", "source", "published", "region"], ["category", "source"]),
    "sk7_first_delivery": first_delivery,
    "st3_articles_not_in_feed": lambda s, d: table(s, d, "articles").select("article_id").distinct().join(table(s, d, "article_feed").select("article_id"), "article_id", "left_anti"),
    "st5_repeats": lambda s, d: table(s, d, "article_feed").agg(F.count(F.lit(1)).alias("scanned"), F.countDistinct("article_id").alias("articles"), (F.count(F.lit(1)) - F.countDistinct("article_id")).alias("repeats")),
    "sr10_stratified_sample": sampled,
}
_HOST = r"nullif(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '')"
_PUB = "coalesce(nullif(regexp_replace(" + _HOST.format(u="url") + r", '^www\.|\.$', '', 'g'), ''), nullif(trim(regexp_replace(lower(source), '\s+', ' ', 'g')), ''), 'unknown')"
_FIN = "CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0 ELSE {x} END"
_NAMES = f"regexp_extract_all(headline, '{C.NAMES}')"
_COMPANY = " OR ".join(f"contains(lower(p), '{h}')" for h in C.COMPANY)


def _entities(of: str) -> str:
    return f"(SELECT CASE WHEN {_COMPANY} THEN p ELSE lower(p) END AS entity, CASE WHEN {_COMPANY} THEN 'company' ELSE 'topic' END AS kind, count(*) AS mentions FROM (SELECT unnest({_NAMES}) AS p FROM {of}) t GROUP BY 1, 2)"


SQL = {
    "ag5_source_health": f"SELECT publisher, count(*) AS articles, count(*) FILTER (s >= 75) AS high_value, round(count(*) FILTER (s >= 75) / count(*), 6) AS rate FROM (SELECT {_PUB} AS publisher, {_FIN.format(x='importance')} AS s FROM articles) t GROUP BY publisher",
    "ag7_category_counts": "SELECT category, count(*) AS n FROM article_feed GROUP BY category",
    "ag23_coverage": "SELECT region, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories FROM article_feed GROUP BY region",
    "ag27_entities": f"SELECT * FROM {_entities('news_events')} e",
    "ag28_entity_profiles": f"SELECT a.entity, a.kind, a.mentions, coalesce(b.mentions, 0) AS earlier FROM {_entities('news_events')} a LEFT JOIN {_entities('articles')} b ON a.entity = b.entity AND a.kind = b.kind",
    "jn12_restored_metadata": """SELECT a.row_id, coalesce(nullif(trim(f.source), ''), a.source) AS source, coalesce(nullif(trim(f.category), ''), a.category) AS category FROM articles a LEFT JOIN (
  SELECT f.url, f.source, f.category FROM article_feed f JOIN (SELECT url, max(feed_pos) AS p FROM article_feed WHERE url IS NOT NULL GROUP BY url) m ON m.p = f.feed_pos) f ON f.url = a.url""",
    "jn20_edges": f"SELECT DISTINCT event_id AS from_node, unnest({_NAMES}) AS to_node FROM news_events",
    "ag14_events_upsert": """SELECT e.event_id, CAST(g.f AS VARCHAR) AS first_seen, CAST(g.l AS VARCHAR) AS last_seen, g.c AS source_count, e.headline, e.category FROM news_events e
  JOIN (SELECT event_id, min(first_seen) AS f, max(last_seen) AS l, max(source_count) AS c, max(event_no) AS m FROM news_events GROUP BY event_id) g ON g.m = e.event_no""",
    "ag29_sources_per_event": """SELECT e.event_id, count(*) AS n_rows, count(DISTINCT source) AS sources, count(DISTINCT url) AS urls, max(coalesce(f.n, 0)) AS full_rows FROM event_sources e
  LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, source, url, date FROM event_sources WHERE source IS NOT NULL AND url IS NOT NULL AND date IS NOT NULL) q GROUP BY event_id) f ON f.event_id = e.event_id
  WHERE e.event_id IS NOT NULL GROUP BY e.event_id""",
    "fl8_uncovered_events": "SELECT event_no, event_id FROM news_events n WHERE NOT EXISTS (SELECT 1 FROM event_sources s WHERE s.event_id = n.event_id)",
    "fx15_hosts": f"SELECT coalesce({_HOST.format(u='url')}, 'unknown') AS host, count(*) AS n FROM article_feed GROUP BY 1",
    "fx2_clean_summaries": r"""SELECT feed_pos, nullif(substr(regexp_replace(trim(regexp_replace(summary, '\s+', ' ', 'g')), ' ([.,;:!?])', '\1', 'g'), 1, 1600), '') AS summary FROM article_feed""",
    "fx5_identities": """SELECT feed_pos, substr(sha256(lower(coalesce(title, '')) || '|' || coalesce(url, '')), 1, 16) AS article_key, substr(sha1(lower(coalesce(title, ''))), 1, 16) AS story_key,
  substr(sha1(coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{4,}')))[1:32], ' '), '')), 1, 16) AS event_key,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9&.-]{2,}')))[1:12], '|'), '') AS token_key FROM article_feed""",
    "ev4_field_coverage": """SELECT CASE grouping_id(category, source) WHEN 3 THEN 'all' WHEN 1 THEN 'category' ELSE 'source' END AS dimension, CASE grouping_id(category, source) WHEN 3 THEN 'all' WHEN 1 THEN category ELSE source END AS value, count(*) AS n,
  count(*) FILTER (trim(summary) <> '') AS with_summary, count(*) FILTER (trim(source) <> '') AS with_source, count(*) FILTER (trim(published) <> '') AS with_published, count(*) FILTER (trim(region) <> '') AS with_region
  FROM article_feed GROUP BY GROUPING SETS ((), (category), (source))""",
    "sk7_first_delivery": """SELECT f.article_id, f.feed_pos, g.n AS deliveries, f.title FROM article_feed f JOIN (SELECT article_id, min(feed_pos) AS p, count(*) AS n FROM article_feed WHERE article_id IS NOT NULL GROUP BY article_id) g ON g.p = f.feed_pos""",
    "st3_articles_not_in_feed": "SELECT DISTINCT article_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM article_feed f WHERE f.article_id = a.article_id)",
    "st5_repeats": "SELECT count(*) AS scanned, count(DISTINCT article_id) AS articles, count(*) - count(DISTINCT article_id) AS repeats FROM article_feed",
    "sr10_stratified_sample": """SELECT stratum, CAST(rank AS INTEGER) AS rank, row_id, eligible, round(least(10, eligible) / eligible, 6) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed-1|' || stratum || '|' || row_id), row_id) AS rank, count(*) OVER (PARTITION BY stratum) AS eligible
  FROM (SELECT row_id, coalesce(category, 'none') AS stratum FROM articles) a) t WHERE rank <= 10""",
}
