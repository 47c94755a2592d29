"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators import timestamps as T
from newsloom.session import stage, table


def _zones(spark: SparkSession, d: str, hosts: DataFrame) -> DataFrame:
    return stage(T.host_zones(table(spark, d, "article_feed").select("url", "published", "collected_at"), "published", "url", hosts, "collected_at"), "p1-zones")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Both tables with the zones estimated from the feed's ingestion times; articles have none, and their order says nothing about time."""
    hosts = table(spark, d, "feed_hosts")
    zones = _zones(spark, d, hosts)
    feed = T.to_instants(table(spark, d, "article_feed").select(F.col("feed_pos").alias("rec_id"), "url", "published"), "published", "url", hosts, zones, only_named=True)
    mirror = T.to_instants(table(spark, d, "articles").select(F.col("row_id").alias("rec_id"), "url", "date"), "date", "url", hosts, zones, only_named=True)
    rows = lambda x, kind: x.select(F.lit(kind).alias("rec_type"), "rec_id", "epoch_s")
    return rows(feed, "article_feed").unionByName(rows(mirror, "articles"))


def p1_zone_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every host of the feed: zone by the directory, zone estimated without it among all of its zones, and violations of both."""
    hosts = table(spark, d, "feed_hosts")
    x = table(spark, d, "article_feed").select(T.host_of(F.col("url")).alias("host"), "published", "collected_at")
    x = x.join(F.broadcast(hosts.select("host", "day_first")), "host")  # fixed table of known size
    x = T.parse_stamps(x, "published", "day_first").where("_ts_zone = '' and not _ts_dated and _ts_local is not null")
    zones = sorted(r.zone_name for r in hosts.where("zone_name is not null").select("zone_name").distinct().collect())
    scored = T.choose_zones(x, "host", "_ts_local", "collected_at", zones)
    home = scored.join(F.broadcast(hosts.select("host", F.col("zone_name").alias("zone"))), ["host", "zone"]).select("host", F.col("zone").alias("home_zone"), F.col("violations").alias("home_violations"))
    return scored.where("rank = 1").join(home, "host", "left").select("host", F.col("zone").alias("estimated_zone"), "n", "violations", "home_zone", "home_violations")


QUERIES = {"p1_found": p1_found, "p1_zone_audit": p1_zone_audit}


def _found_sql() -> str:
    """The same instants with every host's zone taken from the directory."""
    form = lambda f, to: f"WHEN regexp_matches(v, '{f}') THEN regexp_replace(v, '{f}', '{to}')"
    months = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"
    pairs = lambda d: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}"
    signed = r"regexp_extract(zone, '([+-]\d{2}):?(\d{2})?$', 1)"
    return rf"""WITH h AS (SELECT lower(host) AS host, arg_min(zone_name, host) AS home, arg_min(day_first, host) AS day_first FROM feed_hosts WHERE host IS NOT NULL GROUP BY 1),
  r AS (SELECT 'article_feed' AS rec_type, feed_pos AS rec_id, published AS v, url FROM article_feed UNION ALL SELECT 'articles', row_id, date, url FROM articles),
  x AS (SELECT rec_type, rec_id, trim(regexp_replace(v, '^\s*(?i:published|updated|posted)\s*:?\s+', '')) AS v, home, coalesce(day_first, true) AS day_first FROM r LEFT JOIN h ON h.host = lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))),
  p AS (SELECT rec_type, rec_id, home, string_split(CASE WHEN regexp_matches(v, '{T._EPOCH}') THEN v {form(T._ISO, r"\1|\2|\3|\4|\5|\6||\7")} {form(T._DAY_MONTH, r"\3|\2|\1|\4|\5|\6|\7|\8")} {form(T._MONTH_DAY, r"\3|\1|\2|\4|\5|\6|\7|\8")}
    WHEN regexp_matches(v, '{T._SLASHES}') THEN CASE WHEN day_first THEN regexp_replace(v, '{T._SLASHES}', '\3|\2|\1|\4|\5|\6|\7|\8') ELSE regexp_replace(v, '{T._SLASHES}', '\3|\1|\2|\4|\5|\6|\7|\8') END END, '|') AS p FROM x),
  f AS (SELECT *, len(p) = 1 AS number, TRY_CAST(p[1] AS BIGINT) AS n, CASE WHEN len(p[1]) = 2 THEN TRY_CAST(p[1] AS INTEGER) + CASE WHEN TRY_CAST(p[1] AS INTEGER) < 70 THEN 2000 ELSE 1900 END ELSE TRY_CAST(p[1] AS INTEGER) END AS y,
    coalesce(TRY_CAST(p[2] AS INTEGER), list_position({months}, lower(substr(p[2], 1, 3)))) AS m, TRY_CAST(p[3] AS INTEGER) AS d, coalesce(TRY_CAST(p[4] AS INTEGER), 0) AS h, lower(substr(p[7], 1, 1)) AS half, coalesce(TRY_CAST(p[5] AS INTEGER), 0) AS mi, coalesce(TRY_CAST(p[6] AS INTEGER), 0) AS s, upper(p[8]) AS zone FROM p WHERE p IS NOT NULL),
  t AS (SELECT *, CASE WHEN NOT number AND y > 0 AND m BETWEEN 1 AND 12 THEN TRY(make_timestamp(y, m, d, CASE WHEN half = '' THEN h WHEN h NOT BETWEEN 1 AND 12 THEN NULL ELSE h % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END, mi, s)) END AS wall,
    CASE WHEN {signed} <> '' THEN (CASE WHEN substr({signed}, 1, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr({signed}, 2, 2) AS INTEGER) * 3600 + 60 * coalesce(TRY_CAST(regexp_extract(zone, '[+-]\d{{2}}:?(\d{{2}})$', 1) AS INTEGER), 0))
      WHEN zone <> '' THEN coalesce(CASE WHEN starts_with(home, 'Australia/') THEN {pairs(T.AUSTRALIAN)}[zone] END, {pairs(T.ABBREVIATIONS)}[zone]) END AS off FROM f),
  e AS (SELECT rec_type, rec_id, CASE WHEN number THEN CASE WHEN len(p[1]) = 13 THEN n // 1000 ELSE n END WHEN p[4] = '' THEN epoch(wall) WHEN off IS NOT NULL THEN epoch(wall) - off
    WHEN timezone(home, timezone(home, wall) - INTERVAL 1 HOUR) = wall THEN epoch(timezone(home, wall)) - 3600 ELSE epoch(timezone(home, wall)) END AS epoch_s FROM t)
  SELECT rec_type, rec_id, CAST(epoch_s AS BIGINT) AS epoch_s FROM e WHERE epoch_s IS NOT NULL"""


SQL = {"p1_found": _found_sql()}
