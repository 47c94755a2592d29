"""Counts of sources, hosts, categories and entities; exact distinct counts, one pass per grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.timestamps import host_of

# What a capitalised phrase is, and the parts that make it a company.
NAMES = r"\b[A-Z][A-Za-z0-9&.-]{2,}(?:\s+[A-Z][A-Za-z0-9&.-]{2,}){0,2}"
COMPANY = ["ltd", "limited", "inc", "corp", "bank", "steel", "motors", "energy", "industries", "group"]


def finite(x: Column, default: float = 0.0) -> Column:
    """x, or the default where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(default)).otherwise(x)


def publisher(source: Column, url: Column) -> Column:
    """Canonical publisher: the url's host without www., else the cleaned label, else unknown."""
    host = F.regexp_replace(host_of(url), r"^www\.|\.$", "")
    label = F.nullif(F.trim(F.regexp_replace(F.lower(source), r"\s+", " ")), F.lit(""))
    return F.coalesce(F.nullif(host, F.lit("")), label, F.lit("unknown"))


def source_health(df: DataFrame, source: str, url: str, score: str, high: float = 75.0) -> DataFrame:
    g = df.groupBy(publisher(F.col(source), F.col(url)).alias("publisher")).agg(F.count(F.lit(1)).alias("articles"), F.count_if(finite(F.col(score)) >= high).alias("high_value"))
    return g.withColumn("rate", F.round(F.col("high_value") / F.col("articles"), 6))


def field_coverage(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Rows and rows with a non-blank value of each field: overall and by each column of by, in one pass of grouping sets."""
    some = [F.count_if(F.trim(F.col(f)) != "").alias(f"with_{f}") for f in fields]
    g = df.groupingSets([[], *[[b] for b in by]], *by).agg(F.count(F.lit(1)).alias("n"), *some, F.grouping_id().alias("gid"))
    full = 2 ** len(by) - 1
    name = F.lit("all")
    value = F.lit("all")
    for i, b in enumerate(by):
        own = F.col("gid") == full - 2 ** (len(by) - 1 - i)
        name, value = F.when(own, b).otherwise(name), F.when(own, F.col(b)).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n", *[f"with_{f}" for f in fields])


def entity_mentions(df: DataFrame, text: str) -> DataFrame:
    """entity, kind, mentions: capitalised phrases of one to three words; those with a part of COMPANY in them are companies, the others topics, in lower case."""
    x = df.select(F.explode(F.regexp_extract_all(text, F.lit(NAMES), F.lit(0))).alias("phrase"))
    company = F.exists(F.array(*map(F.lit, COMPANY)), lambda h: F.contains(F.lower("phrase"), h))
    return x.groupBy(F.when(company, F.col("phrase")).otherwise(F.lower("phrase")).alias("entity"), F.when(company, "company").otherwise("topic").alias("kind")).agg(F.count(F.lit(1)).alias("mentions"))


def entity_profiles(now: DataFrame, now_text: str, before: DataFrame, before_text: str) -> DataFrame:
    a, b = entity_mentions(now, now_text), entity_mentions(before, before_text).withColumnRenamed("mentions", "earlier")
    return a.join(b, ["entity", "kind"], "left").select("entity", "kind", "mentions", F.coalesce("earlier", F.lit(0)).alias("earlier"))


def edges(df: DataFrame, event: str, text: str) -> DataFrame:
    """event, entity: the distinct mentions that link events to entities."""
    return df.select(F.col(event).alias("from_node"), F.explode(F.regexp_extract_all(text, F.lit(NAMES), F.lit(0))).alias("to_node")).distinct()
