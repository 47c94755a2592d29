"""Record-wise functions and audits of captured candidates: cleaning, provenance, identities, validity, verification tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from newsloom.operators.timestamps import host_of

# The character references that feeds use, what they stand for, in the order in which they are replaced.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
HTTP = r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]+"


def plain_text(x: Column) -> Column:
    """Character references replaced, tags dropped, blanks collapsed, none before punctuation; null stays null."""
    y = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), x)
    y = F.trim(F.regexp_replace(F.regexp_replace(y, r"<[^>]*>", " "), r"\s+", " "))
    return F.regexp_replace(y, r" ([.,;:!?])", "$1")


def first_text(*fields: Column) -> Column:
    """The first field that is not blank after cleaning; empty text if none."""
    return F.coalesce(*[F.nullif(plain_text(f), F.lit("")) for f in fields], F.lit(""))


def field_state(x: Column) -> Column:
    return F.when(x.isNull(), "missing_key").when(plain_text(x) == "", "blank").otherwise("present")


def candidate_id(url: Column, source: Column, title: Column, published: Column, pos: Column) -> Column:
    """Stable id of a candidate: by its url, or by what else tells it apart."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    identity = F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat_ws("|", some(source), some(title), some(published), some(pos)))
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(identity, 256), 1, 20))


def aware_timestamp(x: Column) -> Column:
    """Whether a text is an existing ISO 8601 time with an offset."""
    return F.coalesce(x.rlike(AWARE) & F.substring(x, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def http_url(x: Column) -> Column:
    return F.coalesce(x.rlike(HTTP), F.lit(False))


def recent(at: Column, as_of: Column, hours: int = 72, ahead: int = 6) -> Column:
    """Whether a time is at most `hours` before and `ahead` hours after as_of; null is not."""
    return F.coalesce((F.unix_seconds(as_of) - F.unix_seconds(at)).between(-ahead * 3600, hours * 3600), F.lit(False))


def sentences(x: Column) -> Column:
    """A text's sentences: cut at blanks after a full stop, exclamation or question mark."""
    return F.filter(F.split(F.regexp_replace(x, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def canonical_publisher(df: DataFrame, source: str, url: str, rules: DataFrame, out: str = "publisher") -> DataFrame:
    """df plus out: the name a rule (domain, name; a small table, read whole) gives to a url's host if it is the domain or one of its subdomains (the longest domain wins), else the host, else the cleaned label."""
    names = {r.domain.lower(): r.name for r in rules.where("domain is not null").collect()}
    host = F.regexp_replace(host_of(F.col(url)), r"^www\.|\.$", "")
    parts = F.split(host, r"\.")
    # the host and its parent domains, longest first
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<string,string>")
    named = F.filter(F.transform(parents, lambda p: F.try_element_at(known, p)), lambda n: n.isNotNull())
    label = F.nullif(F.trim(F.regexp_replace(F.lower(F.col(source)), r"\s+", " ")), F.lit(""))
    return df.withColumn(out, F.coalesce(F.try_element_at(named, F.lit(1)), F.nullif(host, F.lit("")), label, F.lit("unknown")))


def validity(df: DataFrame, pos: str, ident: str, required: list[str], url: str, stamp: str) -> DataFrame:
    """pos, errors of the records with errors, in a fixed order: required fields missing, id repeated (all but its first row), url and stamp invalid."""
    again = F.row_number().over(W.partitionBy(ident).orderBy(pos)) > 1
    codes = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", f"{c}_required") for c in required]
    codes += [F.when(again, "candidate_id_duplicate"), F.when(~http_url(F.col(url)), "url_invalid"), F.when(~aware_timestamp(F.col(stamp)), "timestamp_must_be_timezone_aware")]
    return df.select(pos, F.array_join(F.array_compact(F.array(*codes)), ",").alias("errors")).where("errors != ''")


def tiers(events: DataFrame, sources: DataFrame, event_id: str, source: str) -> DataFrame:
    """event_id, independent, tier of each event by its distinct sources (case and outer blanks aside)."""
    n = sources.where(F.col(event_id).isNotNull()).groupBy(event_id).agg(F.countDistinct(F.nullif(F.lower(F.trim(source)), F.lit(""))).alias("independent"))
    x = events.join(n, event_id, "left").withColumn("independent", F.coalesce("independent", F.lit(0)))
    return x.withColumn("tier", F.when(F.col("independent") >= 2, "multi-source").when(F.col("independent") == 1, "multi-report").otherwise("unverified"))
