"""Problem 1: text stamps of many forms, precisions and zones become one UTC instant.

A stamp is matched against five written forms and rewritten, inside the JVM, to
year|month|day|hour|minute|second|am/pm|zone; the instant follows from these parts.
A stamp without zone needs the zone of its feed. ``choose_zones`` estimates it for every host: every candidate
zone's whole offset history is applied to the zone-free stamps of a host and the candidate with the
fewest violations (stamp later than its ingestion, or older than the window) wins. A directory of home zones is the prior: the
zone it names for a host loses only to one with SLACK fewer violations. Other ties go to the smallest mean lag, then to the zone's name.
Rows without an ingestion time are held against their sequence (``sequence_times``): the range of the instants known around the same place.

Defined results: null, blank and unreadable stamps, dates that do not exist, times without a date and
relative wordings give null; a zone-free time of a host without any candidate gives null; an empty table
gives an empty table. Extra columns are kept; the columns added are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from newsloom.session import broadcast_if_small

# Month names by their first three letters, and offsets in seconds of zone abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200,
    "EET": 7200, "EEST": 10800, "MSK": 10800, "EAT": 10800, "IST": 19800, "NPT": 20700, "JST": 32400, "KST": 32400,
    "AEST": 36000, "AEDT": 39600, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200,
    "MDT": -21600, "PST": -28800, "PDT": -25200,
}
AUSTRALIAN = {"EST": 36000, "EDT": 39600}

WINDOW_DAYS = 45
SLACK = 3, 0.02  # violations, and share of a host's stamps, that the directory's zone may have more than another
QUARTER = 900  # seconds; offsets are whole multiples
PLACES = 10_000  # parts of a sequence
SMALL = 100_000

_ZONE = r"(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5}"
_TIME = rf"(?:,?\s+(\d{{1,2}})[:.](\d{{2}})(?:[:.](\d{{2}})(?:[.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*({_ZONE})?)?$"
_ISO = rf"^(\d{{4}})-?(\d{{2}})-?(\d{{2}})(?:[Tt ]+(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,]\d+)?)?\s*({_ZONE})?)?$"
_DAY_MONTH = r"^(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3,9})\.?,?[\s-]+(\d{4}|\d{2})" + _TIME
_MONTH_DAY = r"^(?:[A-Za-z]{3,9},\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _TIME
_SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME
_EPOCH = r"^(?:\d{10}|\d{13})$"


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _parts(value: Column, day_first: Column) -> Column:
    v = F.trim(F.regexp_replace(value, r"^\s*(?i:published|updated|posted)\s*:?\s+", ""))
    slash = F.when(F.coalesce(day_first, F.lit(True)), F.regexp_replace(v, _SLASHES, "$3|$2|$1|$4|$5|$6|$7|$8")).otherwise(F.regexp_replace(v, _SLASHES, "$3|$1|$2|$4|$5|$6|$7|$8"))
    return (
        F.when(v.rlike(_EPOCH), v)
        .when(v.rlike(_ISO), F.regexp_replace(v, _ISO, "$1|$2|$3|$4|$5|$6||$7"))
        .when(v.rlike(_DAY_MONTH), F.regexp_replace(v, _DAY_MONTH, "$3|$2|$1|$4|$5|$6|$7|$8"))
        .when(v.rlike(_MONTH_DAY), F.regexp_replace(v, _MONTH_DAY, "$3|$1|$2|$4|$5|$6|$7|$8"))
        .when(v.rlike(_SLASHES), slash)
    )


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once (a one-element transform binds it)."""
    return F.transform(F.array(value), body)[0]


def parsed(value: Column, day_first: Column) -> Column:
    """Struct of local (wall clock read as UTC), zone (text or ''), dated (no time of day), epoch (epoch numbers); null if no form fits."""

    def read(p: Column) -> Column:
        num = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit("")).try_cast("int")
        text = lambda i: F.get(p, F.lit(i))
        is_epoch = F.size(p) == 1
        month = F.coalesce(num(1), F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(text(1), 1, 3))).cast("int"), F.lit(0)))
        year = F.when(F.length(text(0)) == 2, num(0) + F.when(num(0) < 70, 2000).otherwise(1900)).otherwise(num(0))
        half = F.lower(F.substring(text(6), 1, 1))
        hour = _let(F.coalesce(num(3), F.lit(0)), lambda h: F.when(half == "", h).when(~h.between(1, 12), F.lit(None)).otherwise(h % 12 + F.when(half == "p", 12).otherwise(0)))
        local = F.try_make_timestamp(_let(year, lambda y: F.when(y > 0, y)), month, num(2), hour, F.coalesce(num(4), F.lit(0)), F.coalesce(num(5), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC"))
        long = text(0).try_cast("long")
        return F.struct(
            F.when(~is_epoch, local).alias("local"),
            F.when(~is_epoch, F.upper(text(7))).alias("zone"),
            (~is_epoch & (text(3) == "")).alias("dated"),
            F.when(is_epoch, F.when(F.length(text(0)) == 13, F.floor(long / 1000)).otherwise(long)).cast("long").alias("epoch"),
        )

    return _let(F.split(_parts(value, day_first), r"\|"), lambda p: F.when(p.isNotNull(), read(p)))


def parse_stamps(df: DataFrame, value: str, day_first: str, prefix: str = "_ts") -> DataFrame:
    """Add {prefix}_local, {prefix}_zone, {prefix}_dated and {prefix}_epoch, the fields of parsed()."""
    x = df.withColumn(f"{prefix}_all", parsed(F.col(value), F.col(day_first)))
    return x.withColumns({f"{prefix}_{k}": F.col(f"{prefix}_all")[k] for k in ("local", "zone", "dated", "epoch")}).drop(f"{prefix}_all")


def _offset(zone: Column, home: Column) -> Column:
    digits = F.regexp_extract(zone, r"([+-]\d{2}):?(\d{2})?$", 1)
    hours, minutes = F.substring(digits, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    named = F.coalesce(F.when(home.startswith("Australia/"), F.try_element_at(pairs(AUSTRALIAN), zone)), F.try_element_at(pairs(ABBREVIATIONS), zone))
    return F.when(digits != "", F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60)).otherwise(named)


def choose_zones(stamps: DataFrame, host: str, local: str, ingested: str, zones: list[str], directory: DataFrame | None = None, window_days: int = WINDOW_DAYS, earliest: str | None = None) -> DataFrame:
    """host, zone, n, violations, mean_lag_s, at_home (the directory names it) of every candidate zone, and rank 1 for the one chosen.

    Stamps are counted by host, hour of local time and quarters of an hour between it and the ingestion, which decides all violations, before
    they meet the zones; so a hot host costs no more than these cells, whose number does not grow with the rows. earliest: a column with the
    time that takes the place of the window's beginning; lags then count from the middle of the two.
    """
    x = stamps.where(F.col(host).isNotNull() & F.col(local).isNotNull() & F.col(ingested).isNotNull())
    behind = F.floor((F.unix_seconds(F.col(ingested).cast("timestamp")) - F.unix_seconds(F.col(local))) / QUARTER)
    few = F.least(F.greatest(behind, F.lit(-2 * 96)), F.lit((window_days + 2) * 96))  # beyond, no offset changes the verdict
    span = F.lit(window_days * 86400) if earliest is None else F.floor((F.unix_seconds(ingested) - F.unix_seconds(earliest)) / QUARTER) * QUARTER
    cells = x.groupBy(F.col(host).alias("host"), F.timestamp_seconds(F.floor(F.unix_seconds(F.col(local)) / 3600) * 3600).alias("at"), few.alias("behind"), span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    scored = cells.withColumn("zone", F.explode(F.array(*map(F.lit, zones)).cast("array<string>")))
    scored = scored.withColumn("lag", F.col("behind") * QUARTER + F.unix_seconds("at") - F.unix_seconds(F.to_utc_timestamp("at", F.col("zone"))))
    fits = (F.col("lag") >= 0) & (F.col("lag") <= F.col("span"))
    middle = F.lit(0) if earliest is None else F.col("span") / 2
    scored = scored.groupBy("host", "zone").agg(F.sum("n").alias("n"), F.sum(F.when(fits, 0).otherwise(F.col("n"))).alias("violations"), (F.sum(F.when(fits, (F.col("lag") - middle) * F.col("n"))) / F.sum(F.when(fits, F.col("n")))).alias("mean_lag_s"))
    if directory is None:
        scored = scored.withColumn("at_home", F.lit(False))
    else:
        home = directory.where("host is not null and zone_name is not null").select(F.lower("host").alias("host"), F.col("zone_name").alias("zone"), F.lit(True).alias("at_home")).distinct()
        scored = scored.join(broadcast_if_small(home, SMALL), ["host", "zone"], "left").withColumn("at_home", F.coalesce("at_home", F.lit(False)))
    slack = F.when(F.col("at_home"), F.greatest(F.lit(SLACK[0]), SLACK[1] * F.col("n"))).otherwise(0)
    order = W.partitionBy("host").orderBy(F.col("violations") - slack, F.desc("at_home"), F.abs("mean_lag_s").asc_nulls_last(), "zone")  # a row a zone
    return scored.withColumn("rank", F.row_number().over(order))


def sequence_times(df: DataFrame, order: str, instant: str, first: str, last: str) -> DataFrame:
    """df plus first and last, three times the range of the known instants (UTC seconds in column instant, null if unknown) around each row's place in the sequence, as timestamps; null where none is known.

    A part of the sequence holds five known instants or more on average; a fiftieth at both ends of their range is left out.
    """
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(instant)).first()
    if lo is None or not n:
        return df.withColumns({c: F.lit(None).cast("timestamp") for c in (first, last)})
    place = F.floor((F.col(order) - F.lit(lo)) / F.lit((hi - lo) // max(1, min(PLACES, n // 5)) + 1))
    at = lambda q: F.percentile_approx(instant, q)
    known = df.where(F.col(instant).isNotNull() & F.col(order).isNotNull()).groupBy(place.alias("_place")).agg(at(0.02).alias("_a"), at(0.98).alias("_b"))
    known = known.select("_place", F.timestamp_seconds(2 * F.col("_a") - F.col("_b")).alias(first), F.timestamp_seconds(2 * F.col("_b") - F.col("_a")).alias(last))
    return df.withColumn("_place", place).join(F.broadcast(known), "_place", "left").drop("_place")  # at most PLACES rows


def host_zones(df: DataFrame, value: str, url: str, directory: DataFrame, ingested: str | None = None, order: str | None = None) -> DataFrame:
    """host, zone: the zone estimated for every host of df that has zone-free stamps, by ingestion times or, without them, by the order of the rows."""
    zones = sorted(r.zone_name for r in directory.where("zone_name is not null").select("zone_name").distinct().collect())  # names of time zones
    x = df.withColumn("_ts_host", host_of(F.col(url))).join(_known(directory), "_ts_host", "left")
    earliest = None
    if not ingested:
        ingested, earliest = "_ts_seen", "_ts_from"
        sure = _let(parsed(F.col(value), F.col("_ts_day_first")), lambda s: F.when(~s["dated"] & (s["zone"] != ""), F.unix_seconds(s["local"]) - _offset(s["zone"], F.coalesce("_ts_home", F.lit("")))).otherwise(s["epoch"]))
        x = sequence_times(x.withColumn("_ts_sure", sure), order, "_ts_sure", earliest, ingested)
    free = parse_stamps(x, value, "_ts_day_first").where("_ts_zone = '' and not _ts_dated and _ts_local is not null")
    return choose_zones(free, "_ts_host", "_ts_local", ingested, zones, directory, earliest=earliest).where("rank = 1").select("host", "zone")


def _known(directory: DataFrame) -> DataFrame:
    known = directory.where(F.col("host").isNotNull()).groupBy(F.lower("host").alias("_ts_host")).agg(F.min_by("zone_name", "host").alias("_ts_home"), F.min_by("day_first", "host").alias("_ts_day_first"))
    return broadcast_if_small(known, SMALL)


def to_instants(df: DataFrame, value: str, url: str, directory: DataFrame, zones: DataFrame | None = None, out: str = "epoch_s", only_named: bool = False) -> DataFrame:
    """df plus out, the UTC second named by the text in value (null if it names none; only_named drops those rows).

    directory(host, zone_name, day_first) is the table of known hosts, zones(host, zone) the zones found by host_zones, which
    decide where they name a host; both are broadcast only behind a count.
    """
    x = df.withColumn("_ts_host", host_of(F.col(url))).join(_known(directory), "_ts_host", "left")
    if zones is not None:
        x = x.join(broadcast_if_small(zones.select(F.col("host").alias("_ts_host"), F.col("zone").alias("_ts_guess")), SMALL), "_ts_host", "left").withColumn("_ts_home", F.coalesce("_ts_guess", "_ts_home")).drop("_ts_guess")
    home = F.col("_ts_home")

    def instant(s: Column) -> Column:
        offset, wall = _offset(s["zone"], F.coalesce(home, F.lit(""))), F.unix_seconds(s["local"])
        return (
            F.when(s["epoch"].isNotNull(), s["epoch"])
            .when(s["dated"], wall)
            .otherwise(_let(F.when(s["zone"] != "", offset), lambda o: F.when(o.isNotNull(), wall - o).otherwise(F.unix_seconds(F.to_utc_timestamp(s["local"], home)))))
            .cast("long")
        )

    found = _let(parsed(F.col(value), F.col("_ts_day_first")), instant)
    # explode evaluates the long expression once; a filter would repeat it
    x = x.withColumn(out, F.explode(F.filter(F.array(found), lambda e: e.isNotNull()))) if only_named else x.withColumn(out, found)
    return x.drop("_ts_host", "_ts_home", "_ts_day_first")
