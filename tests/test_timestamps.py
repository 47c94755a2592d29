import random
from datetime import datetime

import pytest

from newsloom.operators import timestamps as T

HOSTS = [("a.example", "America/New_York", False), ("i.example", "Asia/Kolkata", True), ("s.example", "Australia/Sydney", True)]


def instants(spark, rows, ingested=None, hosts=HOSTS):
    h = spark.createDataFrame(hosts, "host string, zone_name string, day_first boolean")
    df = spark.createDataFrame(rows, "id long, v string, url string, seen timestamp, epoch string")
    zones = T.host_zones(df, "v", "url", h, ingested) if ingested else None
    return {r.id: r.epoch_s for r in T.to_instants(df, "v", "url", h, zones).collect()}


def at(*p):
    from datetime import timezone

    return int(datetime(*p, tzinfo=timezone.utc).timestamp())


CASES = [
    ("2025-01-01T01:22:45+00:00", "i", at(2025, 1, 1, 1, 22, 45)),
    ("Thu, 02 Jan 2025 03:56:31 +0545", "i", at(2025, 1, 1, 22, 11, 31)),
    ("2025-01-02T03:20:38", "i", at(2025, 1, 1, 21, 50, 38)),
    ("2025-01-11T03:14:32.873Z", "i", at(2025, 1, 11, 3, 14, 32)),
    ("03/04/2025 10:00", "a", at(2025, 3, 4, 15, 0)),
    ("03/04/2025 10:00", "i", at(2025, 4, 3, 4, 30)),
    ("1736412936", "i", 1736412936),
    ("1737691838536", "i", 1737691838),
    ("2025-01-22", "i", at(2025, 1, 22)),
    ("Jan. 12, 2025, 1.42 p.m.", "a", at(2025, 1, 12, 18, 42)),
    ("Published: 13 January 2025 12:05", "s", at(2025, 1, 13, 1, 5)),
    ("Fri, 10 Jan 25 06:24:54 JST", "i", at(2025, 1, 9, 21, 24, 54)),
    ("February 11, 2025 12:51 AM EST", "a", at(2025, 2, 11, 5, 51)),
    ("February 11, 2025 12:51 AM EST", "s", at(2025, 2, 10, 14, 51)),
    ("20250112T002402Z", "i", at(2025, 1, 12, 0, 24, 2)),
    ("2025-02-10T16:45+00", "i", at(2025, 2, 10, 16, 45)),
    ("2025-11-02 01:30:00", "a", at(2025, 11, 2, 5, 30)),  # twice: the earlier
    ("2025-03-09 02:30:00", "a", at(2025, 3, 9, 7, 30)),  # skipped: offset before
    ("2025-02-30", "i", None),
    ("0000-00-00T00:00:00Z", "i", None),
    ("31/13/2025 10:00", "i", None),
    ("09:28", "i", None),
    ("yesterday", "i", None),
    ("", "i", None),
    (None, "i", None),
    ("x" * 100_000, "i", None),
]


def test_forms(spark):
    rows = [(i, v, f"https://{h}.example/x", None, "clash") for i, (v, h, _) in enumerate(CASES)]
    got = instants(spark, rows)
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_unknown_hosts_repeats_and_empty(spark):
    rows = [(1, "2025-01-01 00:00:00", None, None, None), (2, "2025-01-01 00:00:00", "https://zzz.example/", None, None), (3, "2025-01-01", None, None, None), (3, "2025-01-01", None, None, None)]
    assert instants(spark, rows) == {1: None, 2: None, 3: at(2025, 1, 1)}
    assert instants(spark, []) == {}


def test_zone_is_estimated_from_ingestion(spark):
    seen = [datetime(2025, 1, d, 6, 0) for d in range(1, 20)]
    # wall clock of Kolkata, always half an hour before ingestion
    rows = [(d, f"2025-01-{d:02d} 11:00:00", "https://new.example/x", s, None) for d, s in enumerate(seen, 1)]
    got = instants(spark, rows, "seen")
    assert got[5] == at(2025, 1, 5, 5, 30)


@pytest.mark.parametrize("only", [True, False])
def test_only_named(spark, only):
    h = spark.createDataFrame(HOSTS, "host string, zone_name string, day_first boolean")
    df = spark.createDataFrame([(1, "2025-01-01", None), (2, "N/A", None)], "id long, v string, url string")
    assert T.to_instants(df, "v", "url", h, only_named=only).count() == (1 if only else 2)


def planted(zone, host, k):
    """(wall-clock text, url, ingestion, instant): a stamp every five hours over a year and a half, taken in 5 to 40 minutes later."""
    from datetime import timedelta, timezone
    from zoneinfo import ZoneInfo

    t = datetime(2024, 1, 3, 2, 7, tzinfo=timezone.utc) + timedelta(hours=5 * k)
    seen = t + timedelta(minutes=5 + k * 7 % 36)
    return t.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), f"https://{host}.example/{k}", seen.replace(tzinfo=None), int(t.timestamp())


def test_zones_of_hosts_outside_the_directory(spark):
    zones = ["America/New_York", "Asia/Kolkata", "Australia/Sydney", "Europe/Berlin", "UTC"]
    directory = spark.createDataFrame([(f"h{i}.example", z, True) for i, z in enumerate(zones)] + [("w.example", "Europe/Berlin", True)], "host string, zone_name string, day_first boolean")
    rows = [(i * 3000 + k, *planted(z, f"x{i}", k)) for i, z in enumerate(zones) for k in range(2600)]
    rows += [(90_000 + k, *planted("Asia/Kolkata", "w", k)) for k in range(300)]  # the directory is wrong here
    df = spark.createDataFrame(rows, "id long, v string, url string, seen timestamp, want long")
    found = T.host_zones(df, "v", "url", directory, "seen")
    got = T.to_instants(df, "v", "url", directory, found)
    assert got.where("epoch_s = want").count() >= 0.998 * len(rows)  # the second of two equal wall-clock times is lost
    assert {r.host: r.zone for r in found.collect()} == {f"x{i}.example": z for i, z in enumerate(zones)} | {"w.example": "Asia/Kolkata"}


def test_zones_from_the_order_of_rows(spark):
    from datetime import datetime as dt, timezone

    rows, rnd = [], random.Random(1)
    for k in range(2000):  # half of the rows name their instant, the others are of hosts to estimate
        i = rnd.randrange(2)
        v, url, _, want = planted(("Asia/Kolkata", "Australia/Sydney")[i], f"x{i}", k)
        rows.append((k, dt.fromtimestamp(want, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if rnd.random() < 0.5 else v, url))
    df = spark.createDataFrame(rows, "id long, v string, url string")
    directory = spark.createDataFrame([(f"h{i}.example", z, True) for i, z in enumerate(("Asia/Kolkata", "Australia/Sydney", "UTC", "America/New_York"))], "host string, zone_name string, day_first boolean")
    assert {r.host: r.zone for r in T.host_zones(df, "v", "url", directory, order="id").collect()} == {"x0.example": "Asia/Kolkata", "x1.example": "Australia/Sydney"}
    assert T.host_zones(df.limit(0), "v", "url", directory, order="id").count() == 0


def test_stamps_beyond_the_prior(spark):
    directory = spark.createDataFrame([("a.example", "Asia/Kathmandu", True), ("b.example", "Asia/Kolkata", True)], "host string, zone_name string, day_first boolean")
    df = spark.createDataFrame([(k, *planted("Asia/Kathmandu", "a", k)) for k in range(200)], "id long, v string, url string, seen timestamp, want long")
    assert T.host_zones(df, "v", "url", directory, "seen").first().zone == "Asia/Kathmandu"
