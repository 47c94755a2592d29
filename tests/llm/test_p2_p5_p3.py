import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import capping, lines, truncation


def brute_cap(rows, cap):
    by = defaultdict(list)
    for i, s, q in rows:
        if s is not None:
            bad = q is None or q != q or q in (float("inf"), float("-inf"))
            by[s].append((bad, 0 if bad else -q, i))
    return sorted(i for v in by.values() for _, _, i in sorted(v)[cap:])


@pytest.mark.parametrize("cap", [0, 1, 7, 40])
def test_cap_equals_ranking(spark, cap):
    rnd = random.Random(cap)
    qs = [None, float("nan"), float("inf"), float("-inf"), 1.0, 2.5, 2.5, 99.9, -3.0, 1e12]
    rows = [(i * 3, rnd.choice([None, "", "hot", "hot", "hot", "b"]), rnd.choice(qs) if i % 3 else rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, source string, q double").withColumn("who", F.lit("clash")).withColumn("bin", F.lit(1))
    for bins, most in ((3, 2), (1024, 64), (1024, 10_000)):
        got = sorted(r.row_id for r in capping.over_cap(df, "source", "q", "row_id", cap, bins, most).collect())
        assert got == brute_cap(rows, cap)


def test_cap_empty_and_one_tie(spark):
    df = spark.createDataFrame([], "row_id long, source string, q double")
    assert capping.over_cap(df, "source", "q", "row_id", 1).count() == 0
    df = spark.createDataFrame([(i, "s", 5.0) for i in range(50)], "row_id long, source string, q double")
    assert sorted(r.row_id for r in capping.over_cap(df, "source", "q", "row_id", 47).collect()) == [47, 48, 49]
    df = spark.createDataFrame([(i, "s", None) for i in range(5)], "row_id long, source string, q double")
    assert sorted(r.row_id for r in capping.over_cap(df, "source", "q", "row_id", 3).collect()) == [3, 4]
    df = spark.createDataFrame([(7, "s", 1.0)] * 9 + [(8, "s", 1.0)], "row_id long, source string, q double")
    assert [r.row_id for r in capping.over_cap(df, "source", "q", "row_id", 6, 4, 2).orderBy("row_id").collect()] == [7, 7, 7, 8]


def test_cap_with_one_outlier(spark):
    rows = [(i, "s", float(i * 7919 % 3000) / 3000) for i in range(3000)] + [(5000, "s", 1e308), (5001, "s", -1e308)]
    df = spark.createDataFrame(rows, "row_id long, source string, q double")
    assert sorted(r.row_id for r in capping.over_cap(df, "source", "q", "row_id", 1000, 64, 50).collect()) == brute_cap(rows, 1000)


def test_repeated_lines_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    pool = ["Read more >>", "read  MORE>>", "12 shares", "7 shares\r", "", "  ", "Ångström café", "unique", "x" * 50_000]
    rows = []
    for i in range(300):
        t = "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own line {rnd.choice('abcdefgh')}{i}x" for _ in range(rnd.randint(0, 4)))
        rows.append((i * 37, rnd.choice([None, "a", "a", "A", "b "]), None if i % 17 == 0 else t))
    key = lambda x: re.sub(r"\d+", "0", re.sub(r"\s+", "", x.lower()))
    docs = defaultdict(set)
    for d, s, t in rows:
        for x in (t or "").split("\n"):
            if s is not None and key(x):
                docs[s, key(x)].add(d)
    want = sorted((d, n) for d, s, t in rows if t is not None and s is not None for n, x in enumerate(t.split("\n")) if key(x) and len(docs[s, key(x)]) >= 6)
    df = spark.createDataFrame(rows, "feed_pos long, source string, summary string").withColumn("key", F.lit(0)).withColumn("word", F.lit("w"))
    assert sorted((r.feed_pos, r.line_no) for r in lines.repeated_lines(df, "feed_pos", "source", "summary").collect()) == want
    clean = {r.feed_pos: r.kept for r in lines.without_repeated(df, "feed_pos", "source", "summary", "kept").collect()}
    for most in (200_000, 0):
        monkeypatch.setattr(lines, "BROADCAST_KEYS", most)
        own = {r.feed_pos: r.own for r in lines.own_lines(df.drop("key", "word"), "feed_pos", "source", "summary", "own").collect()}
        for d, s, t in rows:
            kept = None if t is None else [x for x in t.split("\n") if not (key(x) and s is not None and len(docs[s, key(x)]) >= 6)]
            assert clean[d] == kept and own[d] == (None if t is None else [x for x in kept if key(x)])
    assert lines.repeated_lines(df.limit(0), "feed_pos", "source", "summary").count() == 0


def test_truncated(spark, monkeypatch):
    rnd = random.Random(3)
    a, b, c = ["The mayor", "A trader", "The clerk"], ["opened", "closed", "sold", "moved"], ["the market", "the bridge", "a school", "the old mill"]
    sentence = lambda: f"{rnd.choice(a)} {rnd.choice(b)} {rnd.choice(c)} in the town of Brak{rnd.randint(1, 99)}ville on Sunday morning."
    rows = []
    for i in range(600):
        t = " ".join(sentence() for _ in range(4))
        kind = i % 12
        if kind == 0:
            t = t[: -rnd.randint(5, 60)].rstrip(" .")
        elif kind == 1:
            t = t[: -rnd.randint(12, 60)].rstrip(" .") + rnd.choice(["...", " […]", "…", " [...]", "�", " >>"])
        elif kind == 2:
            t += "\nTags: market, bridge, school"
        elif kind == 3:
            t = t.replace(" ", "  ") + "\nShare this with friends"
        rows.append((i, "src", t))
    rows += [(1000, None, None), (1001, "src", ""), (1002, "src", " \n "), (1003, None, "One two three. " * 2000), (1004, "src", "Share this with friends")]
    # copies of one cut text with an opening of its own, in many sources and in none
    rows += [(2000 + i, f"s{i}" if i % 2 else None, "Umbolvik sold the market in the town of Brak7ville on") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, source string, t string").withColumn("cut", F.lit("clash"))
    got = {r.id: r.cut for r in truncation.judged(df, "id", "source", "t").collect()}
    monkeypatch.setattr(truncation, "FEW_OPENINGS", 0)
    assert got == {r.id: r.cut for r in truncation.judged(df, "id", "source", "t").collect()}
    assert all(got[2000 + i] for i in range(40))
    assert all(got[i] == (i % 12 < 2) for i in range(600)), [i for i in range(600) if got[i] != (i % 12 < 2)][:9]
    assert not any(got[i] for i in (1000, 1001, 1002, 1003, 1004))
    assert truncation.judged(df.limit(0), "id", "source", "t").count() == 0
