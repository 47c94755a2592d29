import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsloom.llm import history, names, neardup


def lev(a, b):
    d = np.arange(len(b) + 1)
    for x in a:
        n = [d[0] + 1]
        for j, y in enumerate(b, 1):
            n.append(min(d[j] + 1, n[-1] + 1, d[j - 1] + (x != y)))
        d = n
    return d[-1]


def test_metric_cells_lose_no_pair(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(4, 8))) for _ in range(150)})
    got = {(r.x, r.y) for r in names.word_neighbours(spark.createDataFrame([(w,) for w in words], "word string"), 2, 5).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and lev(a, b) <= 2}
    assert names.word_neighbours(spark.createDataFrame([], "word string")).count() == 0


def test_spellings_link(spark):
    one = {"Brindlemoor Daily Post": 50, "THE BRINDLEMOOR DAILY POST": 3, "Brindlemoor  Daily Post ": 2, "Post (Brindlemoor Daily)": 2, "Daily Post, Brindlemoor": 2, "Brindlemoor Dly Pst": 2, "Brindelmoor Daily Post": 1, "B.D.P.": 1, "BDP": 1, "BrindlemoorDailyPost": 2, "Brindlemoor Daily Post - Top Stories": 1}
    two = {"Katherine Ostvale": 30, "Kate Ostvale": 4, "Ostvale, K.": 2, "KJ Ostvale": 1, "By Katherine Ostvale": 2, "Katherine J. Ostvale": 2, "Kathrine Ostvale": 1}
    three = {"Northgale Radio": 20, "Nothgale Radio": 1}
    four = {"Southgale Radio": 20}
    rest = {"Gothalgarth Examiner": 9, "Gothangarth Examiner": 9, "Andrew Ostvale": 20, "": 3, "   ": 1, "!!": 2, "x" * 3000: 1}
    rows = [x for g in (one, two, three, four, rest) for x in g.items()]
    got = {r.spelling: r.root for r in names.linked(spark.createDataFrame(rows, "spelling string, n long")).collect()}
    for g in (one, two, three, four):
        assert len({got[s] for s in g}) == 1, {s: got[s] for s in g}
    assert len({got[next(iter(g))] for g in (one, two, three, four)} | {got[s] for s in ("Gothalgarth Examiner", "Gothangarth Examiner", "Andrew Ostvale")}) == 7
    assert not {"", "   ", "!!"} & set(got)
    assert names.linked(spark.createDataFrame([], "spelling string, n long")).count() == 0


def test_names_that_share_only_a_common_word_link(spark, monkeypatch):
    monkeypatch.setattr(names, "BOUNDED", 3)
    rows = [("Brindlemoor Western Evening Gazette Post", 50), ("Brndlmr Wstrn Evnng Gztt Post", 2), ("Katherine Ostvale Robert Marvanesk Post", 40), ("Kthrn Ostvl Bob Mrvnsk Post", 2)]
    # the short forms' other words stand in few names each, so the shared one is none of their three rarest
    rows += [(f"{w} Brndlmr Wstrn Evnng Gztt {x}", 9) for w, x in (("Kelda", "Zorn"), ("Tovas", "Quali"))] + [(f"{w} Kthrn Ostvl Bob Mrvnsk {x}", 9) for w, x in (("Luthal", "Nimir"), ("Seddas", "Yeston"))]
    rows += [(f"{w} Post", 9) for w in ("Luthalhurst", "Gavantrask", "Vashulbourne", "Haskotjord", "Teshalrune", "Sarqasoll", "Yestolbury")]
    got = {r.spelling: r.root for r in names.linked(spark.createDataFrame(rows, "spelling string, n long")).collect()}
    assert got[rows[0][0]] == got[rows[1][0]] and got[rows[2][0]] == got[rows[3][0]] and len({got[s] for s, _ in rows}) == len(rows) - 2


def test_names_that_align_have_an_opening_in_common():
    rnd = random.Random(3)
    vocab = ["robert", "bob", "rbrt", "william", "bill", "k", "kate", "katherine", "kathrine", "post", "pst", "daily", "dialy", "bill", "j", "eleanor", "nell"]
    n = 0
    for _ in range(20_000):
        a, b = ([rnd.choice(vocab) for _ in range(rnd.randint(1, 4))] for _ in range(2))
        if names.aligned(a, b) is not None:
            n += 1
            assert names.openings(a) & names.openings(b), (a, b)
    assert n > 100


def test_long_names_align():
    a = [f"word{i}" for i in range(14)]
    assert names.aligned(a, list(reversed(a))) == (0, 0, 0, 0)
    assert names.aligned(a, [*a[:6], "wrd6", *a[7:]]) is not None and names.aligned(a, [*a[:6], "other", *a[7:]]) is None


def texts(rnd, n):
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "in"] * 30
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        w = t.split()
        for _ in range(rnd.randint(0, 2)):
            v = w[:]
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            rnd.shuffle(v)
            out.append(" ".join(v).upper())
    return out


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = list(enumerate(texts(rnd, 150))) + [(9000, None), (9001, ""), (9002, "!!!"), (9003, "the of in"), (9004, "in of the the"), (9005, "z" * 200_000)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("same", F.lit(1)).withColumn("rep", F.lit("x"))
    sets = {i: set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    got = [(r.id_a, r.id_b) for r in neardup.near_duplicates(df, "id", F.col("t")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    up = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in want:
            up[a] = up[b] = min(up[a], up[b])
    assert {r.id: r.class_id for r in neardup.groups(df, "id", F.col("t")).collect()} == up
    assert neardup.groups(df.limit(0), "id", F.col("t")).count() == 0
    assert neardup.near_duplicates(df.limit(0), "id", F.col("t")).count() == 0


def test_family_of_near_copies_loses_no_pair(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = base[:]
        for k in rnd.sample(range(40), rnd.randint(1, 2)):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rnd.sample(words, 30))) for i in range(300)]
    for i in range(30):  # sets on both sides of LONG
        w = [f"l{k}" for k in range(210 if i % 2 else 195)]
        rows.append((5000 + i, " ".join(w[i:] + [f"z{i}"])))
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id long, t string")
    for rare, hot in ((5_000, 20_000), (20, 20_000), (20, 40)):  # blocks of one word, of two, and salted ones
        monkeypatch.setattr(neardup, "RARE", rare)
        monkeypatch.setattr(neardup, "HOT", hot)
        got = [(r.id_a, r.id_b) for r in neardup.near_duplicates(df, "id", F.col("t")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_of_common_words_only_where_a_pair_may_begin(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE", 20)
    monkeypatch.setattr(neardup, "HOT", 40)
    rnd = random.Random(4)
    rows = [(i, " ".join([f"own{i}x{k}" for k in range(8)] + rnd.sample([f"c{k}" for k in range(60)], 34))) for i in range(600)]
    known, counts = neardup.prints(spark.createDataFrame(rows, "id long, text string"), words=True)
    # a smaller set of 42 words may miss 7 of them, so no pair begins behind the 8 words of each record's own
    assert neardup.candidate_cells(known, counts, 700_000).count() == 600 * 8


def test_big_blocks_give_the_pairs_of_small_ones(monkeypatch):
    rnd = np.random.default_rng(5)
    m = 900
    rows = pd.DataFrame({"block": np.sort(rnd.integers(0, 4, m)), "same": rnd.integers(-400, 400, m), "n": rnd.integers(8, 40, m), "flags": rnd.integers(1, 4, m)})
    rows["size"] = rows["n"] * ((1 << 32) + 4) + rows["flags"]
    rows = pd.concat([rows, rows[:50]]).sort_values(["block", "size", "same"])
    sig = [np.bitwise_or.reduce([np.int64(1) << rnd.integers(0, 30, len(rows)) for _ in range(3)]) for _ in range(2)]
    args = [rows[c].to_numpy() for c in ("block", "same", "size")] + sig
    found = []
    for big, tile in ((10**9, 1 << 18), (2, 1 << 18), (2, 300)):
        monkeypatch.setattr(neardup, "BIG", big)
        monkeypatch.setattr(neardup, "TILE", tile)
        found.append(sorted(zip(*(x.tolist() for x in neardup.block_pairs(*args, 700_000)))))
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]


def test_hot_group_of_copies(spark):
    rows = [(i, "one and the same text of nine words here") for i in range(40)] + [(100 + i, f"other text number {i} with words q{i} r{i} s{i}") for i in range(60)]
    assert neardup.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).count() == 40 * 39 // 2


def test_pages():
    p = history.page_of
    assert p("https://www.a.example/x/y/") == p("http://A.EXAMPLE:8080/x/y/amp?utm=1#f") == p("//m.a.example/x%2Fy")
    assert p("https://a.example/story?id=1") == p("https://a.example/story?z=2&id=1") != p("https://a.example/story?id=2")
    assert p(None) is None and p("") is None and p("nonsense") is None


def test_batches_equal_brute_force(spark):
    rnd = random.Random(11)
    t = texts(rnd, 120)
    rows = [(i, f"https://h.example/{rnd.randrange(400)}" if i % 9 else None, x if i % 23 else None, None if i < 150 else 1 + (i - 150) * 5 // max(1, len(t) - 150)) for i, x in enumerate(t)]
    rows += [(5000, None, "the", 9), (5001, None, "THE", 9), (5002, None, "", 9), (5003, None, None, 9), (5004, None, "the of", 9), (5005, "x" * 9000, "of the", 9)]
    df = spark.createDataFrame(rows, "row_id long, url string, headline string, batch_no int").withColumn("rec", F.lit(1)).withColumn("shard", F.lit(2))
    sets = {i: set(re.findall(r"[^\W_]+", (h or "").lower())) for i, _, h, _ in rows}
    page = {i: history.page_of(u) for i, u, _, _ in rows}
    want = {}
    for i, _, _, b in rows:
        if b is not None:
            for j, *_ in rows:
                if j < i and (page[i] is not None and page[i] == page[j] or sets[i] and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])):
                    want[i] = j
                    break
    got = {r.row_id: r.kept_row_id for r in history.repeats(df.where("batch_no is null"), df.where("batch_no is not null"), "batch_no").collect()}
    assert got == want
    empty = df.limit(0)
    assert history.repeats(empty, empty, "batch_no").count() == 0
    assert history.repeats(empty, df.where("batch_no = 9"), "batch_no").count() == 2


def test_store_one_batch_after_another(spark):
    make = lambda r: spark.createDataFrame(r, "row_id long, url string, headline string")
    store = history.SegmentStore.create(make([(0, None, "a b c")]))
    store.add(make([(0, None, "alpha beta gamma delta")]))
    found = []
    for k in range(1, 6):
        store = history.SegmentStore.open(spark, store.path)  # as another session would
        found += [tuple(r) for r in store.find(store.add(make([(k, None, "Alpha beta gamma delta" if k % 2 else f"own words {k} x{k} y{k}")]))).collect()]
    assert sorted(found) == [(0, 1), (0, 3), (0, 5)] and len(store.segments) < 5


def test_long_texts_and_shards_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(history, "SHARD", 40)
    rnd = random.Random(2)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(24):
        w = base[:]
        for k in rnd.sample(range(400), rnd.choice((10, 60, 70, 90))):
            w[k] = f"own{i}x{k}"
        rows.append((i, None, " ".join(w), 0 if i < 8 else 1 + i % 3))
    rows += [(100 + i, None, " ".join(rnd.sample(base[:30], 6)), 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, url string, headline string, batch_no int")
    sets = {i: set(h.split()) for i, _, h, _ in rows}
    want = {}
    for i, _, _, b in rows:
        old = [j for j in sets if j < i and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])]
        if b and old:
            want[i] = min(old)
    assert want and {r.row_id: r.kept_row_id for r in history.repeats(df.where("batch_no = 0"), df.where("batch_no > 0"), "batch_no").collect()} == want
