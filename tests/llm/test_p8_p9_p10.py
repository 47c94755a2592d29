import random
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import encoding, leakage, mixing

ITEM = " ".join(f"item{i}" for i in range(60))


def quote(rnd, k, edits):
    w = ITEM.split()
    a = rnd.randint(0, len(w) - k)
    q = w[a : a + k]
    for _ in range(edits):
        p = rnd.randint(1, len(q) - 2)
        kind = rnd.choice("csa")
        if kind == "c":
            q[p] = "changed"
        elif kind == "a":
            q.insert(p, "added")
        else:
            q[p : p + 1] = ["swapped"]
    return " ".join(q)


def test_leaks(spark):
    rnd = random.Random(1)
    rows, want = [], set()
    for i in range(120):
        k, e = rnd.choice([(25, 0), (25, 1), (25, 2), (40, 2), (20, 0), (22, 0), (12, 0)])
        body = f"Some text {i}, before. \n{quote(rnd, k, e).title()} - and after {i}."
        rows.append((i, body))
        if k >= 25:
            want.add((i, 7))
    rows += [(500, None), (501, ""), (502, "word " * 50_000 + ITEM), (502, "word " * 50_000 + ITEM)]
    want.add((502, 7))
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, "")], "item_id long, item_text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = leakage.leaks(df, "doc_id", "text", items, "item_id", "item_text")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = leakage.without_passages(df, "doc_id", "text", items, "item_id", "item_text").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _ in rows) and all((r.n_passages > 0) == ((r.doc_id, 7) in want) for r in kept)
    assert all(r.text.count("Item") < 4 for r in kept if r.n_passages and r.doc_id < 500) and all(r.text == dict(rows)[r.doc_id] for r in kept if not r.n_passages)
    assert leakage.leaks(df.limit(0), "doc_id", "text", items, "item_id", "item_text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", items.limit(0), "item_id", "item_text").count() == 0


def test_window_ends():
    x = leakage.Index([(1, ITEM)])
    w = ITEM.split()
    assert list(x.find([" ".join(["zz", *w[11:35], "after"])]))  # first word of 25 changed
    assert not list(x.find([" ".join(w[10:32])]))  # 22 words
    assert list(x.find([" ".join(w[10:20] + w[21:36])]))  # one missing


def test_allotment():
    a = mixing.allot([("x", 0.5, 1), ("y", 0.3, 2), ("z", 0.2, 5)], {"x": 1000, "y": 10, "z": 1000})
    assert a["y"] == 20 and abs(a["x"] / a["z"] - 2.5) < 1e-9 or a["x"] == 1000
    assert mixing.allot([("x", 1.0, 1)], {}) == {"x": 0.0} and mixing.allot([], {}) == {}


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join("word" for _ in range(rnd.randint(1, 60))), rnd.choice(["a", "a", "a", "b", "c"])) for i in range(900)]
    docs += [(5000, None, "a"), (5001, "", "a"), (5002, "text", None), (5003, "w " * 20_000, "d"), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("rank", F.lit("clash"))
    t = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.4, 3), ("m", "c", 0.3, 2), ("m", "missing", 0.0, 2), ("n", "b", 1.0, 2), (None, "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    m = mixing.mixed(df.select("doc_id", "text", "source", "rank"), t)
    rows = m.collect()
    most = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 2, ("n", "b"): 2}
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows) and all(1 <= r.copies <= most[r.mix_name, r.source] for r in rows)
    got = defaultdict(int)
    for r in rows:
        got[r.mix_name, r.source] += r.n_tokens * r.copies
    total = sum(v for (k, _), v in got.items() if k == "m")
    longest = max(r.n_tokens for r in rows)
    for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.3)):
        assert abs(got["m", s] - share * total) <= 3 * longest
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(df, t).collect()))
    shares = {(r.mix_name, r.source): r.share for r in mixing.reached(m, t.where("mix_name is not null")).collect()}
    assert shares["m", "missing"] == 0 and abs(shares["n", "b"] - 1) < 1e-9
    assert mixing.mixed(df.limit(0), t).count() == 0 and mixing.mixed(df, t.limit(0)).count() == 0


FR = ["Le théâtre de {n} a déjà vendu {k} entrées à prix réduit, où l’été fut très sec.", "La forêt près de {n} brûle dès l’aube, un pompier blessé a été évacué.", "Ils espèrent être protégés par la région de {n}, çà et là."]
RU = ["Совет города {n} одобрил {k} заявок на ремонт моста.", "Цены на хлеб выросли в {n}, говорят жители соседнего села."]


def wrong(t, name):
    return "".join(bytes([b]).decode(name) if name == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode())


def corpus(n):
    rnd = random.Random(3)
    mk = lambda k: " ".join(rnd.choice(k).format(n=rnd.choice(["Vélmör", "Бракино" if k is RU else "Brakville"]), k=rnd.randint(1, 9999)) for _ in range(4))
    return [("fr", mk(FR)) for _ in range(n)] + [("ru", mk(RU)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return encoding.Model(corpus(120))


@pytest.mark.parametrize("lang", ["fr", "ru", None, "und"])
@pytest.mark.parametrize("how", ["cp1252", "latin-1", "mac", "twice", "part"])
def test_restored(model, lang, how):
    for kind, t in corpus(6):
        if lang in ("fr", "ru") and kind != lang:
            continue
        bad = {"cp1252": lambda: wrong(t, "cp1252"), "latin-1": lambda: wrong(t, "latin-1"), "mac": lambda: t.encode().decode("mac_roman"), "twice": lambda: wrong(wrong(t, "cp1252"), "cp1252"), "part": lambda: t[:60] + wrong(t[60:], "cp1252")}[how]()
        r = model.restore(bad, lang)
        assert r is not None and r[0] == t, (r, t)


def test_right_text_stays(model):
    for kind, t in corpus(30):
        assert model.restore(t, kind) is None
    for t in (None, "", "plain ASCII", "SÃO PAULO À ÇA", "x" * 200_000):
        assert model.restore(t, "fr") is None or "Ã" in t
    assert model.restore("un caf� noir", "fr")[2]


def test_no_text_is_compressed_twice():
    m, seen = encoding.Model(corpus(60)), []

    class Counting:
        def __init__(self, c):
            self.c = c

        def compress(self, x):
            seen.append(x)
            return self.c.compress(x)

    m.size("fr", "x"), m.size("ru", "x")
    m.made |= {k: Counting(m.made[k]) for k in ("fr", "ru")}
    text = next(t for k, t in corpus(6) if k == "fr")
    bad = wrong(text, "cp1252") + "\n" + "plain words only " * 50
    assert m.restore(bad, "fr")[0] == text + "\n" + "plain words only " * 50
    assert seen and len(seen) == len(set(seen))


def test_words_are_turned_only_where_a_chain_may_turn_them(model):
    bad = [(wrong(t, "cp1252"), k) for k, t in corpus(12)]
    [model.restore(t, k) for t, k in bad]  # tables made
    calls = 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(called)
    try:
        got = [model.restore(t, k)[0] for t, k in bad]
    finally:
        sys.setprofile(None)
    assert got == [t for _, t in corpus(12)]
    assert calls < 5 * sum(len(t) for t, _ in bad), calls


def test_best_pieces_are_those_of_all(spark):
    rnd = random.Random(4)
    rows = [(k, x, rnd.choice([1, 1, 1, 2, 3, 40])) for k, many in (("fr", 30_000), ("ru", 9_000), ("none", 50)) for x in {"".join(rnd.choices("abcdeéñж ", k=rnd.randint(1, 14))) for _ in range(many)}]
    usual = {"fr": frozenset("é"), "ru": frozenset("жñ"), "none": frozenset()}
    want = defaultdict(list)
    for k, x, n in sorted(rows, key=lambda r: (-r[2] * (len(r[1].encode()) - 2), r[1].encode())):
        if len(x.encode()) >= encoding.LEAST and all(c < "\x80" or c in usual[k] for c in x):
            want[k].append(x)
    got = encoding.best_pieces(spark.createDataFrame(rows, "lang string, x string, n bigint"), usual)
    for k, xs in got.items():
        assert xs == want[k][: len(xs)] and len("".join(xs).encode()) >= min(encoding.DICTIONARY, len("".join(want[k]).encode()))
    assert set(got) == set(want) and len(got["fr"]) < encoding.DICTIONARY // encoding.LEAST
    assert encoding.Model.of(usual, got).data == encoding.Model.of(usual, want).data


def test_affected_table(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate(corpus(60))]
    rows += [(1000, wrong(rows[0][1], "cp1252"), "fr"), (1000, wrong(rows[0][1], "cp1252"), "fr"), (1001, None, "fr"), (1002, "", None), (1003, "lost � here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("chains", F.lit("clash"))
    got = encoding.restored(df, "doc_id", "text", "lang")
    assert sorted(r.doc_id for r in got.collect()) == [1000, 1000, 1003]
    assert got.where("doc_id = 1000").first().text == rows[0][1]
    assert encoding.restored(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_copies_of_one_garbled_text_do_not_teach_its_signs(spark):
    right = corpus(60)
    bad = wrong(right[0][1], "cp1252")
    rows = [(i, t, k) for i, (k, t) in enumerate(right)] + [(1000 + i, bad, "fr") for i in range(60)]
    got = encoding.restored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert {r.doc_id: r.text for r in got.collect()} == {1000 + i: right[0][1] for i in range(60)}


def test_every_language_and_whole_texts_are_counted(spark):
    rows = [(i, t * 150, "fr") for i, (k, t) in enumerate(corpus(3)) if k == "fr"] + [(100 + 3 * i + j, f"même été {'abc'[j]} là{chr(97 + i % 26)}{i // 26}", f"l{i}") for i in range(45) for j in range(3)]
    assert min(len(t) for _, t, k in rows if k == "fr") > 20_000
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string")
    m, want = encoding.fit(df, "text", "lang"), encoding.Model([(k, t) for _, t, k in rows])
    assert set(m.usual) == {"fr"} | {f"l{i}" for i in range(45)} and m.usual == want.usual
    assert all(sorted(m.data[k]) == sorted(want.data[k]) for k in want.data)


def test_cleaning_keeps_each_row_of_an_id_apart(spark):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, item_text string")
    rows = [(1, "\u0130stanbul\u0130 before " + ITEM + " after"), (1, "short text"), (1, None), (None, ITEM)]
    got = leakage.without_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", items, "item_id", "item_text")
    assert sorted((r.doc_id or 0, r.text or "", r.n_passages) for r in got.collect()) == [(0, "", 1), (1, "", 0), (1, "short text", 0), (1, "\u0130stanbul\u0130 before  after", 1)]
