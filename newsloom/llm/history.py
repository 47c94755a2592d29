"""Problem 6: new batches held against all accepted history by immutable suffix arrays, without indexing the history again.

A record's text is its distinct words, rarest first; the order comes from a sketch of the history's word counts that is frozen when
the store is made (words it did not know count as rarest). Repeats are defined on word sets, so this order, not the
order of reading, makes shared words stand together. Two records of n and m words that overlap by 0.7 share one of the first
p = n - ceil(0.7 n) + 1 words of either, so suffixes are kept of these words, each with the words that follow it there
(BLOCK at most) and the one before. A page that a url leads to is a text of one word.

Every batch becomes an immutable segment: the suffixes of its concatenated texts in sorted order, cut by range into shards of
about SHARD suffixes (a hot beginning spreads over as many shards as it fills), stored as plain arrays. A lookup sends each of the batch's substrings to the
shards of all live segments whose range holds its first word, binary-searches them, drops pairs whose
64-bit parity signatures differ in more than 3/17 (n + m) bits, extends each match that cannot be extended to the left as far as it goes, and adds up
the lengths: the coverage of each pair of records. As the pair shares at
most coverage + max(n - p, m - p) words, pairs below that bound are dropped and the others verified exactly. Segments are
merged like the digits of a binary counter, so a lookup reads O(log batches) of them and each suffix is rewritten O(log batches) times.

The store lives in one folder with a manifest per change; ``SegmentStore.open`` continues it in another session. A lookup reads the
stored word sets of candidates (semi-join), never the source rows of earlier batches.

Equal word sets of one batch are one record, and each page is kept once per batch, so copies cost nothing.

Defined results: null or empty headlines overlap with nothing, null urls lead nowhere; a row repeats only
rows of smaller row_id; rows of one row_id count as one row; empty batches and an empty history are allowed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, unquote_plus

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.neardup import PIECE, SKETCH, overlap_pairs, prints
from newsloom.session import broadcast_if_small, shared_dir, stage, table

SHARD = 100_000  # suffixes
BLOCK = 64  # words a match runs over at most before it is counted on as another
SMALL = 500_000  # ids of candidates that are broadcast (4 MB); more are joined by a shuffle
WORD = re.compile(r"[^\W_]+")
URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?")
SHARDS = "segment int, shard int, lo bigint, hi bigint, size bigint, word binary, prev binary, rec binary, n binary, sig binary, at binary, follow binary"
SUFFIX = "segment int, word bigint, prev bigint, rec bigint, n int, sig bigint, follow binary"
RECORDS = "rec bigint, row_id bigint, page bigint, words array<bigint>, batch int"


def page_of(url: str | None) -> str | None:
    """Host without www. or m. and port, decoded path without closing / or /amp, and the value of id; null if it is no url."""
    m = URL.match(url or "")
    if not m or not m[1]:
        return None
    host = re.sub(r"^(?:www|m)\.", "", m[1].lower().rstrip("."))
    path = unquote(m[2])
    while path.endswith(("/", "/amp")):
        path = path[:-1] if path.endswith("/") else path[:-4]
    ident = next((unquote_plus(x[3:]) for x in re.split("[&;]", (m[3] or "").replace("&amp;", "&")) if x.startswith("id=")), None)
    return f"{host}\n{path}\n{'' if ident is None else '=' + ident}"


def parsed(rows: DataFrame, counts: np.ndarray, batch: str | None) -> DataFrame:
    """row_id, page (hash), words (hashes, rarest first) and batch of each row (row_id, url, headline)."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = held.value, {}
        for pdf in batches:
            pages = [None if p is None else _signed(xxhash.xxh3_64_intdigest("page\n" + p)) for p in map(page_of, pdf["url"])]
            words = []
            for t in pdf["headline"]:
                own = []
                for w in set(WORD.findall(t.lower())) if t else ():
                    k = seen.get(w)
                    if k is None:
                        if len(seen) >= 200_000:
                            seen.clear()
                        h = xxhash.xxh3_64_intdigest(w)
                        k = seen[w] = (int(counts[h & (SKETCH - 1)]), _signed(h) or 1)
                    own.append(k)
                words.append([h for _, h in sorted(own)])
            yield pd.DataFrame({"row_id": pdf["row_id"], "page": pd.array(pages, dtype="Int64"), "words": words, "batch": pdf["batch"]})

    number = F.col(batch).cast("int") if batch else F.lit(0)
    x = rows.where(F.col("row_id").isNotNull()).select(F.col("row_id").cast("bigint").alias("row_id"), "url", "headline", number.alias("batch"))
    return x.mapInPandas(run, "row_id bigint, page bigint, words array<bigint>, batch int")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def lead(n: np.ndarray) -> np.ndarray:
    """Words of a set of n of which any partner shares one."""
    return n - (7 * n + 9) // 10 + 1


def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes (SUFFIX) of records (segment, rec, words): one for each leading word."""
    for pdf in batches:
        pdf = pdf[pdf["words"].map(len) > 0]
        if not len(pdf):
            continue
        n = pdf["words"].map(len).to_numpy().astype(np.int64)
        p = lead(n)
        text = np.concatenate([w[:k] for w, k in zip(pdf["words"], p)]).astype(np.int64)
        row = np.repeat(np.arange(len(p)), p)
        at = np.arange(len(text)) - np.repeat(np.cumsum(p) - p, p)
        prev = np.where(at % BLOCK == 0, 0, np.concatenate([[0], text[:-1]]))
        end = np.arange(len(text)) + np.minimum(p[row] - at, BLOCK - at % BLOCK)
        raw = text.tobytes()
        follow = [raw[8 * a : 8 * b] for a, b in zip(range(1, len(text) + 1), end.tolist())]
        whole = np.concatenate(pdf["words"].tolist()).astype(np.int64).view(np.uint64)
        sig = np.bitwise_xor.reduceat(np.uint64(1) << (whole >> np.uint64(58)), np.cumsum(n) - n).view(np.int64)
        yield pd.DataFrame({"segment": pdf["segment"].to_numpy()[row], "word": text, "prev": prev, "rec": pdf["rec"].to_numpy()[row], "n": n[row].astype(np.int32), "sig": sig[row], "follow": follow})


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard (SHARDS) of each segment in a range of suffixes: a sorted array of them."""
    from pyspark import TaskContext

    held = list(batches)
    if not held:
        return
    for segment, x in pd.concat(held).groupby("segment", sort=False):
        follow = x["follow"].to_numpy()
        sizes = np.array([len(b) // 8 for b in follow], dtype=np.int64)
        text = np.frombuffer(b"".join(follow) + bytes(16), dtype=np.int64)
        nth = lambda k, begin=np.cumsum(sizes) - sizes, sizes=sizes, text=text: np.where(sizes > k, text[np.minimum(begin + k, len(text) - 1)], 0)
        order = np.lexsort((x["rec"], nth(1), nth(0), x["word"]))  # by three words, then by record
        x, follow, sizes = x.iloc[order], follow[order], sizes[order]
        word = x["word"].to_numpy().astype(np.int64)
        yield pd.DataFrame({
            "segment": np.array([segment], dtype=np.int32), "shard": np.array([TaskContext.get().partitionId()], dtype=np.int32), "lo": word[:1], "hi": word[-1:], "size": [len(x)], "word": [word.tobytes()],
            "prev": [x["prev"].to_numpy().astype(np.int64).tobytes()], "rec": [x["rec"].to_numpy().astype(np.int64).tobytes()], "n": [x["n"].to_numpy().astype(np.int32).tobytes()], "sig": [x["sig"].to_numpy().astype(np.int64).tobytes()],
            "at": [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes()], "follow": [b"".join(follow)],
        })


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suffixes of shards."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            at = np.frombuffer(r.at, dtype=np.int64).tolist()
            follow = [r.follow[8 * a : 8 * b] for a, b in zip(at, at[1:])]
            yield pd.DataFrame({"segment": np.int32(r.segment), "word": np.frombuffer(r.word, dtype=np.int64), "prev": np.frombuffer(r.prev, dtype=np.int64), "rec": np.frombuffer(r.rec, dtype=np.int64), "n": np.frombuffer(r.n, dtype=np.int32), "sig": np.frombuffer(r.sig, dtype=np.int64), "follow": follow})


def searched(probes: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    """row_id, old, n, m, cover: for each probe the records of smaller number in the shard that hold its words, and how many in a row."""
    out = []
    word, prev, rec, n, sig = (probes[c].to_numpy().astype(np.int64) for c in ("word", "prev", "rec", "n", "sig"))
    mine = np.array([len(b) // 8 for b in probes["follow"]], dtype=np.int64)
    begin, text = np.cumsum(mine) - mine, np.frombuffer(b"".join(probes["follow"]) + bytes(8), dtype=np.int64)
    for s in shards.itertuples(index=False):
        words, before, recs, sigs, at = (np.frombuffer(b, dtype=np.int64) for b in (s.word, s.prev, s.rec, s.sig, s.at))
        m = np.frombuffer(s.n, dtype=np.int32).astype(np.int64)
        other = np.frombuffer(s.follow + bytes(8), dtype=np.int64)
        lo, hi = np.searchsorted(words, word, "left"), np.searchsorted(words, word, "right")
        upto = np.cumsum(hi - lo)
        first = 0
        while first < len(word):  # some probes at a time, so that no more than about half a million hits are held
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 500_000, "right")))
            k = (hi - lo)[first:last]
            i = np.repeat(np.arange(first, last), k)
            j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[first:last], k)
            # only what can be a repeat by sizes and signatures, and only the beginning of each run of shared words
            keep = (17 * np.bitwise_count((sig[i] ^ sigs[j]).view(np.uint64)).astype(np.int64) <= 3 * (n[i] + m[j])) & (recs[j] < rec[i])
            i, j = i[keep], j[keep]
            keep = (10 * np.minimum(n[i], m[j]) >= 7 * np.maximum(n[i], m[j])) & ((prev[i] == 0) | (before[j] == 0) | (prev[i] != before[j]))
            i, j = i[keep], j[keep]
            cover, live, step = np.ones(len(i), dtype=np.int32), np.arange(len(i)), 0
            most = np.minimum(mine[i], at[j + 1] - at[j])
            while len(live):
                live = live[most[live] > step]
                live = live[text[begin[i[live]] + step] == other[at[j[live]] + step]]
                cover[live] += 1
                step += 1
            out.append(pd.DataFrame({"row_id": rec[i], "old": recs[j], "n": n[i].astype(np.int32), "m": m[j].astype(np.int32), "cover": cover}))
            first = last
    return pd.concat(out) if out else pd.DataFrame({c: pd.array([], dtype=t) for c, t in (("row_id", "int64"), ("old", "int64"), ("n", "int32"), ("m", "int32"), ("cover", "int32"))})


class SegmentStore:
    """Suffix-array segments of accepted batches in one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, counts: np.ndarray):
        self.spark, self.path, self.counts = spark, path, counts
        self.version = 0
        self.segments: list[list] = []  # [batches in it, folder, number in it, [[shard, lo, hi], ...]], oldest first
        self.records: list[str] = []

    @classmethod
    def create(cls, history: DataFrame, path: str | None = None) -> SegmentStore:
        """An empty store whose word order comes from the headlines of history."""
        spark = history.sparkSession
        counts = prints(history.where("row_id is not null").select(F.col("row_id").cast("bigint").alias("id"), F.col("headline").alias("text")))[1]
        store = cls(spark, path or f"{shared_dir(spark).rstrip('/')}/p6-{uuid.uuid4().hex}", counts)
        rows = [(k, bytearray(counts[k * PIECE : (k + 1) * PIECE].tobytes())) for k in range(SKETCH // PIECE)]
        spark.createDataFrame(rows, "id int, counts binary").coalesce(1).write.parquet(f"{store.path}/order")
        store._commit()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentStore:
        """The store in a folder as its last manifest describes it."""
        counts = np.zeros(SKETCH, dtype=np.int32)
        for r in spark.read.parquet(f"{path}/order").collect():
            counts[r.id * PIECE : (r.id + 1) * PIECE] = np.frombuffer(r.counts, dtype=np.int32)
        store = cls(spark, path, counts)
        last = max((json.loads(r[0]) for r in spark.read.text(f"{path}/manifest/*").collect()), key=lambda m: m["version"])
        store.version, store.segments, store.records = last["version"], last["segments"], last["records"]
        return store

    def _commit(self) -> None:
        self.version += 1
        text = json.dumps({"version": self.version, "segments": self.segments, "records": self.records})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version:09d}")

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Take rows (row_id, url, headline) in, one new segment for each batch, in their order; gives them parsed (RECORDS)."""
        here = f"{self.path}/records-{uuid.uuid4().hex}"
        x = parsed(rows, self.counts, batch)
        x = stage(x, "p6-parsed").withColumn("same", F.xxhash64("words"))
        reps = x.groupBy("batch", "same").agg(F.min("row_id").alias("rec"))
        x.join(reps, ["batch", "same"]).select("rec", "row_id", "page", "words", "batch").write.parquet(here)
        new = self.spark.read.schema(RECORDS).parquet(here)
        held = new.where("row_id = rec").groupBy("batch").agg(F.sum(F.size("words") - F.ceil(0.7 * F.size("words")) + 2).alias("n")).orderBy("batch").collect()  # one row per batch
        if held:
            self.records.append(here)
            texts = new.where("row_id = rec").select(F.col("batch").alias("segment"), "rec", "words").mapInPandas(suffixes, SUFFIX)
            pages = new.where("page is not null").groupBy(F.col("batch").alias("segment"), F.col("page").alias("word")).agg(F.min("row_id").alias("rec"))
            pages = pages.select("segment", "word", F.lit(0).cast("bigint").alias("prev"), "rec", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sig"), F.lit(b"").alias("follow"))
            self._accept(self._build(texts.unionByName(pages), sum(r.n for r in held), [(r.batch, 1) for r in held]))
            self._commit()
        return new

    def _build(self, x: DataFrame, size: int, numbers: list[tuple[int, int]]) -> list[list]:
        """Write suffixes as shards of new segments; numbers: (segment, batches in it)."""
        folder = f"segments-{uuid.uuid4().hex}"
        x.repartitionByRange(int(size // SHARD + 1), "segment", "word", "rec").mapInPandas(packed, SHARDS).write.parquet(f"{self.path}/{folder}")
        found = self.spark.read.schema(SHARDS).parquet(f"{self.path}/{folder}").select("segment", "shard", "lo", "hi").collect()  # one row per SHARD suffixes
        return [[n, folder, k, sorted([r.shard, r.lo, r.hi] for r in found if r.segment == k)] for k, n in numbers]

    def _accept(self, new: list[list]) -> None:
        """Append segments; the last two of equal size become one, and so on, as in a binary counter. All merges are one job."""
        groups = [(s[0], [s]) for s in self.segments]
        for s in new:
            groups.append((s[0], [s]))
            while len(groups) > 2 and groups[-1][0] >= groups[-2][0]:  # the first, the history, stays as it is
                (m, x), (n, y) = groups[-2:]
                groups[-2:] = [(m + n, x + y)]
        joined = [g for g in groups if len(g[1]) > 1]
        made: list[list] = []
        if joined:
            target = {(s[1], s[2]): k for k, g in enumerate(joined) for s in g[1]}
            x, size = None, 0
            for f in sorted({f for f, _ in target}):
                of = F.create_map(*[F.lit(v) for (g, n), k in target.items() if g == f for v in (n, k)])
                part = self.spark.read.schema(SHARDS).parquet(f"{self.path}/{f}").where(F.col("segment").isin([n for g, n in target if g == f])).withColumn("segment", F.element_at(of, F.col("segment")))
                x = part if x is None else x.unionAll(part)
            size = x.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            made = self._build(x.mapInPandas(unpacked, SUFFIX), size, [(k, g[0]) for k, g in enumerate(joined)])
        left = iter(made)
        self.segments = [next(left) if len(g) > 1 else g[0] for _, g in groups]

    def find(self, rows: DataFrame) -> DataFrame:
        """kept_row_id, row_id of the rows, already added, that repeat a row of smaller row_id."""
        texts = rows.where("row_id = rec").select(F.lit(0).alias("segment"), "rec", "words").mapInPandas(suffixes, SUFFIX)
        pages = rows.where("page is not null").select(F.lit(0).alias("segment"), F.col("page").alias("word"), F.lit(0).cast("bigint").alias("prev"), F.col("row_id").alias("rec"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sig"), F.lit(b"").alias("follow"))
        bounds = [(k, np.array([b[0] for b in s[3]]), np.array([b[1] for b in s[3]]), np.array([b[2] for b in s[3]])) for k, s in enumerate(self.segments) if s[3]]
        held = self.spark.sparkContext.broadcast(bounds)  # three numbers a shard

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                w = pdf["word"].to_numpy()
                for k, shard, lo, hi in held.value:
                    a, b = np.searchsorted(hi, w, "left"), np.searchsorted(lo, w, "right")
                    n = np.maximum(0, b - a)
                    i = np.repeat(np.arange(len(w)), n)
                    if len(i):
                        to = shard[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + a[i]]
                        yield pdf.iloc[i].assign(segment=np.int32(k), shard=to.astype(np.int32))

        probes = texts.unionByName(pages).mapInPandas(route, SUFFIX + ", shard int")
        live = None
        for k, s in enumerate(self.segments):
            part = self.spark.read.schema(SHARDS).parquet(f"{self.path}/{s[1]}").where(F.col("segment") == s[2]).withColumn("segment", F.lit(k))
            live = part if live is None else live.unionAll(part)
        if live is None:
            return rows.select(F.col("row_id").alias("kept_row_id"), "row_id").limit(0)
        hits = probes.groupBy("segment", "shard").cogroup(live.groupBy("segment", "shard")).applyInPandas(searched, "row_id bigint, old bigint, n int, m int, cover int")
        found = stage(hits.groupBy("row_id", "old", "n", "m").agg(F.sum("cover").alias("cover")).where(_enough()), "p6-found")
        same_page = found.where("n = 0").groupBy("row_id").agg(F.min("old").alias("by_page"))
        near = found.where("n > 0").select("row_id", "old")
        sets = self.spark.read.schema(RECORDS).parquet(*self.records).where("row_id = rec").select(F.col("rec").alias("old"), F.col("words").alias("w_old"))
        sets = sets.join(broadcast_if_small(near.select("old").distinct(), SMALL), "old", "left_semi")
        near = near.join(rows.where("row_id = rec").select("row_id", "words"), "row_id").join(sets, "old")
        shared = F.size(F.array_intersect("words", "w_old"))
        near = near.where(10 * shared >= 7 * (F.size("words") + F.size("w_old") - shared)).groupBy(F.col("row_id").alias("rec")).agg(F.min("old").alias("by_text"))
        out = rows.groupBy("row_id").agg(F.min("rec").alias("rec"), F.max(F.size("words")).alias("n")).join(near, "rec", "left").join(same_page, "row_id", "left")
        by_text = F.when((F.col("n") > 0) & (F.col("rec") < F.col("row_id")), F.coalesce("by_text", "rec")).otherwise(F.col("by_text"))
        return out.select(F.least(by_text, "by_page").alias("kept_row_id"), "row_id").where("kept_row_id is not null")


def _enough():
    """Coverage from which a pair of sets of n and m words can overlap by 0.7; a page (n = 0) needs none."""
    rest = F.greatest(*[F.ceil(7 * F.col(c) / 10) for c in ("n", "m")]) - 1
    return (F.col("n") == 0) | (F.col("cover") >= F.ceil(7 * (F.col("n") + F.col("m")) / 17) - rest)


def repeats(history: DataFrame, incoming: DataFrame, batch: str) -> DataFrame:
    """kept_row_id, row_id of each incoming row (row_id, url, headline, batch number) that repeats history or an earlier incoming row."""
    cols = ["row_id", "url", "headline"]
    store = SegmentStore.create(history.select(cols))
    store.add(history.select(cols))
    return store.find(store.add(incoming.select(*cols, F.coalesce(F.col(batch).cast("int"), F.lit(-1)).alias("_batch")), "_batch"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "articles"), table(spark, d, "incoming_articles"), "batch_no")


QUERIES = {"p6_found": p6_found}
_POOL = "SELECT row_id, url, headline FROM articles UNION ALL SELECT row_id, url, headline FROM incoming_articles"
_PARTS = r"regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query'])"
SQL = {
    "p6_found": f"""WITH pool AS ({_POOL}), u AS (SELECT row_id, {_PARTS} AS p FROM pool WHERE url IS NOT NULL),
  g AS (SELECT row_id, regexp_replace(regexp_replace(lower(p.host), '\\.+$', ''), '^(www|m)\\.', '') AS host, regexp_replace(url_decode(p.path), '(/amp|/)+$', '') AS path,
    CASE WHEN regexp_matches(p.query, '(^|[&;])id=') THEN url_decode(regexp_extract(p.query, '(?:^|[&;])id=([^&;]*)', 1)) END AS ident FROM u WHERE p.host <> ''),
  byurl AS (SELECT a.row_id, min(b.row_id) AS kept FROM g a JOIN g b ON a.host = b.host AND a.path = b.path AND a.ident IS NOT DISTINCT FROM b.ident AND b.row_id < a.row_id GROUP BY a.row_id),
  {overlap_pairs("SELECT row_id AS k, coalesce(headline, '') AS t FROM pool", 'heads')}, bytext AS (SELECT y AS row_id, min(x) AS kept FROM heads GROUP BY y),
  k AS (SELECT row_id, min(kept) AS kept FROM (SELECT * FROM byurl UNION ALL SELECT * FROM bytext) b GROUP BY row_id)
  SELECT k.kept AS kept_row_id, k.row_id FROM k JOIN incoming_articles i ON i.row_id = k.row_id""",
}
